"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "_tessera_shipped"


def get_spark(app: str = "tessera", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so Python workers anywhere can import it."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    target = os.path.join(folder, "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
    context.addPyFile(target)
    setattr(context, _SHIPPED, True)


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where that is unset and all runs on this machine, one of our own (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tessera-shared-"))
    return _OWN_FOLDER[0]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder under the shared one that nothing else writes to."""
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
