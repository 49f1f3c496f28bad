"""Files: formats by name, text snapshots, binary pages with pluggable extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension -> format, fixed.
FORMATS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf", "html": "html", "htm": "html", "txt": "text", "wav": "audio", "tsv": "gazetteer"}


def format_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))[ext], F.lit("unknown"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def resolve_content(df: DataFrame, *, prefer_snapshot: bool = False) -> DataFrame:
    """Adds content and origin from columns snapshot_text and original_text, whichever comes first and is not null."""
    order = ["snapshot", "original"] if prefer_snapshot else ["original", "snapshot"]
    origin = F.when(F.col(f"{order[0]}_text").isNotNull(), order[0]).when(F.col(f"{order[1]}_text").isNotNull(), order[1])
    return df.withColumn("content", F.coalesce(*(f"{o}_text" for o in order))).withColumn("origin", origin)


def read_pages(spark: SparkSession, path: str, extractors: list[Callable[[bytes], Iterator[str]]]) -> DataFrame:
    """(file, page, text) of binary files. Each extractor yields page texts; the first that gives any non-blank page wins."""

    def pages(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"]):
                for extract in extractors:
                    try:
                        found = [(i, t) for i, t in enumerate(extract(bytes(content)), 1) if t and t.strip()]
                    except ValueError:
                        continue
                    if found:
                        rows += [(file, i, t) for i, t in found]
                        break
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "file string, page int, text string")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of a tab-separated gazetteer of 19 columns."""
    schema = "geonameid long, name string, asciiname string, altnames string, lat double, lon double, feat_class string, feat_code string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation int, dem int, timezone string, modified string"
    return spark.read.csv(path, sep="\t", schema=schema, quote="")


def place_aliases(places: DataFrame) -> DataFrame:
    """(alias, geonameid, population): names, ASCII names and alternatives, lower-cased, with and without accents."""
    from tessera.functions.text import strip_accents

    names = F.concat(F.array("name", "asciiname"), F.split(F.coalesce("altnames", F.lit("")), ","))
    lowered = F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n != "")
    both = F.array_distinct(F.concat(lowered, F.transform(lowered, strip_accents)))
    return places.select(F.explode(both).alias("alias"), "geonameid", "population")
