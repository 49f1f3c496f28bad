"""Settings: modes by memory, parameters by intent, precedence, typed values from the environment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modes: least memory in GB, context window, budget, rows fused, reranked and kept. Fixed values.
MODES = (
    ("regular", 0, 16_000, 8_000, 50, 30, 5),
    ("regular", 48, 64_000, 32_000, 50, 30, 5),
    ("regular", 64, 64_000, 48_000, 100, 55, 8),
    ("deep-research", 48, 64_000, 40_000, 200, 80, 8),
)
#: Former names of modes. Fixed values.
FORMER = {
    "high": "regular",
    "high-performance": "regular",
    "tier1": "regular",
    "power-fast": "regular",
    "efficiency": "regular",
    "tier2": "regular",
    "power-deep-research": "deep-research",
}
#: Intents whose generation differs: temperature, top_p, presence penalty; all others: OTHER. Fixed values.
GENERATION = {"FACTUAL": (0.5, 0.7, 1.5), "EXTRACT": (0.5, 0.7, 0.0), "TIMELINE": (0.5, 0.7, 1.0), "QUOTE_EVIDENCE": (0.3, 0.6, 0.0)}
OTHER = (0.7, 0.8, 1.5)
#: Intents that think in deep research, and their temperature and top_p there. Fixed values.
THINKING, THINKING_VALUES = ("EXPLAIN", "ANALYZE", "COMPARE", "CRITIQUE"), (1.0, 0.95)


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODES, "mode string, least_gb int, context int, budget int, fused int, reranked int, kept int")


def mode_name(manual: Column, environment: Column) -> Column:
    """What is asked by hand, else by the environment, else regular; former names are read as what they mean, unknown ones become null."""
    blank = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    own = F.coalesce(blank(manual), blank(environment), F.lit("regular"))
    now = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMER.items() for x in kv)), own), own)
    return F.when(now.isin("regular", "deep-research"), now)


def with_mode(df: DataFrame, mode: str, memory: str) -> DataFrame:
    """Adds the values of each row's mode for its memory; deep research without enough of it is regular."""
    table = F.broadcast(modes(df.sparkSession).select(F.col("mode").alias("__mode"), "least_gb", "context", "budget", "fused", "reranked", "kept"))
    wanted = F.when((F.col(mode) == "deep-research") & (F.col(memory) < 48), "regular").otherwise(F.col(mode))
    tier = F.when(wanted == "deep-research", 48).when(F.col(memory) >= 64, 64).when(F.col(memory) >= 48, 48).otherwise(0)
    return df.withColumn("__wanted", wanted).withColumn("__tier", tier).join(table, (F.col("__wanted") == F.col("__mode")) & (F.col("__tier") == F.col("least_gb")), "left").drop("__wanted", "__tier", "__mode", "least_gb")


def generation(intent: Column, mode: Column) -> Column:
    """(temperature, top_p, presence_penalty, thinking) of an intent, whatever its case."""
    name, deep = F.upper(intent), (mode == "deep-research") & F.upper(intent).isin(*THINKING)
    out = []
    for i, key in enumerate(("temperature", "top_p", "presence_penalty")):
        value = F.lit(OTHER[i])
        for known, values in GENERATION.items():
            value = F.when(name == known, F.lit(values[i])).otherwise(value)
        out.append((F.when(deep, F.lit(THINKING_VALUES[i])).otherwise(value) if i < 2 else value).alias(key))
    return F.struct(*out, F.coalesce(deep, F.lit(False)).alias("thinking"))


def resolved(*given: Column) -> Column:
    """The first value that is given, in the order of precedence: parameters, arguments, configuration, literal."""
    return F.coalesce(*given)


def number_from(text: str | None, default: float, *, low: float | None = None, high: float | None = None) -> float:
    """A number of the environment within limits; the default where it does not read as a finite one."""
    try:
        value = float(text) if text is not None else default
    except ValueError:
        value = default
    if not math.isfinite(value):
        value = default
    return min(max(value, -math.inf if low is None else low), math.inf if high is None else high)


def must_rebuild(policy: Column, pending: Column, batch: int) -> Column:
    """Whether a write calls for a new index: at once, or when a batch is full; deferred ones wait for a query."""
    return (policy == "immediate") | ((policy == "batch") & F.lit(batch > 0) & (pending >= batch))


def status(rows: DataFrame, by: str, policy: Column, batch: int) -> DataFrame:
    """(by, pending, dirty) after rows were written one by one: a full batch begins anew, an immediate index leaves none."""
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    left = F.when(policy == "immediate", F.lit(0)).when((policy == "batch") & F.lit(batch > 0), F.col("total") % max(1, batch)).otherwise(F.col("total"))
    return total.select(by, left.cast("long").alias("pending"), (left > 0).alias("dirty"))
