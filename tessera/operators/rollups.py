"""Aggregations over mention, citation and metric tables."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import sliced
from tessera.session import ship_package


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def people(mentions: DataFrame, min_count: int = 1) -> DataFrame:
    """Of columns source_id, chunk_id, raw_name, canonical_name, role, confidence: one row a person, mentions counted once for each (source, chunk, name)."""
    once = first_rows(mentions, ["source_id", "chunk_id", "raw_name"], ["id"])
    return (
        once.groupBy("canonical_name")
        .agg(
            F.count(F.lit(1)).alias("mentions"), F.countDistinct("source_id").alias("sources"), F.array_join(F.sort_array(F.collect_set("raw_name")), "|").alias("variants"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.trim("role") != "", F.col("role")))), "|").alias("roles"), F.round(F.avg("confidence"), 4).alias("confidence"),
        )
        .where(F.col("mentions") >= min_count)
    )


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, max, mean, sample deviation (0 for one row) and count."""
    return df.groupBy(*by).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("sd"), F.count(F.lit(1)).alias("n")
    )


def ordered_text(df: DataFrame, by: list[str], order: str, text: Column, apart: str = "\n\n") -> DataFrame:
    """Texts of a group joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), apart).alias("joined"))


def aliases(mentions: DataFrame, alias: Column, canonical: str) -> DataFrame:
    """alias -> the canonical name with most mentions, ties to the lesser name."""
    counted = mentions.select(alias.alias("alias"), F.col(canonical).alias("canonical")).groupBy("alias", "canonical").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counted, ["alias"], [F.desc("n"), "canonical"])


def renumber(citations: DataFrame, group: list[str], key: list[str], order: str) -> DataFrame:
    """The first citation of each key stays; those left are numbered from 1 in their order."""
    once = first_rows(citations, [*group, *key], [order])
    return once.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(order)))


def islands(spans: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Overlapping or touching spans merged. Spans without bounds come last, into the last island; where a group has no others, each is its own."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(lo), F.asc_nulls_last(hi))
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0))
    # equal spans are peers, so their order does not matter
    island = F.when(F.col(lo).isNull(), F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.sum("__new").over(w))
    return marked.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("spans")).drop("__island")


def repeating(df: DataFrame, key: str, words: int, times: int) -> DataFrame:
    """df with ``repeats``: whether a run of so many words occurs so often in its text. Runs are counted by key, before and after the shuffle."""
    own = df.select(key, F.posexplode(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")).alias("at", "word"))
    w = Window.partitionBy(key).orderBy("at")
    runs = own.select(key, F.concat_ws(" ", "word", *(F.lead("word", i).over(w) for i in range(1, words))).alias("run"), F.lead("word", words - 1).over(w).alias("last")).where("last IS NOT NULL")
    often = runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times).select(key).distinct().withColumn("repeats", F.lit(True))
    return df.join(often, key, "left").fillna(False, ["repeats"])


def _trigrams(batches, least: int):
    """(key, gram, n) of texts: their word trigrams that each has so often."""
    for whole in batches:
        for batch in sliced(whole, 1):
            rows, grams, counts = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                # bytes are parted at ASCII white space
                words = (text or b"").split()
                for gram, n in Counter(zip(words, words[1:], words[2:])).items():
                    if n >= least:
                        rows.append(i)
                        grams.append(b" ".join(gram).decode())
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["key", "gram", "n"])


#: Keys of several rows that are sent to the texts instead of shuffling these.
MAX_SENT = 100_000


def repeated_trigrams(documents: DataFrame, key: str, least: int) -> DataFrame:
    """(key, gram, n): the word trigrams, in lower case, that a document has at least so often. Each row is counted where it lies; only keys are shuffled, and the trigrams of keys that several rows have. Those keys are counted first: up to MAX_SENT go to the texts, else the texts are shuffled too."""
    ship_package(documents.sparkSession)
    kind = f"key {documents.schema[key].dataType.simpleString()}, gram string, n long"
    rows = documents.select(F.col(key).alias("key"), F.lower("text").alias("text"))
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("key").alias("again"))
    n = often.limit(MAX_SENT + 1).count()
    if not n:
        return rows.mapInArrow(lambda b: _trigrams(b, least), kind).select(F.col("key").alias(key), "gram", "n")
    often = F.broadcast(often) if n <= MAX_SENT else often
    same = F.col("key").eqNullSafe(F.col("again"))
    single = rows.join(often, same, "left_anti").mapInArrow(lambda b: _trigrams(b, least), kind)
    shared = rows.join(often, same, "left_semi").mapInArrow(lambda b: _trigrams(b, 1), kind).groupBy("key", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return single.unionAll(shared).select(F.col("key").alias(key), "gram", "n")
