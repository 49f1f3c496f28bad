"""Queries of the person resolver and of names that are alike; the tests hold them against plain versions over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import people as P
from tessera.operators.similar_join import alike_pairs
from tessera.registry import query
from tessera.session import fresh_folder, table


def name_mentions(spark, d):
    """One mention of each document: its first two words as a name, every third time the second alone, every seventh with a title."""
    words = F.regexp_extract_all(F.initcap(F.regexp_replace("text", r"[^\p{L}\s]", "")), F.lit(r"\S+"), F.lit(0))
    own = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars"), words.alias("w")).where(F.size("w") >= 2)
    one, two = F.element_at("w", 1), F.element_at("w", 2)
    name = F.when(F.col("doc_id") % 3 == 0, two).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Dr. "), one, F.lit(" "), two)).otherwise(F.concat(one, F.lit(" "), two))
    return own.select("doc_id", "source", name.alias("raw_name"), F.round(0.5 + (F.col("n_chars") % 50) / 100, 2).alias("ner"))


@query("pe07_resolve")
def pe07(spark, d):
    return P.resolve(name_mentions(spark, d), "raw_name", ["doc_id"], "ner").select("doc_id", "raw_name", "canonical_name", "method", "confidence", "role_hint")


@query("pe11_resolved_registry")
def pe11(spark, d):
    """The registry of the resolved mentions, after those of one source were removed (PE10)."""
    resolved = P.resolve(name_mentions(spark, d), "raw_name", ["doc_id"], "ner")
    gone = resolved.where("source = 'src3'").select("canonical_name", "raw_name", F.col("source").alias("source_id"))
    left = P.without(P.registry(resolved, "raw_name", "source"), gone)
    return left.select("canonical_name", "mention_count", "source_ids", F.map_entries("variants").alias("variants"))


@query("pe13_peopletag")
def pe13(spark, d):
    own = name_mentions(spark, d).withColumn("snippet", F.substring("raw_name", 1, 8))
    return P.peopletag(own, "raw_name", "source", "snippet", ["doc_id"], "ner").select("doc_id", "canonical_name", "method", "confidence")


@query("jn12_alike_names")
def jn12(spark, d):
    """For each name the likest other of at least 93, of equal ones the least."""
    names = f"{fresh_folder(spark, 'names')}/names"
    name_mentions(spark, d).select(F.lower("raw_name").alias("name")).distinct().write.parquet(names)
    own = spark.read.parquet(names)
    pairs = alike_pairs(own, "name", own.select(F.col("name").alias("other")), "other", 93.0).where("name <> other")
    return pairs.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("best")).select("name", F.col("best.other").alias("alias"), F.round(-F.col("best.s"), 4).alias("score"))
