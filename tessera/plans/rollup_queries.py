"""Queries of the aggregation flow: people, places, citations, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import rollups as A
from tessera.operators.mentions import value_quantile
from tessera.registry import query
from tessera.session import table


def mention_rows(spark, d):
    """Events as mentions: the user is the person, the hour bucket the chunk, the type the variant."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("source_id"), (F.col("event_id") % 50).alias("chunk_id"), F.col("event_type").alias("raw_name"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("canonical_name"), F.when(F.col("event_id") % 3 == 0, "mentioned").otherwise("").alias("role"), (F.col("event_id") % 64 / 64.0).alias("confidence"),
    )


SQL_MENTIONS = "m AS (SELECT event_id AS id, user_id % 20 AS source_id, event_id % 50 AS chunk_id, event_type AS raw_name, 'user ' || user_id AS canonical_name, CASE WHEN event_id % 3 = 0 THEN 'mentioned' ELSE '' END AS role, (event_id % 64) / 64.0::DOUBLE AS confidence FROM events)"


@query("ag01_people", f"""
WITH {SQL_MENTIONS}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_id, raw_name ORDER BY id) AS k FROM m) WHERE k = 1)
SELECT canonical_name, count(*) AS mentions, count(DISTINCT source_id) AS sources, array_to_string(list_sort(list_distinct(list(raw_name))), '|') AS variants, coalesce(array_to_string(list_sort(list_distinct(list(role) FILTER (trim(role) <> ''))), '|'), '') AS roles, round(avg(confidence), 4) AS confidence FROM once GROUP BY canonical_name""")
def ag01(spark, d):
    return A.people(mention_rows(spark, d))


@query("ag02_places_paged", f"""
WITH {SQL_MENTIONS}, page AS (SELECT * FROM m WHERE confidence >= 0.75 ORDER BY id LIMIT 1000), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_id, raw_name ORDER BY id) AS k FROM page) WHERE k = 1)
SELECT raw_name, count(*) AS mentions, max(confidence) AS confidence, arg_min(canonical_name, id) AS first_name FROM once GROUP BY raw_name""")
def ag02(spark, d):
    """Rows are paged before they are grouped."""
    page = mention_rows(spark, d).where("confidence >= 0.75").orderBy("id").limit(1000)
    once = A.first_rows(page, ["source_id", "chunk_id", "raw_name"], ["id"])
    return once.groupBy("raw_name").agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"), F.min_by("canonical_name", "id").alias("first_name"))


@query("ag04_bibliography", "SELECT l_suppkey, CASE WHEN count(DISTINCT p) = 1 THEN 'p. ' ELSE 'pp. ' END || array_to_string(list_transform(list_sort(list_distinct(list(p))), lambda x: CAST(x AS VARCHAR)), ', ') AS pages FROM (SELECT l_suppkey, l_orderkey % 30 + 1 AS p FROM lineitem WHERE l_quantity > 30) GROUP BY l_suppkey")
def ag04(spark, d):
    own = table(spark, d, "lineitem").where("l_quantity > 30").select("l_suppkey", (F.col("l_orderkey") % 30 + 1).alias("p"))
    pages = F.sort_array(F.collect_set("p"))
    return own.groupBy("l_suppkey").agg(F.concat(F.when(F.size(pages) == 1, "p. ").otherwise("pp. "), F.array_join(pages.cast("array<string>"), ", ")).alias("pages"))


@query("ag05_display_groups", f"WITH {SQL_MENTIONS} SELECT source_id, lower(raw_name) AS name, chunk_id // 10 AS bucket, min(id) AS representative, count(*) AS n FROM m GROUP BY source_id, lower(raw_name), chunk_id // 10")
def ag05(spark, d):
    return mention_rows(spark, d).groupBy("source_id", F.lower("raw_name").alias("name"), F.floor(F.col("chunk_id") / 10).alias("bucket")).agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("n"))


@query("ag07_score_distribution", "SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0.0), 4) AS sd, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def ag07(spark, d):
    return A.distribution(table(spark, d, "lineitem"), "l_quantity", ["l_orderkey"])


@query("ag08_dedup_metrics", "SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS removed, round(100.0::DOUBLE * (count(*) - count(DISTINCT text)) / count(*), 4) AS percent FROM documents")
def ag08(spark, d):
    # counted by hash first, so no task holds all texts
    n = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("before"), F.count(F.lit(1)).alias("after"))
    return n.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 4).alias("percent"))


@query("ag11_alias_index", f"WITH {SQL_MENTIONS}, c AS (SELECT lower(raw_name) || source_id AS alias, canonical_name AS canonical, count(*) AS n FROM m GROUP BY ALL) SELECT alias, canonical, n FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, canonical) AS k FROM c) WHERE k = 1")
def ag11(spark, d):
    return A.aliases(mention_rows(spark, d), F.concat(F.lower("raw_name"), F.col("source_id").cast("string")), "canonical_name")


@query("ag12_top_of_country", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS top FROM customer GROUP BY c_nationkey")
def ag12(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("top"))


@query("ag15_benchmark_statistics", "SELECT event_type, round(avg(value), 4) AS mean, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95, round(median(value), 6) AS median, round(stddev_samp(value), 4) AS sd FROM events GROUP BY event_type")
def ag15(spark, d):
    own = table(spark, d, "events").select("event_type", "value")
    sums = own.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_samp("value"), 4).alias("sd"))
    return sums.join(value_quantile(own, ["event_type"], "value", 0.95).withColumnRenamed("quantile", "p95"), "event_type")


@query("wn06_first_row_wins", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def wn06(spark, d):
    return A.first_rows(table(spark, d, "documents").withColumn("h", F.sha2("text", 256)), ["source", "h"], ["doc_id"]).select("doc_id", "source")


@query("wn07_citation_renumber", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY o) AS k FROM o) SELECT l_orderkey, l_linenumber, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY o) AS INTEGER) AS number FROM k WHERE k = 1")
def wn07(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = table(spark, d, "lineitem").withColumn("o", F.row_number().over(w)).withColumn("page", F.col("l_suppkey") % 5)
    return A.renumber(own, ["l_orderkey"], ["page"], "o").select("l_orderkey", "l_linenumber", "l_suppkey", "number")


@query("wn08_span_islands", "WITH s AS (SELECT user_id, event_id % 1000 AS lo, event_id % 1000 + 15 AS hi FROM events), b AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s), i AS (SELECT *, sum(CASE WHEN p IS NULL OR lo > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS spans FROM i GROUP BY user_id, g")
def wn08(spark, d):
    own = table(spark, d, "events").select("user_id", (F.col("event_id") % 1000).alias("lo"), (F.col("event_id") % 1000 + 15).alias("hi"))
    return A.islands(own, ["user_id"], "lo", "hi")


@query("tk06_people_sort", f"WITH {SQL_MENTIONS} SELECT canonical_name, count(*) AS n FROM m GROUP BY canonical_name ORDER BY n DESC, canonical_name LIMIT 25")
def tk06(spark, d):
    return mention_rows(spark, d).groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "canonical_name").limit(25)
