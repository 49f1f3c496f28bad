"""Queries over tables: scans, predicates, joins, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import tables as M
from tessera.registry import query
from tessera.session import table


@query("sc08_point_lookup", "SELECT doc_id, text FROM documents WHERE doc_id = 42 LIMIT 1")
def sc08(spark, d):
    return table(spark, d, "documents").where("doc_id = 42").select("doc_id", "text").limit(1)


@query("sc09_batch_lookup", "SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def sc09(spark, d):
    ids = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return M.lookup(table(spark, d, "documents").select("doc_id", "source", "lang"), ids, "doc_id")


@query("sc11_source_ids", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def sc11(spark, d):
    return table(spark, d, "documents").select("source").where("source <> ''").distinct()


@query("sc13_page_offsets", "SELECT doc_id, coalesce(nullif(doc_id % 4, 0), 1) AS page_offset FROM documents")
def sc13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.col("doc_id") % 4, F.lit(0)), F.lit(1)).alias("page_offset"))


@query("sc17_mention_scan", "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 0.3 AND user_id IN (1, 2, 3, 5, 8, 13) AND contains(lower(event_type), 'c') ORDER BY event_id LIMIT 1000")
def sc17(spark, d):
    own = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return M.mentions(own, sources=[1, 2, 3, 5, 8, 13], source_col="user_id", min_confidence=0.3, confidence_col="value", text="C", text_cols=["event_type"], order=["event_id"])


@query("pf03_empty_in", "SELECT event_id FROM events WHERE 1 = 0")
def pf03(spark, d):
    return table(spark, d, "events").where(M.any_of(F.col("user_id"), [])).select("event_id")


@query("pf04_contains_ci", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e')")
def pf04(spark, d):
    return table(spark, d, "part").where(M.contains_ci(F.col("p_name"), "E")).select("p_partkey", "p_name")


@query("pf07_positive_int", "SELECT event_id, CASE WHEN n >= 1 THEN n END AS page FROM (SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(event_id % 9 - 2 AS VARCHAR) END AS INTEGER) AS n FROM events)")
def pf07(spark, d):
    said = F.when(F.col("event_id") % 4 == 0, "x").otherwise((F.col("event_id") % 9 - 2).cast("string"))
    return table(spark, d, "events").select("event_id", M.positive_int(said).alias("page"))


@query("pf26_page_range_rejects", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 > l_partkey % 50")
def pf26(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey % 50 > l_partkey % 50").select("l_orderkey", "l_linenumber")


@query("sk01_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT (c_custkey % 10 = 0) UNION ALL SELECT c_custkey, 'new ' || c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 100 = 1")
def sk01(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = own.where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = new.unionByName(own.where("c_custkey % 100 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return M.upsert(own, new, ["c_custkey"])


@query("sk04_patch", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def sk04(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = own.where("c_custkey % 5 = 0 OR c_custkey % 7 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").alias("c_name"), F.when(F.col("c_custkey") % 7 == 0, 0.0).alias("c_acctbal"))
    return M.patch(own, changes, ["c_custkey"])


@query("sk05_coerced_upsert", """
SELECT event_id, trim(event_type) AS place_name, try_cast(raw AS DOUBLE) AS confidence, greatest(1, coalesce(try_cast(cnt AS INTEGER), 1)) AS candidates FROM (
  SELECT event_id, ' ' || event_type || ' ' AS event_type, CASE WHEN event_id % 6 = 0 THEN 'bad' ELSE CAST(event_id % 100 AS VARCHAR) END AS raw, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 4 AS VARCHAR) END AS cnt FROM events) WHERE try_cast(raw AS DOUBLE) IS NOT NULL""")
def sk05(spark, d):
    raw = F.when(F.col("event_id") % 6 == 0, "bad").otherwise((F.col("event_id") % 100).cast("string"))
    cnt = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 4).cast("string"))
    own = table(spark, d, "events").select("event_id", F.trim(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("place_name"), raw.try_cast("double").alias("confidence"), F.greatest(F.lit(1), F.coalesce(cnt.try_cast("int"), F.lit(1))).alias("candidates"))
    return own.where("confidence IS NOT NULL")


@query("sk07_delete_by_source", "SELECT event_id, user_id FROM events WHERE user_id <> 7 OR user_id IS NULL")
def sk07(spark, d):
    return M.delete(table(spark, d, "events").select("event_id", "user_id"), F.col("user_id") == 7)


@query("sk14_migrate", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS role_hint, CAST(NULL AS DOUBLE) AS lat FROM nation")
def sk14(spark, d):
    return M.migrate(table(spark, d, "nation").select("n_nationkey", "n_name"), {"n_name": "string", "role_hint": "string", "lat": "double"})


@query("sk20_sessions", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 100")
def sk20(spark, d):
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))
    return own.orderBy(F.desc("last_turn"), "conv_id").limit(100)


@query("sc23_content_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'snapshot' WHEN doc_id % 5 = 0 THEN NULL ELSE 'original' END AS origin FROM documents")
def sc23(spark, d):
    from tessera.sources.files import resolve_content

    own = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("snapshot_text"), F.when((F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 5 != 0), F.col("text")).alias("original_text"))
    return resolve_content(own, prefer_snapshot=True).select("doc_id", "origin")


@query("jn03_upload_guard", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn03(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("jn04_inventory", "SELECT coalesce(doc_id, vec_id) AS doc_id, doc_id IS NOT NULL AS has_details, vec_id IS NOT NULL AS has_chunks FROM (SELECT doc_id FROM documents) a FULL OUTER JOIN (SELECT DISTINCT vec_id FROM embeddings) b ON a.doc_id = b.vec_id")
def jn04(spark, d):
    return M.inventory(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("jn05_owned_chunks", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.o_custkey % 7 + 1")
def jn05(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(asked, ["l_orderkey", "l_linenumber"])


@query("jn06_chunk_detail", "SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_linenumber = 1")
def jn06(spark, d):
    own = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return own.join(orders, "l_orderkey", "left").join(people, "o_custkey", "left").drop("o_custkey")


@query("jn14_page_labels", "SELECT e.event_id, coalesce(CAST(n.n_name AS VARCHAR), 'unknown') AS label FROM events e LEFT JOIN nation n ON e.user_id = n.n_nationkey")
def jn14(spark, d):
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return table(spark, d, "events").select("event_id", "user_id").join(labels, "user_id", "left").select("event_id", F.coalesce("n_name", F.lit("unknown")).alias("label"))


@query("jn16_citation_labels", "SELECT doc_id, CASE WHEN l.toxic = 1 THEN 'stored' ELSE replace(source, 'src', 'Source ') END AS label FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def jn16(spark, d):
    stored = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").select("doc_id", "source").join(stored, "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "stored").otherwise(F.regexp_replace("source", "src", "Source ")).alias("label"))
