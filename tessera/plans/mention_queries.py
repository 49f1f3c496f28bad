"""Queries over mentions, registries, citations, sources and ranked lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators import mentions as P
from tessera.operators import tables as M
from tessera.functions.text import token_count
from tessera.operators import retrieval as R
from tessera.plans.retrieval_queries import DOC_BM25, docs, lexical
from tessera.registry import query
from tessera.session import table

#: Names as they are written, and the person that each is.
RAW = ("Dr. Ada Byron", "Ada Byron", "Byron", "Sir Isaac Newton", "  Newton ", "Prof. Dr. Marie  Curie", "Marie Curie", "Curie,", "Capt. James Cook", "Rev.")
CANON = ("Ada Byron", "Ada Byron", "Ada Byron", "Isaac Newton", "Isaac Newton", "Marie Curie", "Marie Curie", "Marie Curie", "James Cook", "")
_SQL_RAW, _SQL_CANON = ("[" + ", ".join(f"'{x}'" for x in names) + "]" for names in (RAW, CANON))
MENTIONS = f"""(SELECT event_id AS mention_id, 's' || (user_id % 20) AS source_id, 'c' || (event_id % 50) AS chunk_id, {_SQL_RAW}[CAST(event_id % 10 AS INTEGER) + 1] AS raw_name,
 {_SQL_CANON}[CAST(event_id % 10 AS INTEGER) + 1] AS canonical_name, (event_id % 101) / 100.0::DOUBLE AS confidence FROM events)"""


def mentions(spark, d):
    at = (F.col("event_id") % 10 + 1).cast("int")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), at)
    return table(spark, d, "events").select(
        F.col("event_id").alias("mention_id"), F.concat(F.lit("s"), F.col("user_id") % 20).alias("source_id"), F.concat(F.lit("c"), F.col("event_id") % 50).alias("chunk_id"),
        pick(RAW).alias("raw_name"), pick(CANON).alias("canonical_name"), ((F.col("event_id") % 101) / F.lit(100.0)).alias("confidence"),
    )


# --- scans -------------------------------------------------------------------


@query("sc10_children_by_ids", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) AS metadata FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sc10(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    found = M.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_suppkey").alias("m")), ids, "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(":", "m.l_orderkey", "m.l_suppkey").alias("metadata"))


@query("sc12_source_summaries", "SELECT doc_id AS source_id, trim(text) AS summary FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND lang <> ''")
def sc12(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL AND trim(text) <> '' AND lang <> ''").select(F.col("doc_id").alias("source_id"), F.trim("text").alias("summary"))


DETAILS = "SELECT doc_id AS source_id, nullif(lang, '') AS citation_reference, source AS source_path, coalesce(nullif(doc_id % 5, 0), 1) AS page_offset FROM documents"


def _details(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.nullif("lang", F.lit("")).alias("citation_reference"), F.col("source").alias("source_path"), M.or_default(F.col("doc_id") % 5, 1).alias("page_offset"))


@query("sc14_source_details", DETAILS)
def sc14(spark, d):
    return _details(spark, d)


@query("sc15_source_detail", f"SELECT * FROM ({DETAILS}) WHERE source_id = 7 LIMIT 1")
def sc15(spark, d):
    return _details(spark, d).where("source_id = 7").limit(1)


@query("sc16_parent_texts", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY page, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, page FROM (SELECT *, coalesce(CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber END, 0) AS page FROM lineitem WHERE trim(l_returnflag) <> '')")
def sc16(spark, d):
    own = table(spark, d, "lineitem").where("trim(l_returnflag) <> ''").withColumn("page", F.coalesce(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linenumber")), F.lit(0)))
    w = Window.partitionBy("l_orderkey").orderBy("page", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return own.select("l_orderkey", F.row_number().over(w).alias("place"), "page")


@query("sc18_person_scan", f"SELECT mention_id, source_id, raw_name FROM {MENTIONS} WHERE confidence >= 0.5 AND source_id IN ('s1', 's2', 's3') AND (contains(lower(raw_name), 'curie') OR contains(lower(canonical_name), 'curie')) ORDER BY mention_id LIMIT 500 OFFSET 5")
def sc18(spark, d):
    return P.people_page(mentions(spark, d), sources=["s1", "s2", "s3"], min_confidence=0.5, text="Curie", text_cols=["raw_name", "canonical_name"], order=["mention_id"], limit=500, offset=5).select("mention_id", "source_id", "raw_name")


@query("sc19_mentions_of_person", f"SELECT mention_id, raw_name FROM {MENTIONS} WHERE canonical_name = 'Ada Byron' ORDER BY mention_id LIMIT 1000")
def sc19(spark, d):
    return P.people_page(mentions(spark, d), canonical=" Ada Byron", order=["mention_id"]).select("mention_id", "raw_name")


@query("sc20_person_mention", f"SELECT * FROM {MENTIONS} WHERE mention_id = 11 LIMIT 1")
def sc20(spark, d):
    return mentions(spark, d).where("mention_id = 11").limit(1)


@query("sc21_registry_rows", f"SELECT source_id, raw_name, canonical_name FROM {MENTIONS} WHERE trim(raw_name) <> '' AND trim(canonical_name) <> ''")
def sc21(spark, d):
    return mentions(spark, d).where("trim(raw_name) <> '' AND trim(canonical_name) <> ''").select("source_id", "raw_name", "canonical_name")


# --- mutations ------------------------------------------------------------------


@query("sk02_append_children", "SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label < 5")
def sk02(spark, d):
    own = table(spark, d, "embeddings")
    new = own.where("label < 5").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return P.append_children(own, new.select("vec_id", "label"), new.select("vec_id", "embedding"), "vec_id").select("vec_id", "label")


@query("sk03_summary_upsert", "WITH n AS (SELECT c_custkey, trim(CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END) AS s FROM customer WHERE c_custkey % 3 = 0) SELECT c.c_custkey AS source_id, coalesce(nullif(n.s, ''), c.c_mktsegment) AS summary FROM customer c LEFT JOIN n USING (c_custkey)")
def sk03(spark, d):
    own = table(spark, d, "customer")
    new = own.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("summary"))
    return P.upsert_mentions(own.select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("summary")), new, "source_id", ["summary"], [])


@query("sk06_person_upsert", f"WITH m AS (SELECT mention_id, trim(raw_name) AS raw_name, canonical_name, confidence FROM {MENTIONS}), n AS (SELECT mention_id, raw_name, canonical_name, try_cast(CASE WHEN mention_id % 7 = 0 THEN 'x' ELSE CAST(mention_id % 3 AS VARCHAR) END AS DOUBLE) AS confidence FROM m WHERE mention_id % 2 = 0 AND canonical_name <> '') SELECT m.mention_id, m.raw_name, m.canonical_name, coalesce(n.confidence, m.confidence) AS confidence FROM m LEFT JOIN n USING (mention_id)")
def sk06(spark, d):
    own = mentions(spark, d).select("mention_id", F.trim("raw_name").alias("raw_name"), "canonical_name", "confidence")
    new = own.where("mention_id % 2 = 0").withColumn("confidence", F.when(F.col("mention_id") % 7 == 0, "x").otherwise((F.col("mention_id") % 3).cast("string")))
    return P.upsert_mentions(own, new, "mention_id", ["raw_name", "canonical_name"], ["confidence"])


@query("sk08_delete_mention", f"SELECT mention_id, source_id FROM {MENTIONS} WHERE mention_id <> 5")
def sk08(spark, d):
    return M.delete(mentions(spark, d), F.col("mention_id") == 5).select("mention_id", "source_id")


@query("sk09_delete_person_source", f"SELECT mention_id, source_id FROM {MENTIONS} WHERE source_id <> 's4'")
def sk09(spark, d):
    return M.delete(mentions(spark, d), F.col("source_id") == "s4").select("mention_id", "source_id")


@query("sk10_delete_person_mention", f"SELECT mention_id, raw_name FROM {MENTIONS} WHERE mention_id <> 12")
def sk10(spark, d):
    return M.delete(mentions(spark, d), F.col("mention_id") == 12).select("mention_id", "raw_name")


@query("sk11_merge_people", f"SELECT mention_id, CASE WHEN canonical_name = 'Marie Curie' THEN 'M. Curie' ELSE canonical_name END AS canonical_name, canonical_name = 'Marie Curie' AS rewritten FROM {MENTIONS}")
def sk11(spark, d):
    return P.merge_canonical(mentions(spark, d), "Marie Curie", "M. Curie").select("mention_id", "canonical_name", "rewritten")


@query("sk12_cascade_five", "SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_orderkey <> 7 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey <> 7 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id <> 7 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id <> 7 UNION ALL SELECT 'part: no column source_id', 0")
def sk12(spark, d):
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "documents": "doc_id", "events": "user_id", "part": "source_id"}
    kept, errors = P.cascade_delete({t: (table(spark, d, t), c) for t, c in keys.items()}, 7)
    out = spark.createDataFrame([(f"{t}: {e}", 0) for t, e in errors.items()], "tab string, n long")
    for t, df in kept.items():
        out = out.unionAll(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tab"), "n"))
    return out


@query("sk19_snapshot_assembly", "SELECT source, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE trim(text) <> '' GROUP BY source")
def sk19(spark, d):
    from tessera.operators import rollups as A

    joined = A.ordered_text(table(spark, d, "documents").where("trim(text) <> ''"), ["source"], "doc_id", F.col("text"))
    return joined.select("source", F.sha2("joined", 256).alias("digest"))


@query("sk21_feedback", "SELECT event_id AS span_id, user_id AS trace_id, CASE WHEN value > 0.5 THEN 'good' ELSE 'bad' END AS label, round(value, 3) AS score, 'user' AS annotator FROM events UNION ALL SELECT -1, -1, 'good', 1.0, 'judge'")
def sk21(spark, d):
    old = table(spark, d, "events").select(F.col("event_id").alias("span_id"), F.col("user_id").alias("trace_id"), F.when(F.col("value") > 0.5, "good").otherwise("bad").alias("label"), F.round("value", 3).alias("score"), F.lit("user").alias("annotator"))
    return old.unionByName(spark.createDataFrame([(-1, -1, "good", 1.0, "judge")], old.schema))


# --- predicates ------------------------------------------------------------------


@query("pf01_escaped_literal", "SELECT event_id, replace('it''s ' || event_type, '''', '''''') AS literal FROM events")
def pf01(spark, d):
    return table(spark, d, "events").select("event_id", M.escaped(F.concat(F.lit("it's "), "event_type")).alias("literal"))


@query("pf02_equality", "SELECT c_custkey FROM customer WHERE c_mktsegment || '''s' = 'BUILDING''s'")
def pf02(spark, d):
    return table(spark, d, "customer").where(F.concat("c_mktsegment", F.lit("'s")) == "BUILDING's").select("c_custkey")


@query("pf05_clean_metadata", "SELECT event_id, concat_ws(';', 'type=' || nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'user=' || CASE WHEN event_id % 4 <> 0 THEN user_id END) AS metadata FROM events")
def pf05(spark, d):
    own = table(spark, d, "events").select("event_id", F.create_map(F.lit("type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.lit("user"), F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string"))).alias("m"))
    return own.select("event_id", F.array_join(F.transform(F.map_entries(M.clean_metadata(F.col("m"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


@query("pf06_row_metadata", "SELECT event_id, user_id AS source, event_type AS kind FROM events")
def pf06(spark, d):
    return table(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("source"), F.col("event_type").alias("kind")).alias("metadata")).select("event_id", "metadata.source", "metadata.kind")


@query("pf08_page_number", "SELECT event_id, CASE WHEN n >= 1 THEN n END AS page FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN try_cast(trim(' ' || (event_id % 7) || ' ') AS INTEGER) ELSE CAST(event_id % 11 - 2 AS INTEGER) END AS n FROM events)")
def pf08(spark, d):
    said = F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, F.concat(F.lit(" "), F.col("event_id") % 7, F.lit(" "))).otherwise((F.col("event_id") % 11 - 2).cast("string"))
    return table(spark, d, "events").select("event_id", M.positive_int(F.trim(said)).alias("page"))


@query("pf22_filtered_groups", f"SELECT canonical_name, count(*) AS mentions, count(DISTINCT source_id) AS sources, max(confidence) AS best FROM {MENTIONS} WHERE source_id IN ('s0', 's5', 's9') GROUP BY canonical_name")
def pf22(spark, d):
    own = mentions(spark, d).where(M.any_of(F.col("source_id"), ["s0", "s5", "s9"]))
    return own.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("source_id").alias("sources"), F.max("confidence").alias("best"))


@query("pf25_chat_text", "SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text ELSE 'a ' || text END AS said FROM conversations")
def pf25(spark, d):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.lit("a")), part("image", F.lit("no")), part("text", F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", M.chat_text(F.when(F.col("turn") % 2 == 0, F.col("text")), parts).alias("said"))


@query("pf27_confidence_rejects", f"SELECT mention_id, confidence * 2 - 0.5 AS confidence FROM {MENTIONS} WHERE NOT (confidence * 2 - 0.5 BETWEEN 0 AND 1)")
def pf27(spark, d):
    return mentions(spark, d).select("mention_id", (F.col("confidence") * 2 - 0.5).alias("confidence")).where(~M.is_share(F.col("confidence")))


# --- joins ------------------------------------------------------------------------


@query("jn02_children_semijoin", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def jn02(spark, d):
    return M.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("jn11_surname_matches", f"WITH n AS (SELECT DISTINCT lower(canonical_name) AS a, regexp_extract(lower(canonical_name), '[^ ]+$') AS l FROM {MENTIONS} WHERE canonical_name <> ''), q AS (SELECT * FROM (VALUES ('byron'), ('isaac newton'), ('j. cook'), ('turing')) t(q)) SELECT q AS query, a AS alias, q = a AS same FROM q JOIN n ON regexp_extract(q, '[^ ]+$') = l")
def jn11(spark, d):
    asked = spark.createDataFrame([("byron",), ("isaac newton",), ("j. cook",), ("turing",)], "q string")
    own = mentions(spark, d).where("canonical_name <> ''").select(N.normalize_name(F.col("canonical_name")).alias("a"))
    return P.surname_matches(asked, own, "q", "a")


@query("jn13_citation_alignment", f"""
WITH {DOC_BM25}, hits AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS packed_index FROM bm),
run AS (SELECT h.*, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))) OVER (PARTITION BY item_id ORDER BY packed_index) AS total FROM hits h JOIN documents USING (doc_id) WHERE packed_index < 10)
SELECT item_id, doc_id, CAST(packed_index AS INTEGER) AS packed_index, source FROM run JOIN documents USING (doc_id) WHERE total <= 2000""")
def jn13(spark, d):
    """Each item's hits that fit into 2,000 words, packed by their places, and by those places with what is known of the hits."""
    hits = lexical(spark, d, 10).select("item_id", "doc_id", "rank")
    texts = docs(spark, d)
    packed = R.pack_prefix(hits.join(texts.select("doc_id", token_count(F.col("text")).alias("words")), "doc_id"), "item_id", F.col("words"), 2000).select("item_id", "rank")
    known = hits.join(texts.select("doc_id", "source"), "doc_id")
    return packed.join(known, ["item_id", "rank"]).select("item_id", "doc_id", (F.col("rank") - 1).alias("packed_index"), "source")


@query("jn15_display_sources", "WITH s AS (SELECT doc_id AS id, source AS label FROM documents), p AS (SELECT vec_id * 2 AS id, 'uploading ' || label AS state FROM embeddings) SELECT coalesce(s.id, p.id) AS id, s.label, coalesce(p.state, 'stored') AS state FROM s FULL OUTER JOIN p ON s.id = p.id")
def jn15(spark, d):
    stored = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))
    pending = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("id"), F.concat(F.lit("uploading "), "label").alias("state"))
    return stored.join(pending, "id", "full_outer").select("id", "label", F.coalesce("state", F.lit("stored")).alias("state"))


# --- aggregates ------------------------------------------------------------------------


@query("ag03_citation_groups", "SELECT l_orderkey % 40 AS source_id, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS pages, count(*) AS n, min(l_partkey) AS first FROM lineitem GROUP BY 1")
def ag03(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("source_id"), F.col("l_partkey").alias("number"), F.col("l_linenumber").alias("page"))
    return P.citation_groups(own).select("source_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.size("numbers").cast("long").alias("n"), "first")


@query("ag09_budget_metrics", "SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber <= 3 THEN q ELSE 0 END) AS BIGINT) AS used, round(100.0 * sum(CASE WHEN l_linenumber <= 3 THEN q ELSE 0 END) / 120, 1) AS utilisation, round(avg(CASE WHEN l_linenumber <= 3 THEN q END), 2) AS avg_tokens, count(*) FILTER (l_linenumber <= 3) AS packed, count(*) FILTER (l_linenumber > 3) AS skipped FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey")
def ag09(spark, d):
    q, packed = F.col("l_quantity").cast("long"), F.col("l_linenumber") <= 3
    used = F.sum(F.when(packed, q).otherwise(0))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(used.alias("used"), F.round(F.lit(100.0) * used / 120, 1).alias("utilisation"), F.round(F.avg(F.when(packed, q)), 2).alias("avg_tokens"), F.count_if(packed).alias("packed"), F.count_if(~packed).alias("skipped"))


@query("ag10_registry", f"""WITH m AS (SELECT * FROM {MENTIONS} WHERE trim(raw_name) <> '' AND trim(canonical_name) <> ''), v AS (SELECT canonical_name, raw_name, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT canonical_name, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources FROM m GROUP BY 1)
SELECT canonical_name, CAST(sum(n) AS BIGINT) AS mention_count, array_to_string(list(raw_name || ':' || n ORDER BY raw_name), ',') AS variants, any_value(sources) AS sources FROM v JOIN s USING (canonical_name) GROUP BY canonical_name""")
def ag10(spark, d):
    own = P.registry(mentions(spark, d))
    return own.select("canonical_name", "mention_count", F.array_join(F.transform("variants", lambda v: F.concat_ws(":", v["raw_name"], v["n"].cast("string"))), ",").alias("variants"), F.array_join("sources", ",").alias("sources"))


@query("pe11_registry_snapshot", f"SELECT canonical_name, count(*) AS mention_count FROM {MENTIONS} WHERE trim(canonical_name) <> '' AND trim(raw_name) <> '' GROUP BY 1 ORDER BY 1")
def pe11(spark, d):
    return P.registry(mentions(spark, d)).select("canonical_name", "mention_count").orderBy("canonical_name")


@query("ag13_trigram_counts", "WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '') AS t FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram FROM w WHERE len(t) >= 3) SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3")
def ag13(spark, d):
    from tessera.operators import rollups as A

    return A.repeated_trigrams(table(spark, d, "documents"), "doc_id", 3)


@query("ag14_latency", "SELECT l_orderkey, CAST(sum(trunc(l_quantity)) AS BIGINT) AS accounted, 400 AS wall, CAST(400 - sum(trunc(l_quantity)) AS BIGINT) AS unaccounted, arg_max(l_shipmode, (q, l_shipmode)) AS slowest FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q, 'span' || l_linenumber AS l_shipmode FROM lineitem) GROUP BY l_orderkey")
def ag14(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("span"), "l_linenumber").alias("name"), F.col("l_quantity").cast("long").alias("ms"), F.lit(400).alias("wall"))
    return P.latency(own, ["l_orderkey"], "wall")


@query("ag18_preview", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, array_to_string(list(event_id ORDER BY k) FILTER (k <= 5), ',') AS preview, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources FROM r GROUP BY user_id")
def ag18(spark, d):
    own = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "event_id"))))
    return own.groupBy("user_id").agg(F.array_join(F.transform(first, lambda x: x["event_id"].cast("string")), ",").alias("preview"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("sources"))


# --- windows and ranked lists -------------------------------------------------------------

RANKED = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_id % 60 AS child, CASE WHEN event_id % 9 <> 0 THEN event_id % 12 END AS parent, 's' || (event_id % 4) AS source, value, event_id, CAST(20 + event_id % 50 AS BIGINT) AS tokens FROM events)"


def ranked(spark, d):
    e = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", F.row_number().over(w).alias("rank"), (e % 60).alias("child"), F.when(e % 9 != 0, e % 12).alias("parent"), F.concat(F.lit("s"), e % 4).alias("source"), "value", "event_id", (20 + e % 50).alias("tokens"))


@query("wn02_final_dedup", f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, child ORDER BY rank) AS c FROM {RANKED}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, parent ORDER BY rank) AS p FROM a WHERE c = 1), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS place FROM b WHERE parent IS NULL OR p <= 2) SELECT user_id, event_id, place FROM e WHERE place <= 6")
def wn02(spark, d):
    return P.final_dedup(ranked(spark, d), "user_id", "child", "parent", 6, 2).select("user_id", "event_id", "place")


@query("wn04_backfill", f"""WITH r AS (SELECT *, rank <= user_id % 4 AS above FROM {RANKED}), u AS (SELECT *, sum(CASE WHEN above THEN tokens ELSE 0 END) OVER (PARTITION BY user_id) AS used, max(above::INT) OVER (PARTITION BY user_id) AS anyone, max(above::INT) OVER (PARTITION BY user_id, source) AS hit FROM r),
f AS (SELECT *, NOT above AND (anyone = 0 OR hit = 1) AS free FROM u), t AS (SELECT *, sum(free::INT) OVER w AS n, used + sum(CASE WHEN free THEN tokens ELSE 0 END) OVER w AS total FROM f WINDOW w AS (PARTITION BY user_id ORDER BY rank ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, NOT above AS below_threshold FROM t WHERE above OR (free AND used < 100 AND n <= 4 AND total <= 250)""")
def wn04(spark, d):
    return P.backfill(ranked(spark, d), "user_id", "source", F.col("rank") <= F.col("user_id") % 4, F.col("tokens"), 1000, 0.10, 0.25, 4).select("user_id", "event_id", "below_threshold")


@query("wn08_best_of_overlaps", """
WITH RECURSIVE s AS (SELECT user_id, event_type, event_id % 1000 AS lo, event_id % 1000 + 15 + event_id % 7 AS hi, value FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY lo, hi, value) AS rn FROM s),
f AS (
  SELECT user_id, event_type, rn, lo, hi, value, 1 AS seg FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.event_type, o.rn, CASE WHEN t THEN o.lo ELSE f.lo END, CASE WHEN t THEN o.hi ELSE f.hi END, CASE WHEN t THEN o.value ELSE f.value END, f.seg + CASE WHEN o.lo >= f.hi THEN 1 ELSE 0 END
  FROM f JOIN (SELECT * FROM o) o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.rn = f.rn + 1,
  LATERAL (SELECT o.lo >= f.hi OR o.value > f.value OR (o.value = f.value AND o.hi - o.lo > f.hi - f.lo) AS t))
SELECT user_id, event_type, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, seg ORDER BY rn DESC) AS k FROM f) WHERE k = 1""")
def wn08(spark, d):
    e = F.col("event_id")
    own = table(spark, d, "events").select("user_id", "event_type", (e % 1000).alias("lo"), (e % 1000 + 15 + e % 7).alias("hi"), "value")
    return P.best_of_overlaps(own, ["user_id", "event_type"], "lo", "hi", "value").select("user_id", "event_type", "lo", "hi")


@query("wn09_footnotes", "WITH f AS (SELECT user_id, event_id % 13 AS number, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, number, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS footnote FROM f")
def wn09(spark, d):
    own = table(spark, d, "events").select("user_id", (F.col("event_id") % 13).alias("number"), "event_id")
    return P.footnotes(own, ["user_id"], "number", "event_id").select("user_id", "number", "footnote")


@query("wn10_rank", f"SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM {RANKED}")
def wn10(spark, d):
    return ranked(spark, d).select("user_id", "event_id", "rank")


@query("wn12_person_winner", f"WITH c AS (SELECT source_id, canonical_name, count(*) AS n, len(string_split(canonical_name, ' ')) AS t, length(canonical_name) AS l FROM {MENTIONS} WHERE canonical_name <> '' GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY n DESC, t DESC, l DESC) AS k FROM c) SELECT source_id, min(canonical_name) AS winner FROM r WHERE k = 1 GROUP BY source_id HAVING count(*) = 1")
def wn12(spark, d):
    own = mentions(spark, d).where("canonical_name <> ''").groupBy("source_id", "canonical_name").agg(F.count(F.lit(1)).alias("n"))
    return P.unique_winner(own, ["source_id"], "canonical_name", "n")


@query("tk03_nlargest", f"SELECT user_id, event_id FROM {RANKED} WHERE rank <= 3")
def tk03(spark, d):
    return ranked(spark, d).where("rank <= 3").select("user_id", "event_id")


@query("tk04_rerank_cut", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY tokens DESC, rank) AS reranked FROM {RANKED} WHERE rank <= 30")
def tk04(spark, d):
    return ranked(spark, d).where("rank <= 30").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("tokens"), "rank")).alias("reranked"))


@query("tk07_longest_aliases", "WITH a AS (SELECT DISTINCT c_nationkey, c_name || repeat('x', CAST(c_custkey % 5 AS INTEGER)) AS alias FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(alias), alias) AS k FROM a) SELECT c_nationkey, alias FROM r WHERE k <= 10")
def tk07(spark, d):
    own = table(spark, d, "customer").select("c_nationkey", F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 5).cast("int"))).alias("alias")).distinct()
    return own.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.length("alias"), "alias"))).where("k <= 10").drop("k")


@query("tk08_alias_buckets", "SELECT c_mktsegment, array_to_string(list(c_custkey ORDER BY c_acctbal DESC, c_custkey), ',') AS places FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment")
def tk08(spark, d):
    own = table(spark, d, "customer").where("c_nationkey = 3")
    return own.groupBy("c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("p"), "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ",").alias("places"))


# --- names ----------------------------------------------------------------------------------

_TOKENS = """list_filter(list_transform(string_split_regex(trim(raw_name), '\\s+'), lambda t: regexp_replace(regexp_replace(t, '^[.,;:()\\[\\]{}"'']+', ''), '[.,;:()\\[\\]{}"'']+$', '')), lambda t: t <> '')"""
_TITLES = "[" + ", ".join(f"'{t}'" for t in N.TITLES) + "]"
_NAMED = f"(SELECT mention_id, raw_name, trim(regexp_replace(raw_name, '\\s+', ' ', 'g')) AS collapsed, CASE WHEN p > 0 THEN array_to_string(toks[p:], ' ') ELSE '' END AS stripped FROM (SELECT *, coalesce(list_position(list_transform(toks, lambda t: NOT list_contains({_TITLES}, lower(t))), true), 0) AS p FROM (SELECT *, {_TOKENS} AS toks FROM {MENTIONS})))"


@query("pe01_collapse_spaces", f"SELECT mention_id, collapsed FROM {_NAMED}")
def pe01(spark, d):
    return mentions(spark, d).select("mention_id", N.collapse_spaces(F.col("raw_name")).alias("collapsed"))


@query("pe02_clean_tokens", f"SELECT mention_id, array_to_string({_TOKENS}, '|') AS toks FROM {MENTIONS}")
def pe02(spark, d):
    own = F.filter(F.transform(F.split(N.collapse_spaces(F.col("raw_name")), " "), N.clean_token), lambda t: t != "")
    return mentions(spark, d).select("mention_id", F.array_join(own, "|").alias("toks"))


@query("pe04_normal_names", f"SELECT mention_id, stripped, lower(stripped) AS normal, regexp_extract(lower(stripped), '[^ ]*$') AS last, CASE WHEN stripped <> '' THEN stripped ELSE collapsed END AS display, 'mentioned' AS role FROM {_NAMED}")
def pe04(spark, d):
    raw = F.col("raw_name")
    return mentions(spark, d).select("mention_id", N.strip_titles(raw).alias("stripped"), N.normalize_name(raw).alias("normal"), N.last_token(N.normalize_name(raw)).alias("last"), N.display_form(raw).alias("display"), N.role_hint().alias("role"))


@query("pe05_better_display", f"SELECT mention_id, CASE WHEN (len(string_split(display, ' ')), length(display)) > (len(list_filter(string_split(canonical_name, ' '), lambda t: t <> '')), length(canonical_name)) THEN display ELSE canonical_name END AS name FROM (SELECT mention_id, CASE WHEN stripped <> '' THEN stripped ELSE collapsed END AS display FROM {_NAMED}) JOIN {MENTIONS} USING (mention_id)")
def pe05(spark, d):
    return mentions(spark, d).select("mention_id", N.better_display(F.col("canonical_name"), N.display_form(F.col("raw_name"))).alias("name"))


@query("pe15_best_canonical", f"WITH v AS (SELECT DISTINCT canonical_name, raw_name AS name FROM {MENTIONS} WHERE trim(raw_name) <> '' AND trim(canonical_name) <> ''), b AS (SELECT canonical_name, arg_max(name, (len(list_filter(string_split_regex(name, '\\s+'), lambda t: t <> '')), length(name), name)) AS best FROM v GROUP BY 1) SELECT canonical_name, CASE WHEN (len(list_filter(string_split_regex(best, '\\s+'), lambda t: t <> '')), length(best)) > (len(string_split(canonical_name, ' ')), length(canonical_name)) THEN best ELSE canonical_name END AS display FROM b")
def pe15(spark, d):
    return P.registry(mentions(spark, d)).select("canonical_name", "display")
