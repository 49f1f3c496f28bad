"""Queries of the retrieval flow: scoring, fusion, cuts, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import search as S
from tessera.registry import query
from tessera.session import table

SQL_BM25 = """
own AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {table}),
dl AS (SELECT {key}, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM {table}),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT {key}, term, count(*) AS tf FROM own GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT item_id, p.{key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post p JOIN asked USING (term) JOIN df USING (term) JOIN dl ON dl.{key} = p.{key}, stats GROUP BY item_id, p.{key})"""
DOC_BM25 = SQL_BM25.format(key="doc_id", table="documents")
SQL_DIST = "1 / (1 + sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: power(q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE, 2)))))"
SQL_DENSE = f"""
dense AS (SELECT q.vec_id AS query_id, v.vec_id, round({SQL_DIST}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense)"""


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def bench(spark, d):
    return table(spark, d, "benchmark").select("item_id", "text")


def lexical(spark, d, k, only=None):
    return S.bm25_topk(docs(spark, d), bench(spark, d) if only is None else _bound(spark, d), "doc_id", "item_id", k, only=only)


def _bound(spark, d):
    """The items with their vectors, that of the same number; odd ones are bound to one source."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    source = F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return bench(spark, d).join(vectors, "item_id", "left").withColumn("only_source", source)


def doc_vectors(spark, d):
    """The documents that have a vector, with it."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")


def dense(spark, d, k, only=None, **how):
    return S.vector_topk(doc_vectors(spark, d), _bound(spark, d), k, "doc_id", query_key="item_id", only=only, **how)


@query("ag17_term_statistics", """
WITH own AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM own GROUP BY term""")
def ag17(spark, d):
    return R.postings(docs(spark, d), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("rk03_bm25", f"WITH {DOC_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM bm) WHERE k <= 10")
def rk03(spark, d):
    return lexical(spark, d, 10).select("item_id", "doc_id", "score")


def _query_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("tk01_vector_topk", f"WITH {SQL_DENSE} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def tk01(spark, d):
    return S.vector_topk(table(spark, d, "embeddings").select("vec_id", "embedding"), _query_vectors(spark, d), 10)


@query("rk13_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def rk13(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", R.normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(R.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


SQL_BOTH = f"""
{DOC_BM25},
iq AS (SELECT b.item_id, b.item_id % 2 = 1 AS bound, 'src' || (b.item_id % 20) AS only_source, e.embedding FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
iv AS (SELECT d.doc_id, d.source, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
near AS (SELECT item_id, doc_id, bound, v.source = only_source AS own, {SQL_DIST} AS gap FROM iq q, iv v WHERE q.embedding IS NOT NULL),
word AS (SELECT bm.item_id, bm.doc_id, bound, d.source = only_source AS own, round(score, 6) AS score FROM bm JOIN iq USING (item_id) JOIN documents d USING (doc_id))"""


def _sql_lists(rows: str) -> str:
    """The two ranked lists of some rows."""
    return f"""
dn AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, round(gap, 6) AS score FROM near) WHERE {rows}),
lx AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM word WHERE {rows})"""


SQL_RRF = "SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM dn WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank FROM lx WHERE rank <= 50) GROUP BY item_id, doc_id"


def _sql_first(k: int, scored: str = SQL_RRF) -> str:
    return f" SELECT item_id, doc_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM ({scored})) WHERE k <= {k}"


@query("rk04_rrf", f"WITH {SQL_BOTH}, {_sql_lists('true')}" + _sql_first(20))
def rk04(spark, d):
    return S.hybrid(dense(spark, d, 50), lexical(spark, d, 50), "item_id", "doc_id", 20)


@query("rk05_linear", f"""
WITH {SQL_BOTH}, {_sql_lists("true")},
ds AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM dn WHERE rank <= 50 WINDOW w AS (PARTITION BY item_id)),
ls AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM lx WHERE rank <= 50 WINDOW w AS (PARTITION BY item_id))"""
+ _sql_first(20, "SELECT item_id, doc_id, round(coalesce(ds.s, 0) * 0.7 + coalesce(ls.s, 0) * 0.3, 6) AS score FROM ds FULL OUTER JOIN ls USING (item_id, doc_id)"))
def rk05(spark, d):
    return S.hybrid(dense(spark, d, 50), lexical(spark, d, 50), "item_id", "doc_id", 20, 0.3)


@query("tk02_hybrid", f"WITH {SQL_BOTH}, {_sql_lists('NOT bound OR own')}" + _sql_first(10))
def tk02(spark, d):
    """Both lists, of one source where an item is bound to it, before anything is ranked; every cell is searched."""
    only = ("source", "only_source")
    return S.search(_bound(spark, d), "item_id", "doc_id", 10, depth=50, dense=lambda q, k: dense(spark, d, k, only), lexical=lambda q, k: lexical(spark, d, k, only))


def probed(spark, d, k, cells=32, probes=20):
    """The dense list by the inverted file: of each item the nearest 20 of 32 cells."""
    rows = doc_vectors(spark, d)
    fitted = S.Cells.fit(table(spark, d, "embeddings"), cells=cells)
    return S.vector_topk(fitted.assign(rows), _bound(spark, d), k, "doc_id", query_key="item_id", cells=fitted, probes=probes)


@query("tk02_probed")
def tk02_probed(spark, d):
    """As tk02_hybrid without sources, by the inverted file; the tests measure its recall."""
    return S.search(_bound(spark, d), "item_id", "doc_id", 10, depth=50, dense=lambda q, k: probed(spark, d, k), lexical=lambda q, k: lexical(spark, d, k))


@query("rk02_dispatch", f"WITH {SQL_BOTH}, {_sql_lists('true')} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dn WHERE rank <= 10")
def rk02(spark, d):
    """With the hybrid switched off, the dispatcher gives the dense list."""
    return S.search(_bound(spark, d), "item_id", "doc_id", 10, use_hybrid=False, dense=lambda q, k: dense(spark, d, k), lexical=lambda q, k: lexical(spark, d, k))


def _hits(spark, d, k=50):
    ranked = S.search(_bound(spark, d), "item_id", "doc_id", k, dense=lambda q, n: dense(spark, d, n), lexical=lambda q, n: lexical(spark, d, n)).select("item_id", "doc_id")
    texts = docs(spark, d).select("doc_id", F.col("text").alias("passage"), "source")
    asked = bench(spark, d).withColumnRenamed("text", "question")
    both = texts.join(F.broadcast(ranked.join(asked, "item_id")), "doc_id") if _few(spark, d, k) else ranked.join(asked, "item_id").join(texts, "doc_id")
    # whole numbers first, so that both engines divide alike; the texts end here, and only those that are shown are joined again
    scored = both.select("item_id", "doc_id", "source", R.expected_tokens(F.col("passage")).alias("tokens"), F.round(R.overlap_score(F.col("question"), F.col("passage")), 6).alias("score"))
    return R.rank(scored, "item_id", "doc_id")


#: Hits that are sent to the documents instead of shuffling these.
MAX_SENT = 100_000


def _few(spark, d, k):
    return bench(spark, d).count() * k <= MAX_SENT


def _shown(spark, d, rows):
    """rows with the texts of their documents."""
    return rows.join(docs(spark, d).select("doc_id", F.col("text").alias("passage")), "doc_id")


SQL_HITS = f"""
WITH {SQL_BOTH}, {_sql_lists("true")}, top AS (SELECT item_id, doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM ({SQL_RRF}))),
pairs AS (SELECT t.item_id, t.doc_id, d.source, d.text AS passage, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda x: x <> '')) AS q, string_split_regex(lower(d.text), '\\s+') AS p FROM top t JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE k <= 50),
scored AS (SELECT item_id, doc_id, source, passage, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, list_distinct(p))) / len(q)::DOUBLE END, 6) AS score FROM pairs),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""
SQL_KEPT = SQL_HITS + """, lim AS (SELECT *, greatest(0.05, 0.15 * max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY item_id)) AS cut FROM hits),
cnt AS (SELECT *, count(*) FILTER (score >= cut) OVER (PARTITION BY item_id) AS n FROM lim),
kept AS (SELECT item_id, doc_id, source, passage, score, rank, score < cut AS below_threshold FROM cnt WHERE CASE WHEN n < 3 THEN rank <= 3 ELSE score >= cut END)"""
SQL_FINAL = SQL_KEPT + """, per AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS m FROM kept),
fin AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM per WHERE m <= 2)"""


@query("rk07_rerank", SQL_HITS + " SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 30")
def rk07(spark, d):
    return _hits(spark, d).where("rank <= 30").select("item_id", "doc_id", "score", "rank")


@query("pf09_threshold", SQL_KEPT + " SELECT item_id, doc_id, score, below_threshold FROM kept")
def pf09(spark, d):
    return R.threshold(_hits(spark, d), "item_id", 0.05, 3).select("item_id", "doc_id", "score", "below_threshold")


def _final(spark, d, k):
    kept = R.threshold(_hits(spark, d), "item_id", 0.05, 3)
    per = R.top_per_parent(kept, "source", 2, ["rank"], "item_id")
    from pyspark.sql import Window

    return per.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).where(F.col("place") <= k)


@query("rk14_search", SQL_FINAL + " SELECT item_id, CAST(place AS INTEGER) AS place, doc_id, source, score, below_threshold, '[PASSAGE ' || place || ']' || chr(10) || passage AS block FROM fin WHERE place <= 5")
def rk14(spark, d):
    """The whole flow: vectors and BM25 fused, rerank, threshold, two per source, five in all, with their texts."""
    return _shown(spark, d, _final(spark, d, 5)).select("item_id", "place", "doc_id", "source", "score", "below_threshold", F.concat(F.lit("[PASSAGE "), F.col("place").cast("string"), F.lit("]\n"), "passage").alias("block"))


@query("ag06_context", SQL_FINAL + " SELECT item_id, string_agg(passage, chr(10) || chr(10) ORDER BY place) AS joined FROM fin WHERE place <= 5 GROUP BY item_id")
def ag06(spark, d):
    from tessera.operators.rollups import ordered_text

    return ordered_text(_shown(spark, d, _final(spark, d, 5)), ["item_id"], "place", F.col("passage"))


@query("wn03_budget_expansion", SQL_HITS + """, tk AS (SELECT item_id, doc_id, rank, CAST(floor(len(list_filter(string_split_regex(passage, '\\s+'), lambda t: t <> '')) * 1.35) AS BIGINT) AS tokens FROM hits),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY item_id ORDER BY rank) AS total, sum(CASE WHEN rank <= 5 THEN tokens ELSE 0 END) OVER (PARTITION BY item_id) AS base FROM tk),
ov AS (SELECT *, max(CASE WHEN rank > 5 AND total > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY rank) AS o FROM run)
SELECT item_id, doc_id, tokens, CAST(total AS BIGINT) AS total FROM ov WHERE rank <= 5 OR (base < 2000 AND o = 0)""")
def wn03(spark, d):
    return R.expand_to_budget(_hits(spark, d), "item_id", F.col("tokens"), 5, 8000).select("item_id", "doc_id", "tokens", "total")


@query("wn05_pack_prefix", "WITH r AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS tokens, sum(CAST(trunc(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS total FROM lineitem) SELECT l_orderkey, l_linenumber, tokens, CAST(total AS BIGINT) AS total FROM r WHERE total <= 100")
def wn05p(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(w))
    return R.pack_prefix(own, "l_orderkey", F.col("l_quantity").cast("long"), 100).select("l_orderkey", "l_linenumber", "tokens", "total")


@query("wn05_pack_greedy")
def wn05(spark, d):
    """Greedy packing with skips and cuts; a fold, held against a loop in the tests."""
    own = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), "l_partkey", "l_quantity")
    return R.pack_greedy(own, "l_orderkey", "l_partkey", F.col("l_quantity"), 100)


@query("wn01_top_per_parent", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def wn01(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return R.top_per_parent(own, "l_orderkey", 2, [F.desc("l_extendedprice"), "l_linenumber"]).drop("in_parent")


@query("jn01_context_expansion", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, o.o_orderpriority FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45")
def jn01(spark, d):
    hits = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return hits.join(parents, "l_orderkey", "left")


@query("tk05_paging", "SELECT event_id, user_id, value FROM events WHERE value >= 0.5 ORDER BY value DESC, event_id LIMIT 50 OFFSET 100")
def tk05(spark, d):
    from tessera.operators.tables import mentions

    own = table(spark, d, "events").select("event_id", "user_id", "value")
    return mentions(own, min_confidence=0.5, confidence_col="value", order=[F.desc("value"), "event_id"], limit=50, offset=100)
