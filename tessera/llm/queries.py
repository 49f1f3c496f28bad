"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

from . import chat_format, decontaminate, hard_negatives, lexical_search, licenses, lm_score, media, near_dup, packing, secrets, substring_dedup, toxicity, url_filter

#: The rules that op8 judges by.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def held_out(doc_id="doc_id"):
    """The rows whose labels must not be learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"), usable=~held_out())
    scored = toxicity.score_toxicity(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lm_score.score(documents, lm_score.train(documents))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), secrets.train_markov(secrets.default_samples(spark)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest_conversations(chat_format.format_turns(rows))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), [url_filter.parse_rule(v, t) for v, t in URL_RULES])


def _url_sql() -> str:
    values = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '{''.join(t.partition('/')[1:])}')" for v, t in URL_RULES)
    return f"""
WITH rules(verdict, rule, host, path) AS (VALUES {values}),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT p.n, r.rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host) DESC, length(r.path) DESC, r.verdict DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1"""


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The same rules over words that have two blanks between them, so that each match can hold one on either side."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ",\n  ".join(f"({n}, {quoted(r.keyword)}, {r.level}, {quoted(r.label)}, {quoted(' (?:' + r.pattern.replace(' ', '  ') + ') ')}, {str(licenses.BASE.get(r.pattern) == r.label).lower()})" for n, r in enumerate(licenses.read_rules()))
    size = lambda x: f"len(list_filter(string_split({x}, ' '), lambda y: y <> ''))"
    return rf"""
WITH rules(n, keyword, level, label, pattern, base) AS (VALUES
  {rules}),
texts AS (
  SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS words
  FROM documents),
hits AS (
  SELECT r, n, level, label, base, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS found
  FROM (SELECT r, words, ' ' || replace(words, ' ', '  ') || ' ' AS t FROM texts) JOIN rules ON contains(words, keyword) AND regexp_matches(t, pattern)),
placed AS (SELECT r, n, level, label, base, list_transform(gaps, lambda x: {size("x")}) AS gaps, list_transform(found, lambda x: {size("x")}) AS sizes, unnest(range(1, len(found) + 1)) AS i FROM hits),
spans AS (SELECT r, n, level, label, base, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS s, CAST(list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS BIGINT) AS e FROM placed),
kept AS (
  SELECT * FROM spans a WHERE NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.r = a.r AND b.s <= a.s AND b.e >= a.e AND (b.level < a.level OR b.level = a.level AND (b.e - b.s > a.e - a.s OR b.e = a.e AND b.n < a.n)))),
based AS (SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spans WHERE base GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM spans WHERE base) GROUP BY r),
scored AS (SELECT r, max(CASE level WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.4 END) AS score, string_agg(label || ':' || s || ':' || e, ',' ORDER BY s, e DESC, level, n) AS spans FROM kept GROUP BY r)
SELECT doc_id, CAST({size("words")} AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(spans, '') AS spans
FROM texts LEFT JOIN based USING (r) LEFT JOIN named USING (r) LEFT JOIN scored USING (r)"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_LEXICAL_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS own FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
total AS (SELECT count(*) FILTER (len(own) > 0) AS n_docs, CAST(sum(len(own)) AS BIGINT) AS n_terms FROM docs),
post AS (SELECT doc_id, len(own) AS n, term, count(*) AS tf FROM (SELECT doc_id, own, unnest(own) AS term FROM docs) GROUP BY doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN post USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0) WHERE k <= 10"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=moved, every=100, share=80)


_NEGATIVES_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM pairs WHERE same) WHERE k <= 5),
bands AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS k
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM bands WHERE k <= 5"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_media, op3_chat_format, op4_decontaminate, op5_secrets, op6_substring_dedup, op7_near_dup, op8_url_filter, op9_packing, op10_lm_score, op11_licenses, op12_lexical_search, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _url_sql(), "op11_licenses": _license_sql(), "op12_lexical_search": _LEXICAL_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
