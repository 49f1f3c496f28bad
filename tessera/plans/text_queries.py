"""Queries over texts: chunking, markers, citations, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.registry import query
from tessera.session import table

#: DuckDB forms shared by several oracles.
SQL_TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"
SQL_ACCENTS = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü', 'ACEEEINOOUaceeeinoou')"


def docs(spark, d):
    return table(spark, d, "documents")


@query("ch03_token_windows", f"""
WITH t AS (SELECT doc_id, {SQL_TOKENS} AS toks FROM documents),
s AS (SELECT doc_id, toks, len(toks) AS n, CASE WHEN len(toks) <= 1200 THEN 0 ELSE CAST(ceil((len(toks) - 1200) / 1050.0) AS BIGINT) END AS last FROM t WHERE len(toks) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS window_no, array_to_string(toks[i * 1050 + 1 : i * 1050 + 1200], ' ') AS chunk FROM s, unnest(generate_series(0, last)) AS g(i)""")
def ch03(spark, d):
    own = docs(spark, d).select("doc_id", "text", T.tokens(F.col("text")).alias("own"))
    return own.select("doc_id", F.posexplode(T.token_windows(F.col("text"), 1200, 150, F.col("own"))).alias("window_no", "chunk"))


@query("ch01_parent_chunks", f"""
WITH t AS (SELECT doc_id, {SQL_TOKENS} AS toks FROM documents),
s AS (SELECT doc_id, toks, len(toks) AS n, CASE WHEN len(toks) <= 1200 THEN 0 ELSE CAST(ceil((len(toks) - 1200) / 1050.0) AS BIGINT) END AS last FROM t WHERE len(toks) > 0),
w AS (SELECT doc_id, n, last, i, n - last * 1050 AS tail, array_to_string(toks[i * 1050 + 1 : i * 1050 + 1200], ' ') AS part, array_to_string(toks, ' ') AS whole FROM s, unnest(generate_series(0, last)) AS g(i))
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CASE WHEN n <= 1500 THEN whole WHEN tail < 1000 AND last > 0 AND i = last - 1 THEN part || ' ' || (SELECT part FROM w x WHERE x.doc_id = w.doc_id AND x.i = w.last) ELSE part END AS chunk
FROM w WHERE (n <= 1500 AND i = 0) OR (n > 1500 AND NOT (tail < 1000 AND last > 0 AND i = last))""")
def ch01(spark, d):
    own = docs(spark, d).select("doc_id", "text", T.tokens(F.col("text")).alias("own"))
    return own.select("doc_id", F.posexplode(T.parent_windows(F.col("text"), own=F.col("own"))).alias("chunk_no", "chunk"))


@query("ch02_child_chunks")
def ch02(spark, d):
    """Sentences of parents packed into children: a fold that SQL states poorly; tests hold it against a loop."""
    parents = docs(spark, d).select("doc_id", F.posexplode(T.parent_windows(F.col("text"))).alias("parent_no", "parent"))
    return parents.select("doc_id", "parent_no", F.posexplode(T.pack_units(T.sentences(F.col("parent")))).alias("child_no", "child"))


@query("ch04_sentences", """
SELECT doc_id, len(s) AS sentences, s[1] AS first, s[-1] AS last FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""")
def ch04(spark, d):
    own = docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("sentences"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"))


@query("ch06_markdown_sections", """
WITH l AS (SELECT doc_id, i, CASE WHEN i = 1 THEN '# ' || line WHEN i % 5 = 0 THEN '## ' || line ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^# ') THEN 1 WHEN regexp_matches(line, '^## ') THEN 2 END AS level FROM l),
s AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS section, last_value(CASE WHEN level = 1 THEN trim(line[3:]) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS h1, CASE WHEN level = 2 THEN trim(line[4:]) END AS own2 FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, min(h1) || CASE WHEN max(own2) IS NULL THEN '' ELSE ' > ' || max(own2) END AS path, string_agg(line, chr(10) ORDER BY i) AS body FROM s GROUP BY doc_id, section""")
def ch06(spark, d):
    """Header paths of texts whose first line is made a header and every fifth a lower one."""
    from tessera.sources.markdown import sections

    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    made = lines.select("doc_id", "i", F.when(F.col("i") == 0, F.concat(F.lit("# "), "line")).when((F.col("i") + 1) % 5 == 0, F.concat(F.lit("## "), "line")).otherwise(F.col("line")).alias("line"))
    return sections(made, "doc_id", "i", "line")


@query("ch08_ocr_cleanup", """
SELECT doc_id, regexp_replace(broken, '([A-Za-z])-[\\t\\r\\n ]+([A-Za-z])', '\\1\\2', 'g') AS cleaned FROM (SELECT doc_id, regexp_replace(text, '([a-z]{4})([a-z]{4})', '\\1-' || chr(10) || ' \\2', 'g') AS broken FROM documents)""")
def ch08(spark, d):
    broken = F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n $2")
    return docs(spark, d).select("doc_id", T.clean_ocr(broken).alias("cleaned"))


@query("ch09_page_range", """
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(marked, '(?i)\\[page\\s+(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x >= 1) AS pages FROM (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '[Page ' || (i - 1 + doc_id % 3) || '] ' || x), chr(10)) AS marked FROM documents))
SELECT doc_id, pages[1] AS first_page, pages[-1] AS last_page, len(pages) AS marks FROM p""")
def ch09(spark, d):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[Page "), (i + F.col("doc_id") % 3).cast("string"), F.lit("] "), x)), "\n")
    own = docs(spark, d).select("doc_id", marked.alias("m"))
    first, last = T.marker_range(F.col("m"))
    return own.select("doc_id", first.alias("first_page"), last.alias("last_page"), F.size(T.page_markers(F.col("m"))).cast("long").alias("marks"))


@query("ch10_sample_context", """
SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE text[1:300] || chr(10) || '...' || chr(10) || substring(text, length(text) // 2 - 150 + 1, 300) || chr(10) || '...' || chr(10) || substring(text, length(text) - 299, 300) END AS sample FROM documents""")
def ch10(spark, d):
    return docs(spark, d).select("doc_id", T.sample_context(F.col("text"), 900).alias("sample"))


@query("ch11_context_snippet", """
SELECT doc_id, trim(regexp_replace(substring(text, greatest(0, length(text) // 2 - 120) + 1, length(text) // 2 + 10 + 120 - greatest(0, length(text) // 2 - 120)), '\\s+', ' ', 'g')) AS snippet FROM documents""")
def ch11(spark, d):
    at = F.floor(F.length("text") / 2).cast("int")
    return docs(spark, d).select("doc_id", T.snippet(F.col("text"), at, at + 10).alias("snippet"))


@query("ch13_token_estimate", f"SELECT doc_id, greatest(1, CAST(floor(len({SQL_TOKENS}) * 1.6) AS BIGINT), CAST(floor(length(text) / 3.2) AS BIGINT)) AS tokens FROM documents")
def ch13(spark, d):
    return docs(spark, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("ch16_page_markers_format", "SELECT doc_id, '[Page ' || greatest(1, doc_id - 5) || ']' AS marker FROM documents")
def ch16(spark, d):
    return docs(spark, d).select("doc_id", T.page_marker(F.col("doc_id") - 5).alias("marker"))


@query("ch18_token_count", f"SELECT doc_id, CAST(len({SQL_TOKENS}) AS INTEGER) AS tokens FROM documents")
def ch18(spark, d):
    return docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("st01_passage_blocks", """
SELECT doc_id, '[PASSAGE ' || (doc_id % 10 + 1) || ']' || chr(10) || '[Source: ' || source || ' | Page ' || (CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50) || '-' || (doc_id % 50 + 2) ELSE CAST(doc_id % 50 AS VARCHAR) END) || ' | Chunk ' || doc_id || ']' || chr(10) || text AS block FROM documents""")
def st01(spark, d):
    page = (F.col("doc_id") % 50).cast("string")
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(page, F.lit("-"), (F.col("doc_id") % 50 + 2).cast("string"))).otherwise(page)
    return docs(spark, d).select("doc_id", F.concat(F.lit("[PASSAGE "), (F.col("doc_id") % 10 + 1).cast("string"), F.lit("]\n[Source: "), "source", F.lit(" | Page "), label, F.lit(" | Chunk "), F.col("doc_id").cast("string"), F.lit("]\n"), "text").alias("block"))


@query("st10_token_fallback", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def st10(spark, d):
    return docs(spark, d).select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("tokens"))


@query("st12_stop_and_thinking", """
SELECT doc_id, split_part(regexp_replace(marked, '(?s)<think>.*?</think>', '', 'g'), '<|end|>', 1) AS shown FROM (
  SELECT doc_id, '<think>' || substring(text, 1, 20) || '</think>' || substring(text, 21) || '<|end|>' || substring(text, 1, 9) AS marked FROM documents)""")
def st12(spark, d):
    marked = F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.lit("</think>"), F.expr("substring(text, 21)"), F.lit("<|end|>"), F.substring("text", 1, 9))
    return docs(spark, d).select("doc_id", F.substring_index(T.strip_blocks(marked, "<think>", "</think>"), "<|end|>", 1).alias("shown"))


_FILE = "'up/' || lang || ' ä-' || source || '__(' || doc_id || ').v2.pdf'"


@query("st18_source_id", f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FILE}, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1'), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_+', '_', 'g'), '_')[1:120] AS source_id FROM documents")
def st18(spark, d):
    name = F.concat(F.lit("up/"), "lang", F.lit(" ä-"), "source", F.lit("__("), F.col("doc_id"), F.lit(").v2.pdf"))
    return table(spark, d, "documents").select("doc_id", T.source_id(name).alias("source_id"))


@query("sk17_snapshot_name", "SELECT doc_id, CASE WHEN regexp_matches(name, '^[A-Za-z0-9._-]+$') AND length(name) <= 200 THEN name ELSE sha256(name)[1:16] END AS file_name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.' || doc_id ELSE text END AS name FROM documents)")
def sk17(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("."), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", T.safe_file_name(name).alias("file_name"))


@query("st20_format_of_extension", "SELECT page_id, CASE lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'pdf' THEN 'pdf' ELSE 'unknown' END AS format FROM pages")
def st20(spark, d):
    from tessera.sources.files import format_of

    return table(spark, d, "pages").select("page_id", format_of(F.substring_index(F.substring_index("url", "#", 1), "?", 1)).alias("format"))


@query("st23_citation_marks", """
SELECT doc_id, array_to_string(regexp_extract_all(replace(text, '. ', '. [' || doc_id % 7 || ', p. ' || n_chars % 90 || '] [x] [' || doc_id % 5 || '] '), '\\[(\\d+)(?:,\\s*p\\.\\s*\\d+)?\\]', 1), ',') AS marks FROM documents""")
def st23(spark, d):
    """Marks after each sentence of the documents."""
    n = lambda c, k: (F.col(c) % k).cast("string")
    mark = F.concat(F.lit(". ["), n("doc_id", 7), F.lit(", p. "), n("n_chars", 90), F.lit("] [x] ["), n("doc_id", 5), F.lit("] "))
    said = F.replace("text", F.lit(". "), mark)
    return table(spark, d, "documents").select("doc_id", F.array_join(T.citation_marks(said).cast("array<string>"), ",").alias("marks"))


@query("st27_relative_date", """
SELECT event_id, CASE WHEN k <= 0 THEN 'today' WHEN k = 1 THEN 'yesterday' WHEN k < 7 THEN 'this week' WHEN k < 30 THEN 'this month' ELSE 'older' END AS bucket FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS k FROM events)""")
def st27(spark, d):
    k = F.datediff(F.lit("2024-01-30").cast("date"), F.col("ts").cast("date"))
    return table(spark, d, "events").select("event_id", F.when(k <= 0, "today").when(k == 1, "yesterday").when(k < 7, "this week").when(k < 30, "this month").otherwise("older").alias("bucket"))


@query("st28_session_title", """
SELECT conv_id, CASE WHEN length(text) > 57 THEN substring(text, 1, 57) || '…' ELSE text END AS title FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') WHERE k = 1""")
def st28(spark, d):
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.session_title(F.col("text")).alias("title"))


@query("sm07_freeform_roles", "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def sm07(spark, d):
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select("conv_id", "turn", "role", "text")


@query("pf23_session_search", "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'thing')")
def pf23(spark, d):
    return table(spark, d, "conversations").where(F.lower("text").contains("thing")).select("conv_id").distinct()


@query("pf13_mostly_lower", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN false ELSE length(regexp_replace(text, '[^A-Z]', '', 'g')) < 0.1 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) END AS lower_case FROM documents")
def pf13(spark, d):
    letters, upper = F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", "[^A-Z]", ""))
    return docs(spark, d).select("doc_id", F.when(letters == 0, False).otherwise(upper < 0.1 * letters).alias("lower_case"))


@query("pf20_repeated_trigrams", f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '') AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS gram FROM t, unnest(generate_series(1, len(w) - 2)) AS s(i) WHERE len(w) >= 3)
SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM g GROUP BY doc_id, gram HAVING count(*) >= 3) AS repeats FROM documents d""")
def pf20(spark, d):
    from tessera.operators.rollups import repeating

    return repeating(docs(spark, d).select("doc_id", "text"), "doc_id", 3, 3).select("doc_id", "repeats")


@query("ge09_trigrams", """
SELECT p_partkey, list_sort(list_distinct(list_transform(generate_series(1, length(p_name) + 2), lambda i: substring('  ' || p_name || '  ', i, 3))))[1] AS least, len(list_distinct(list_transform(generate_series(1, length(p_name) + 2), lambda i: substring('  ' || p_name || '  ', i, 3)))) AS n FROM part""")
def ge09(spark, d):
    own = table(spark, d, "part").select("p_partkey", T.trigrams(F.col("p_name")).alias("g"))
    return own.select("p_partkey", F.array_min("g").alias("least"), F.size("g").cast("long").alias("n"))


@query("ge08_place_normalisation", f"SELECT doc_id, regexp_replace(lower({SQL_ACCENTS.format('trim(regexp_replace(' + chr(39) + ' The ' + chr(39) + ' || text, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '))')}), '^the ', '') AS place FROM documents")
def ge08(spark, d):
    return docs(spark, d).select("doc_id", T.normal_place(F.concat(F.lit(" The "), F.col("text"))).alias("place"))


@query("pe03_names", "SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS name, lower(c_mktsegment) AS last FROM customer")
def pe03(spark, d):
    """Titles and signs go, whatever stands before a name."""
    from tessera.functions import names as N

    said = F.concat(F.when(F.col("c_custkey") % 3 == 0, " Dr. prof. ").when(F.col("c_custkey") % 3 == 1, "Rev  Capt. ").otherwise(""), "c_name", F.lit(",  ("), "c_mktsegment", F.lit(")"))
    own = table(spark, d, "customer").select("c_custkey", N.normalize_name(said).alias("name"))
    return own.select("c_custkey", "name", N.last_token(F.col("name")).alias("last"))
