"""Queries over prompts, model output, transcripts, signals and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.functions import prompts as O
from tessera.functions import text as T
from tessera.registry import query
from tessera.session import table



@query("ch07_tokens", "SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS t FROM documents)")
def ch07(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("ch17_marker_list", "SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: '[Page ' || ((doc_id + i - 1) % 5) || ']' || chr(10) || l), chr(10)), '(?i)\\[Page\\s+(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x >= 1), ',') AS pages FROM documents")
def ch17(spark, d):
    """Pages of documents whose lines have marks, some of them of page 0."""
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l, i: F.concat(F.lit("[Page "), ((F.col("doc_id") + i) % 5).cast("string"), F.lit("]\n"), l)), "\n")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(T.page_markers(text), lambda p: p.cast("string")), ",").alias("pages"))


@query("wn11_running_sections", "WITH f AS (SELECT user_id, event_id, event_id % 5 = 0 AS head, CASE WHEN event_id % 5 = 0 THEN event_type END AS title FROM events) SELECT user_id, event_id, CAST(sum(head::INT) OVER w AS BIGINT) AS section, last_value(title IGNORE NULLS) OVER w AS title FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def wn11(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("event_id") % 5 == 0
    return table(spark, d, "events").select("user_id", "event_id", F.sum(head.cast("int")).over(w).alias("section"), F.last(F.when(head, F.col("event_type")), ignorenulls=True).over(w).alias("title"))


@query("rk09_cut_documents", "SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')[:384], ' ')) AS digest FROM documents")
def rk09(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(O.cut_tokens(F.col("text")), 256).alias("digest"))


@query("rk10_prompt_tokens", "SELECT l_orderkey, 300 + 25 * count(*) + CAST(sum(trunc(l_quantity)) AS BIGINT) + 12 AS tokens FROM lineitem GROUP BY l_orderkey")
def rk10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(O.prompt_tokens(F.count(F.lit(1)), F.sum(F.col("l_quantity").cast("long")), F.lit(12)).alias("tokens"))


@query("rk11_fitting_prefix", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS k, sum(25 + CAST(trunc(l_quantity) AS BIGINT)) OVER w AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, l_linenumber, k FROM r WHERE 312 + total <= 480")
def rk11(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("k"), F.sum(F.col("l_quantity").cast("long")).over(w).alias("total"))
    return own.where(O.prompt_tokens(F.col("k"), F.col("total"), F.lit(12)) <= 480).select("l_orderkey", "l_linenumber", F.col("k"))


@query("rk12_to_encode", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[empty]' ELSE event_type END AS text FROM events")
def rk12(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, " \n ")).otherwise(F.concat(F.lit(" \n"), "event_type", F.lit("\t ")))
    return table(spark, d, "events").select("event_id", O.to_encode(said).alias("text"))


@query("rk23_instruction", "SELECT event_id, 'Instruct: find passages' || chr(10) || 'Query:' || event_type AS text FROM events")
def rk23(spark, d):
    return table(spark, d, "events").select("event_id", O.to_encode(F.col("event_type"), "find passages").alias("text"))


@query("st03_source_legend", "SELECT n_regionkey, 'SOURCE LEGEND:' || chr(10) || string_agg('- s' || n_nationkey || ' → ' || n_name, chr(10) ORDER BY 's' || n_nationkey) AS legend FROM nation GROUP BY n_regionkey")
def st03(spark, d):
    pairs = F.collect_list(F.struct(F.concat(F.lit("s"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(O.source_legend(pairs).alias("legend"))


@query("st05_renumbered_blocks", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[PASSAGE ' || user_id || '] ' || event_type || ' [PASSAGE 3]' ELSE 'x [PASSAGE 1]' END AS block FROM events")
def st05(spark, d):
    block = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[PASSAGE  9] "), "event_type", F.lit(" [PASSAGE 3]"))).otherwise("x [PASSAGE 1]")
    return table(spark, d, "events").select("event_id", O.renumber_block(block, F.col("user_id")).alias("block"))


@query("st21_server_events", "SELECT event_id, 'data: {\"type\":\"' || event_type || '\",\"id\":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events")
def st21(spark, d):
    return table(spark, d, "events").select("event_id", O.server_event(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")))).alias("frame"))


@query("st22_parsed_events", "SELECT event_id, event_type AS kind, user_id AS number FROM events")
def st22(spark, d):
    frame = O.server_event(F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("number"))))
    own = table(spark, d, "events").select("event_id", F.from_json(F.regexp_extract(frame, r"^data: (.*)\n\n$", 1), "kind string, number long").alias("e"))
    return own.select("event_id", "e.kind", "e.number")


@query("st24_footnote_list", "SELECT l_orderkey, string_agg(k || '. part ' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN ', p.' || l_linenumber ELSE '' END || '.', chr(10) ORDER BY k) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY l_orderkey")
def st24(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = table(spark, d, "lineitem").withColumn("k", F.row_number().over(w))
    note = O.footnote(F.col("k"), F.concat(F.lit("part "), "l_partkey"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")))
    return own.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", note.alias("t")))), lambda x: x["t"]), "\n").alias("notes"))


@query("st25_best_match", "WITH n AS (SELECT doc_id, lower(text) AS hay, lower(CASE WHEN doc_id % 2 = 0 THEN substring(text, 40, 30) ELSE substring(text, 40, 25) || ' zz nothing' END) AS needle FROM documents WHERE length(text) >= 80), p AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(needle) - 20, 0) + 1), lambda c: instr(hay, substring(needle, 1, length(needle) - c))), lambda x: x > 0) AS places FROM n) SELECT doc_id, coalesce(places[1], 0) AS place FROM p")
def st25(spark, d):
    """A part of each document found in it, every second one by its beginning alone."""
    needle = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 40, 30)).otherwise(F.concat(F.substring("text", 40, 25), F.lit(" zz nothing")))
    return table(spark, d, "documents").where(F.length("text") >= 80).select("doc_id", O.best_match(F.col("text"), needle, 20).alias("place"))


@query("st29_clamp", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.25 ELSE greatest(0.2, least(0.6, value)) END AS value FROM events")
def st29(spark, d):
    value = F.when(F.col("event_id") % 14 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", O.clamp(value, 0.2, 0.6, 0.25).alias("value"))


@query("st36_special_tokens", "SELECT conv_id, turn, replace(replace(replace(coalesce(text, ''), '. ', '.<|doc|> ') || '<|end|>b', '<|doc|>', ''), '<|end|>', '') AS text FROM conversations")
def st36(spark, d):
    """Texts of the conversations, a token after each sentence and one at the end, without them."""
    said = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".<|doc|> ")), F.lit("<|end|>b"))
    return table(spark, d, "conversations").select("conv_id", "turn", O.without(said, ["<|doc|>", "<|end|>"]).alias("text"))


@query("st38_error_body", "SELECT event_id, '{\"error\":{\"code\":\"' || upper(event_type) || '\",\"message\":\"m' || event_id || '\"}}' AS body FROM events")
def st38(spark, d):
    return table(spark, d, "events").select("event_id", O.error_body(F.upper("event_type"), F.concat(F.lit("m"), "event_id")).alias("body"))


@query("pf19_transcript", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 10 / 10.0 <= 0.6 THEN 'one' END, CASE WHEN -(event_id % 3) >= -1 THEN event_type END, CASE WHEN event_id % 4 <= 2.4 THEN 'three' END], lambda x: x IS NOT NULL), ' ') AS said FROM events")
def pf19(spark, d):
    part = lambda text, silence, logprob, compression: F.struct(text.alias("text"), silence.cast("double").alias("silence"), logprob.cast("double").alias("logprob"), compression.cast("double").alias("compression"))
    zero = F.lit(0.0)
    segments = F.array(part(F.lit(" one"), F.col("event_id") % 10 / 10.0, zero, zero), part(F.col("event_type"), zero, -(F.col("event_id") % 3), zero), part(F.lit("three "), zero, zero, F.col("event_id") % 4), part(F.lit("  "), zero, zero, zero))
    return table(spark, d, "events").select("event_id", O.transcript(segments, F.lit("no")).alias("said"))


@query("pf24_speech_gate", f"SELECT user_id, count(*) / 16000.0 >= 0.0003 AND sqrt(avg(value * value)) >= {O.SPEECH_RMS} AND max(abs(value)) >= {O.SPEECH_PEAK} AS speech FROM (SELECT user_id, value / 1000 AS value FROM events) GROUP BY user_id")
def pf24(spark, d):
    """The loudness half of the gate, by group."""
    own = table(spark, d, "events").select("user_id", (F.col("value") / 1000).alias("value"))
    loud = (F.count(F.lit(1)) / 16000.0 >= 0.0003) & (F.sqrt(F.avg(F.col("value") * F.col("value"))) >= O.SPEECH_RMS) & (F.max(F.abs("value")) >= O.SPEECH_PEAK)
    return own.groupBy("user_id").agg(loud.alias("speech"))


@query("ct08_span_overlap", "SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_id % 90 < b.event_id % 90 + 5 AND b.event_id % 90 < a.event_id % 90 + 5")
def ct08(spark, d):
    a = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 90).alias("lo"))
    b = a.select("user_id", F.col("event_id").alias("other"), F.col("lo").alias("lo2"))
    return a.join(b, "user_id").where((F.col("event_id") < F.col("other")) & O.overlap(F.col("lo"), F.col("lo") + 5, F.col("lo2"), F.col("lo2") + 5)).select("event_id", "other")


@query("ct09_context_words", "WITH s AS (SELECT doc_id, text, CAST(doc_id % 300 AS INTEGER) AS lo, CAST(doc_id % 300 + 9 AS INTEGER) AS hi FROM documents), p AS (SELECT doc_id, regexp_extract_all(substring(text, greatest(0, lo - 240) + 1, least(lo, 240)), '[^ \\t\\n\\r\\f\\v]+') AS l, regexp_extract_all(substring(text, hi + 1, 240), '[^ \\t\\n\\r\\f\\v]+') AS r FROM s) SELECT doc_id, array_to_string(list_concat(l[greatest(len(l) - 2, 1):], r[:4]), '|') AS words FROM p")
def ct09(spark, d):
    lo = (F.col("doc_id") % 300).cast("int")
    return table(spark, d, "documents").select("doc_id", F.array_join(O.context_words(F.col("text"), lo, lo + 9, 7), "|").alias("words"))


LAT, LON = "(c_custkey * 37 % 180 - 90)", "(c_custkey * 73 % 360 - 180)"


@query("ge03_chord", f"SELECT c_custkey, round(2 * sin(least(c_custkey % 30000 / {G.RADIUS_KM}, pi()) / 2), 9) AS chord FROM customer")
def ge03(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(2 * F.sin(F.least((F.col("c_custkey") % 30000) / G.RADIUS_KM, F.lit(math.pi)) / 2), 9).alias("chord"))


@query("ge04_decay", "SELECT c_custkey, round(0.18 * pow(2.0, -(c_custkey % 200) / 25.0), 9) AS boost FROM customer")
def ge04(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(G.decay(F.col("c_custkey") % 200), 9).alias("boost"))


@query("ge22_country_resolve", "SELECT c_nationkey AS country, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS place, 93 AS score FROM customer GROUP BY 1")
def ge22(spark, d):
    own = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("country")).agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("place"))
    return own.withColumn("score", F.lit(93))


@query("ge23_alias_lookup", "SELECT c_custkey, c_name AS alias FROM customer WHERE c_nationkey = 5")
def ge23(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 5").select("c_custkey", F.col("c_name").alias("alias"))


_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"


@query("ge30_rounded_distance", f"SELECT c_custkey, round({_HAVERSINE}, 2) AS distance_km FROM (SELECT c_custkey, {LAT}::DOUBLE AS lat1, {LON}::DOUBLE AS lon1, 48.0 AS lat2, 11.0 AS lon2 FROM customer)")
def ge30(spark, d):
    lat, lon = (F.col("c_custkey") * 37 % 180 - 90).cast("double"), (F.col("c_custkey") * 73 % 360 - 180).cast("double")
    return table(spark, d, "customer").select("c_custkey", F.round(G.haversine(lat, lon, F.lit(48.0), F.lit(11.0)), 2).alias("distance_km"))


@query("ge32_place_rows", f"SELECT c_custkey AS id, c_name AS name, {LAT} AS lat, {LON} AS lon, c_nationkey AS country FROM customer")
def ge32(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 37 % 180 - 90).alias("lat"), (F.col("c_custkey") * 73 % 360 - 180).alias("lon"), F.col("c_nationkey").alias("country"))
