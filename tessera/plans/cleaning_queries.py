"""Queries of answers' clean-up, places in raw texts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import cleaning as C
from tessera.registry import query
from tessera.session import table


def answers(spark, d):
    """The conversations' texts as a model may spoil them: a leaked line before every second turn, every third said twice, chatter behind every fourth, every fifth broken off."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    own = F.when(turn % 3 == 1, F.concat(text, F.lit(" "), text)).otherwise(text)
    own = F.when(turn % 2 == 0, F.concat(F.lit("Task: answer this.\n"), own)).otherwise(own)
    own = F.when(turn % 4 == 3, F.concat(own, F.lit(" I hope this helps you."))).otherwise(own)
    own = F.when(turn % 5 == 2, F.concat(own, F.lit(" and then the"))).otherwise(own)
    return table(spark, d, "conversations").select("conv_id", "turn", own.alias("answer"))


@query("st06_sanitized")
def st06(spark, d):
    return answers(spark, d).select("conv_id", "turn", C.sanitize(F.col("answer")).alias("answer"))


PHRASES = "(i hope this helps|let me know if)"


@query("st07_chatter", """
WITH a AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' I hope this helps you.' WHEN 1 THEN ' Let me know if more is wanted. I hope this helps.' ELSE '' END AS t FROM conversations),
b AS (SELECT *, CASE WHEN contains(lower(t), 'i hope this helps') AND length(t) - instr(reverse(lower(t)), reverse('i hope this helps')) - 16 > 0.8 * length(t) THEN regexp_replace(substring(t, 1, length(t) - instr(reverse(lower(t)), reverse('i hope this helps')) - 16), '\\s+$', '') ELSE t END AS u FROM a)
SELECT conv_id, turn, CASE WHEN contains(lower(u), 'let me know if') AND length(u) - instr(reverse(lower(u)), reverse('let me know if')) - 13 > 0.8 * length(u) THEN regexp_replace(substring(u, 1, length(u) - instr(reverse(lower(u)), reverse('let me know if')) - 13), '\\s+$', '') ELSE u END AS answer FROM b""")
def st07(spark, d):
    more = F.when(F.col("turn") % 3 == 0, " I hope this helps you.").when(F.col("turn") % 3 == 1, " Let me know if more is wanted. I hope this helps.").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", C.without_chatter(F.concat(F.coalesce("text", F.lit("")), more)).alias("answer"))


@query("st08_repeated_halves")
def st08(spark, d):
    return answers(spark, d).select("conv_id", "turn", C.once(F.col("answer")).alias("answer"))


@query("st26_raw_places", """
WITH t AS (SELECT doc_id, text, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS own, string_split(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
n AS (SELECT *, array_to_string(w[3:9], ' ') AS needle FROM t WHERE len(w) >= 3),
f AS (SELECT *, instr(own, needle) AS pos FROM n)
SELECT doc_id, CAST(pos - 1 + (length(substring(text, 1, pos - 1)) - length(replace(substring(text, 1, pos - 1), ' ', ''))) AS INTEGER) AS start,
  CAST(length(needle) + length(substring(text, pos, length(needle))) - length(replace(substring(text, pos, length(needle)), ' ', '')) AS INTEGER) AS length
FROM f""")
def st26(spark, d):
    """Words 3 to 9 of each document, found in the document with its blanks doubled."""
    words = F.split(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")), " ")
    own = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("  ")).alias("raw"), words.alias("w")).where(F.size("w") >= 3)
    return own.select("doc_id", C.place_in_raw(F.col("raw"), F.array_join(F.slice("w", 3, 7), " ")).alias("p")).select("doc_id", "p.start", "p.length")


@query("ch12_entity_windows")
def ch12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.entity_windows(F.col("text"))).alias("n", "w")).select("doc_id", "n", "w.*")
