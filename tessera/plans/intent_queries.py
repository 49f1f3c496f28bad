"""Queries on the intent of questions; the questions are made from a fixed list and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import intent as I
from tessera.functions import intent_values as V
from tessera.registry import query
from tessera.session import ship_package, table

LEADS = ("compare the difference of ", "summarize ", "who wrote ", "how do I read ", "list all of ", "quote the evidence for ", "when did ", "tell me ", "Why did Romeo kill ", "which of the documents covers ")


def questions(spark, d):
    lead = F.element_at(F.array(*(F.lit(x) for x in LEADS)), ((F.col("conv_id") + F.col("turn")) % len(LEADS) + 1).cast("int"))
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(lead, F.coalesce("text", F.lit(""))).alias("asked"))
    return asked.withColumn("question", F.lower("asked"))


def _q(text: str) -> str:
    return text.replace("'", "''")


def _hit(pattern: str, column: str = "question") -> str:
    return f"regexp_matches({column}, '(?-s){_q(pattern)}', 'i')"


def _or(patterns, column: str = "question") -> str:
    return _hit("(?:" + "|".join(patterns) + ")", column)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SQL_QUESTIONS = "a AS (SELECT conv_id, turn, [" + ", ".join(f"'{x}'" for x in LEADS) + f"][(conv_id + turn) % {len(LEADS)} + 1] || coalesce(text, '') AS asked FROM conversations WHERE role = 'user'), q AS (SELECT *, lower(asked) AS question FROM a)"
_SCOPE = f"({_hit(I.SCOPE[0])} AND {_hit(I.SCOPE[1])})"


def _definition(column: str = "question") -> str:
    return f"({_hit(I.DEFINITION, column)} AND NOT list_has_any(string_split_regex(lower(regexp_extract({column}, '{_q(I.DEFINITION)}', 1, 'i')), '\\s+'), {_list(dict.fromkeys(V.OVERVIEW_WORDS + V.NO_DEFINITION_WORDS))}))"


#: A word's ends are those of letters of any kind; RE2's own are of ASCII.
_NAMED = r"(?:^|[^\p{L}\p{N}_])[A-Z][a-z]{2,}(?:[^\p{L}\p{N}_]|$)"


def _technical(column: str) -> str:
    return f"(regexp_matches({column}, '(?-s){_q(I.QUOTED)}|{_NAMED}') OR {_hit('|'.join(V.TECHNICAL), column)})"


def _how_why(column: str) -> str:
    how, many = r"^\s*(how|why)\b", r"^\s*how\s+many\b"
    return f"({_hit(how, column)} AND NOT {_hit(many, column)} AND {_technical(column)})"


def _act() -> str:
    words = "list_filter(string_split_regex(asked, '\\s+'), lambda w: w <> '')"
    named = f"list_transform({words}[2:], lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g'))"
    return f"(len({words}) >= 4 AND len(list_filter({named}, lambda w: regexp_matches(w, '^[A-Z].') AND NOT list_contains({_list(V.NO_ENTITY_WORDS)}, lower(w)))) > 0 AND {_hit(V.ACTIONS, 'asked')})"


def _scores() -> str:
    parts = {i: [f"{_hit(p)}::INT" for p in V.PATTERNS[i]] for i in I.INTENTS}
    for p, i in V.COMMANDS:
        barred = f" AND NOT {_SCOPE}" if i in ("SUMMARIZE", "FACTUAL") else ""
        parts[i].append(f"3 * ({_hit(p)}{barred})::INT")
    for i, n, ps in V.STRUCTURES:
        parts[i].append(f"{n} * {_or(ps)}::INT")
    parts["FACTUAL"].append(f"2 * {_definition()}::INT")
    parts["COLLECTION"].append(f"4 * ({_SCOPE} OR {_hit(I.EVERYTHING)})::INT")
    parts["ANALYZE"] += [f"2 * {_hit(I.OWN_CRITIQUE)}::INT", f"3 * {_hit(I.CHAIN)}::INT", "2 * contains(question, '->')::INT"]
    return "p AS (SELECT *, " + ", ".join(f"{' + '.join(x)} AS s_{i}" for i, x in parts.items()) + f", {_how_why('question')} AS bias FROM q)"


_C, _R, _A = "s_COMPARE", "s_CRITIQUE", "s_ANALYZE"
SQL_SCORES = f"""{_scores()}, n AS (SELECT * REPLACE (CASE WHEN {_hit(I.NOUN_CRITIQUE)} THEN greatest(0, s_CRITIQUE - 1) ELSE s_CRITIQUE END AS s_CRITIQUE) FROM p),
g AS (SELECT *, CASE WHEN NOT bias THEN '' WHEN greatest({_C}, {_R}, {_A}) = 0 THEN 'ANALYZE' WHEN {_C} >= {_R} AND {_C} >= {_A} THEN 'COMPARE' WHEN {_R} >= {_A} THEN 'CRITIQUE' ELSE 'ANALYZE' END AS gains FROM n),
s AS (SELECT * REPLACE ({', '.join(f"s_{i} + 2 * (gains = '{i}')::INT AS s_{i}" for i in ("COMPARE", "CRITIQUE", "ANALYZE"))}) FROM g)"""
_DEDICATED = f"greatest({', '.join(f's_{i}' for i in I.DEDICATED)})"
SQL_INTENT = f"""{SQL_SCORES}, b AS (SELECT *, greatest({', '.join(f's_{i}' for i in I.INTENTS)}) AS most FROM s), c AS (SELECT *, CASE {' '.join(f"WHEN s_{i} = most THEN '{i}'" for i in I.INTENTS)} END AS best, {_DEDICATED} > 0 AND {_DEDICATED} >= greatest(s_COLLECTION, s_FACTUAL, s_SUMMARIZE, s_ANALYZE) AS dedicated, s_COMPARE > 0 AND s_CRITIQUE > 0 AND s_COMPARE >= s_CRITIQUE AS two FROM b),
d AS (SELECT *, CASE WHEN two THEN 'COMPARE' WHEN NOT dedicated AND s_COLLECTION > 0 AND ((s_SUMMARIZE > 0 AND s_COLLECTION >= s_SUMMARIZE) OR (s_FACTUAL > 0 AND s_COLLECTION >= s_FACTUAL)) THEN 'COLLECTION'
  WHEN best = 'ANALYZE' AND s_ANALYZE <= 1 AND (s_COMPARE > 0 OR s_CRITIQUE > 0) THEN CASE WHEN s_COMPARE >= s_CRITIQUE THEN 'COMPARE' ELSE 'CRITIQUE' END ELSE best END AS found, {' + '.join(f'(s_{i} > 0)::INT' for i in I.INTENTS)} - two::INT AS matching FROM c),
e AS (SELECT *, CASE {' '.join(f"WHEN found = '{i}' THEN s_{i}" for i in I.INTENTS)} END AS score FROM d),
f AS (SELECT *, CASE WHEN matching > 1 AND score = 1 THEN 0.5 WHEN score >= 2 THEN 0.85 ELSE 0.7 END::DOUBLE AS c0 FROM e),
h AS (SELECT *, CASE WHEN bias AND found IN ('ANALYZE', 'COMPARE', 'CRITIQUE') THEN least(0.95, round(c0 + 0.15, 6)) ELSE c0 END AS c1, found IN ('ANALYZE', 'EXPLAIN') AND {_hit(r"^\s*why\b", 'asked')} AND {_act()} AS act FROM f),
i AS (SELECT conv_id, turn, question, CASE WHEN most = 0 THEN 'OVERVIEW' WHEN act THEN 'FACTUAL' ELSE found END AS intent, (CASE WHEN most = 0 THEN 0.4 WHEN act THEN greatest(c1, 0.85) ELSE c1 END)::DOUBLE AS confidence, CASE WHEN most = 0 THEN 'fallback' ELSE 'heuristic' END AS method FROM h),
k AS (SELECT conv_id, turn, question, CASE WHEN confidence < 0.6 THEN 'OVERVIEW' ELSE intent END AS intent, confidence, CASE WHEN confidence < 0.6 THEN method || '+overview_fallback' ELSE method END AS method FROM i)"""


SCALES = {"OVERVIEW": 1.5, "FACTUAL": 0.5, "COMPARE": 1.25, "COLLECTION": 2.0, "QUOTE_EVIDENCE": 0.1}


@query("in01_typos")
def in01(spark, d):
    """Typos corrected by a lexicon; held against golden questions in the tests."""
    ship_package(spark)
    return questions(spark, d).select("conv_id", "turn", I.correct_typos("asked").alias("question"))


@query("in02_pattern_scores", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {', '.join(' + '.join(f"{_hit(p)}::INT" for p in V.PATTERNS[i]) + f" AS s_{i}" for i in I.INTENTS)} FROM q")
def in02(spark, d):
    return questions(spark, d).select("conv_id", "turn", *(c.alias(f"s_{i}") for i, c in I.pattern_scores(F.col("question")).items()))


@query("in03_structural_scores", f"WITH {SQL_QUESTIONS}, {SQL_SCORES} SELECT conv_id, turn, bias, {', '.join(f's_{i}' for i in I.INTENTS)} FROM s")
def in03(spark, d):
    return I.with_scores(questions(spark, d), "question").drop("asked", "question")


@query("in04_ungated", f"WITH {SQL_QUESTIONS}, {SQL_INTENT} SELECT conv_id, turn, intent, confidence, method FROM i")
def in04(spark, d):
    return I.classify(questions(spark, d), "question", original="asked", floor=None).drop("asked", "question")


@query("in06_certain_act", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {_act()} AS act FROM q")
def in06(spark, d):
    return questions(spark, d).select("conv_id", "turn", I.is_certain_act(F.col("asked")).alias("act"))


@query("in07_classify", f"WITH {SQL_QUESTIONS}, {SQL_INTENT} SELECT conv_id, turn, intent, confidence, method FROM k")
def in07(spark, d):
    return I.classify(questions(spark, d), "question", original="asked").drop("asked", "question")


@query("rk16_intent_scaling", f"WITH {SQL_QUESTIONS}, {SQL_INTENT}, scales(intent, scale) AS (VALUES ('OVERVIEW', 1.5::DOUBLE), ('FACTUAL', 0.5), ('COMPARE', 1.25), ('COLLECTION', 2.0), ('QUOTE_EVIDENCE', 0.1)) SELECT conv_id, turn, intent, CAST(greatest(1, round_even(50 * coalesce(scale, 1), 0)) AS INTEGER) AS fused, CAST(greatest(1, round_even(5 * coalesce(scale, 1), 0)) AS INTEGER) AS final FROM k LEFT JOIN scales USING (intent)")
def rk16(spark, d):
    """How deep the conversations' questions are searched, by their intents; 1 where an intent has no scale."""
    scale = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair)), F.col("intent")), F.lit(1.0))
    cut = lambda base: F.greatest(F.lit(1), F.bround(base * scale, 0).cast("int"))
    return in07(spark, d).select("conv_id", "turn", "intent", cut(50).alias("fused"), cut(5).alias("final"))


@query("in08_definition", f"WITH {SQL_QUESTIONS}, d AS (SELECT conv_id, turn, 'What is ' || CASE turn % 3 WHEN 0 THEN 'a ' || string_split(asked, ' ')[1] WHEN 1 THEN string_split(asked, ' ')[1] || ' art?' ELSE 'the main ' || asked END AS question FROM q) SELECT conv_id, turn, {_definition()} AS definition FROM d")
def in08(spark, d):
    """Whether the conversations' questions, put after "What is", ask for a definition."""
    first, k = F.element_at(F.split("asked", " "), 1), F.col("turn") % 3
    subject = F.when(k == 0, F.concat(F.lit("a "), first)).when(k == 1, F.concat(first, F.lit(" art?"))).otherwise(F.concat(F.lit("the main "), "asked"))
    return questions(spark, d).select("conv_id", "turn", I.is_definition(F.concat(F.lit("What is "), subject)).alias("definition"))


@query("in09_technical_how_why", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {_how_why('asked')} AS technical FROM q")
def in09(spark, d):
    return questions(spark, d).select("conv_id", "turn", I.is_technical_how_why(F.col("asked")).alias("technical"))


@query("in13_override", f"WITH {SQL_QUESTIONS}, {SQL_INTENT}, m AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'SUMMARIZE' WHEN 2 THEN 'TIMELINE' END AS given FROM k) SELECT conv_id, turn, coalesce(given, intent) AS intent, CASE WHEN given IS NOT NULL THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN given IS NOT NULL THEN 'manual' ELSE method END AS method FROM m")
def in13(spark, d):
    given = F.when(F.col("turn") % 4 == 0, " summarise").when(F.col("turn") % 4 == 2, "timeline").otherwise("unheard of")
    return I.override(I.classify(questions(spark, d), "question", original="asked"), given).drop("asked", "question")


@query("in14_technical_terms", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {_technical('asked')} AS technical FROM q")
def in14(spark, d):
    return questions(spark, d).select("conv_id", "turn", I.is_technical(F.col("asked")).alias("technical"))


@query("pf10_enumeration", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {_or(V.ENUMERATION)} AS enumeration FROM q")
def pf10(spark, d):
    return questions(spark, d).select("conv_id", "turn", I.is_enumeration(F.col("question")).alias("enumeration"))


@query("pf11_policy", f"WITH {SQL_QUESTIONS}, {SQL_INTENT} SELECT conv_id, turn, CASE WHEN {_or(V.ENUMERATION)} THEN 'enumeration' WHEN intent = 'FACTUAL' THEN 'factual' WHEN intent IN {I.ANALYTICAL} THEN 'analytical' ELSE 'default' END AS policy FROM k")
def pf11(spark, d):
    own = I.classify(questions(spark, d), "question", original="asked")
    return own.select("conv_id", "turn", I.policy(F.col("question"), F.col("intent")).alias("policy"))


_SHORT = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'wa wa wa' WHEN 1 THEN event_type || ' moogly' WHEN 2 THEN '12 + 3' WHEN 3 THEN 'what ' || event_type WHEN 4 THEN event_type || ' for you?' ELSE 'explain ' || event_type END AS question FROM events)"


@query("pf17_low_information", f"WITH w AS (SELECT *, regexp_extract_all(lower(trim(question)), '[a-z'']+') AS words, {_or([p for ps in V.PATTERNS.values() for p in ps])} OR list_has_any(regexp_extract_all(lower(question), '[a-z'']+'), {_list(V.COMMON_WORDS)}) AS signal FROM {_SHORT}) SELECT event_id, len(words) = 0 OR (len(words) >= 2 AND len(list_distinct(words)) = 1) OR (NOT signal AND (len(words) <= 2 OR (len(words) <= 3 AND NOT contains(question, '?')))) AS low FROM w")
def pf17(spark, d):
    k, kind = F.col("event_id") % 6, F.col("event_type")
    said = F.when(k == 0, "wa wa wa").when(k == 1, F.concat(kind, F.lit(" moogly"))).when(k == 2, "12 + 3").when(k == 3, F.concat(F.lit("what "), kind)).when(k == 4, F.concat(kind, F.lit(" for you?"))).otherwise(F.concat(F.lit("explain "), kind))
    return table(spark, d, "events").select("event_id", I.is_low_information(said).alias("low"))


@query("pf18_source_selection", f"WITH {SQL_QUESTIONS} SELECT conv_id, turn, {_hit(I.DOC_TERM)} AND ({_hit(I.SELECTOR)} OR {_hit(I.TOPIC)}) AS selects FROM q")
def pf18(spark, d):
    return questions(spark, d).select("conv_id", "turn", I.is_source_selection(F.col("question")).alias("selects"))


@query("in10_reply_json", "SELECT event_id, coalesce(json_extract_string(reply, '$.intent'), 'OVERVIEW') AS intent, greatest(0.0, least(1.0, coalesce(try_cast(json_extract_string(reply, '$.confidence') AS DOUBLE), 0.75))) AS confidence FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{\"intent\": \"' || event_type || '\", \"confidence\": ' || (event_id % 30) / 20.0::DOUBLE || '}' END AS reply FROM events)")
def in10(spark, d):
    """A model's reply, fenced, read back with defaults."""
    body = F.when(F.col("event_id") % 4 == 0, "{}").otherwise(F.concat(F.lit('{"intent": "'), "event_type", F.lit('", "confidence": '), (F.col("event_id") % 30 / 20.0).cast("string"), F.lit("}")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    clean = F.regexp_extract(fenced, r"(?s)(\{.*\})", 1)
    own = table(spark, d, "events").select("event_id", F.from_json(clean, "intent string, confidence string").alias("r"))
    return own.select("event_id", F.coalesce("r.intent", F.lit("OVERVIEW")).alias("intent"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.75)))).alias("confidence"))
