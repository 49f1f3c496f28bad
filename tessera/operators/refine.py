"""Choice among the places of one name: by the words around it, or by the other names of its document.

By context a candidate has 5 * sqrt(people / most people of the candidates), 4 for a country that the
context names by a word of ``COUNTRIES`` (3 where the code itself is said), 4.5 for a state of the
United States, 2 for a word of its first-level district, 1.5 for a word of its aliases, and up to 1.5
for nearness to a large place that the context names. The most points win, then most people.

Defined cases: names that are clear, or without context, stay with the place of most people; candidates
are the first ten by people; null context words are no words; ties go to the lesser geonameid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.operators import geocode as C

#: Points, as above; kilometres at which nearness counts 1 / e; people of a place that counts as an anchor; candidates of a name. Fixed values.
PEOPLE, COUNTRY, CODE, STATE, DISTRICT, ALIAS, NEAR, NEAR_KM, ANCHOR, MOST = 5.0, 4.0, 3.0, 4.5, 2.0, 1.5, 1.5, 150.0, 100_000, 10
#: States and their codes. Fixed values.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))


def _codes(terms: Column, table: dict) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_compact(F.transform(terms, lambda t: F.try_element_at(codes, t)))


def by_context(asked: DataFrame, places: DataFrame, aliases: DataFrame, anchor_people: int = ANCHOR) -> DataFrame:
    """(query, context, geonameid, points) of distinct (query, context): the chosen candidate. places: geonameid, lat, lon, population, country and, if there is one, admin1."""
    own = asked.select("query", "context").distinct()
    named = aliases.select(F.col("alias").alias("query"), "geonameid", F.coalesce("population", F.lit(0)).alias("population")).groupBy("query", "geonameid").agg(F.max("population").alias("population"))
    ranked = named.join(own.select("query").distinct(), "query", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("population"), "geonameid"))).where(F.col("k") <= MOST).drop("k")
    ranked = ranked.withColumn("top", F.max("population").over(Window.partitionBy("query")))
    admin1 = F.coalesce("admin1", F.lit("")) if "admin1" in places.columns else F.lit("")
    where = places.select("geonameid", "lat", "lon", F.coalesce("country", F.lit("")).alias("country"), admin1.alias("admin1"))
    words = aliases.join(ranked.select("geonameid").distinct(), "geonameid", "left_semi").groupBy("geonameid").agg(F.array_distinct(F.flatten(F.collect_set(_tokens(F.col("alias"))))).alias("words"))
    candidates = ranked.join(where, "geonameid").join(words, "geonameid", "left")
    # what the context says
    tokens = F.array_distinct(F.flatten(F.transform("context", _tokens)))
    phrases = F.transform("context", lambda w: F.array_join(_tokens(w), " "))
    said = own.withColumn("tokens", tokens).withColumn("terms", F.array_union("tokens", phrases))
    said = said.withColumn("countries", _codes(F.col("terms"), C.COUNTRIES)).withColumn("states", _codes(F.col("terms"), STATES))
    best = C._first(aliases.select(F.col("alias").alias("word"), "geonameid", F.coalesce("population", F.lit(0)).alias("people")), ["word"], F.desc("people"), "geonameid").where(F.col("people") >= anchor_people)
    anchors = own.select("context").distinct().select("context", F.explode("context").alias("w")).select("context", F.lower(F.trim("w")).alias("word")).join(best, "word").join(places.select("geonameid", "lat", "lon"), "geonameid")
    near = anchors.groupBy("context").agg(F.collect_set(F.struct("lat", "lon")).alias("anchors"))
    met = said.join(near, "context", "left").join(candidates, "query")
    country = F.when(F.array_contains("countries", F.upper("country")), COUNTRY).when(F.array_contains("terms", F.lower("country")), CODE).otherwise(0.0)
    state = F.when((F.upper("country") == "US") & F.array_contains("states", F.upper("admin1")), STATE).otherwise(0.0)
    district = F.when(F.arrays_overlap(F.filter(F.split(F.lower("admin1"), r"\s+"), lambda t: t != ""), "tokens"), DISTRICT).otherwise(0.0)
    alias = F.when(F.coalesce(F.arrays_overlap("words", "tokens"), F.lit(False)), ALIAS).otherwise(0.0)
    km = F.array_min(F.transform("anchors", lambda a: G.haversine(F.col("lat"), F.col("lon"), a["lat"], a["lon"])))
    people = F.when(F.col("top") > 0, PEOPLE * F.sqrt(F.col("population") / F.greatest("top", F.lit(1)))).otherwise(0.0)
    points = met.withColumn("points", people + country + state + district + alias + F.coalesce(NEAR * F.exp(-km / NEAR_KM), F.lit(0.0)))
    return C._first(points, ["query", "context"], F.desc("points"), F.desc("population"), "geonameid").select("query", "context", "geonameid", "points")


def forward_in_context(names: DataFrame, name: str, context: str, places: DataFrame, aliases: DataFrame, *, threshold: float = 72.0, entity_type: str | None = None, hardened: bool = False, floor: float = 72.0, least_margin: float = 2.0, anchor_people: int = ANCHOR) -> DataFrame:
    """names as ``geocode.forward`` gives them, ambiguous exact ones by their context words (an array); a name that nothing fits takes the country that its context names first. hardened: likenesses under floor, of a small margin to a rival, or of generic words under 90 are no matches."""
    raw = C.forward(names.withColumn("context", F.coalesce(F.array_compact(context), F.array().cast("array<string>"))), name, places, aliases, threshold, entity_type)
    open_ = raw.where(F.col("ambiguous") & (F.col("method") == "exact") & (F.size("context") > 0))
    chosen = by_context(open_, places, aliases, anchor_people).select("query", "context", F.col("geonameid").alias("__chosen"))
    out = raw.join(chosen, ["query", "context"], "left").withColumn("geonameid", F.coalesce("__chosen", "geonameid")).drop("__chosen")
    top = C._first(places.where("country is not null"), ["country"], F.desc(F.coalesce("population", F.lit(0))), "geonameid").select(F.col("country").alias("__code"), F.col("geonameid").alias("__country"))
    code = F.try_element_at(F.array_compact(F.transform("context", lambda w: C.country_code(F.lower(F.trim(w))))), F.lit(1))
    lost = (F.col("geonameid").isNull()) & (F.col("query") != "")
    out = out.withColumn("__code", F.when(lost, code)).join(top, "__code", "left")
    taken = F.col("geonameid").isNull() & F.col("__country").isNotNull()
    kind = F.col(entity_type) if entity_type else F.lit(None).cast("string")
    country = C.confidence(F.lit(93.0), F.lit("query"), F.lit(False), F.col("query"), kind, F.lit(1).cast("long"), F.lit(None).cast("double"))
    values = {"score": F.lit(93.0), "method": F.lit("query"), "ambiguous": F.lit(False), "rivals": F.lit(1).cast("long"), "margin": F.lit(None).cast("double"), "confidence": country}
    out = out.withColumns({c: F.when(taken, v).otherwise(F.col(c)) for c, v in values.items()}).withColumn("geonameid", F.coalesce("geonameid", "__country")).drop("__code", "__country")
    if hardened:
        fuzzy = F.coalesce(F.col("method") == "trigram_fuzzy", F.lit(False))
        weak = (F.col("score") < floor) | ((F.col("rivals") >= 2) & F.coalesce(F.col("margin") < least_margin, F.lit(False))) | (C.generic_place(F.col("query")) & (F.col("score") < 90.0))
        out = out.withColumns({c: F.when(~(fuzzy & weak), F.col(c)) for c in ("geonameid", "score", "method", "ambiguous", "rivals", "margin", "confidence")})
    return out


def forward_batch(names: DataFrame, name: str, by: list[str], places: DataFrame, aliases: DataFrame, **settings) -> DataFrame:
    """names of documents (``by``) as ``geocode.forward`` gives them, the ambiguous exact ones of a document chosen together: by people and nearness to the best places of its other ambiguous names."""
    raw = C.forward(names, name, places, aliases, **settings)
    open_ = raw.where(F.col("ambiguous") & (F.col("method") == "exact")).select(*by, "query").distinct()
    named = aliases.select(F.col("alias").alias("query"), "geonameid", F.coalesce("population", F.lit(0)).alias("population")).groupBy("query", "geonameid").agg(F.max("population").alias("population"))
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("population"), "geonameid"))).where(F.col("k") <= MOST).drop("k")
    candidates = open_.join(first, "query").join(places.select("geonameid", "lat", "lon"), "geonameid")
    chosen = C.coherent(candidates, by, "query").select(*by, "query", F.col("geonameid").alias("__chosen"))
    return raw.join(chosen, [*by, "query"], "left").withColumn("geonameid", F.coalesce("__chosen", "geonameid")).drop("__chosen")

