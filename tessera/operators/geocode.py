"""From names of places to places: exact, historical regions, likeness, countries; choice by context, confidence, clusters.

places: geonameid, name, lat, lon, population, country. aliases: alias (as ``text.index_form`` gives it),
geonameid, population.

Defined cases: null and blank names resolve to nothing; a population that is null counts as 0; ties go to
the lesser geonameid; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.functions import similar
from tessera.functions import text as T
from tessera.functions.entities import NAMED_REGIONS, generic_place
from tessera.operators.spatial import radius_join
from tessera.session import ship_package

#: Most that a method's confidence can be; what a method's score counts where none was worked out. Fixed values.
CAPS = {"exact": 1.00, "region_table": 0.94, "trigram_fuzzy": 0.88, "query": 0.86, "regex": 0.72, "manual": 1.00}
PRIORS = {"exact": 1.00, "region_table": 0.95, "trigram_fuzzy": 0.90, "query": 0.85, "regex": 0.70, "manual": 1.00}
#: Share kept by ambiguous matches, margin that makes a likeness certain, penalties, least population share of a rival. Fixed values.
AMBIGUOUS, MARGIN, GENERIC_PENALTY, ENTITY_PENALTY, RIVAL = 0.85, 4.0, 0.08, 0.12, 0.05
#: Words for countries and their codes. Fixed values.
COUNTRIES = {
    "france": "FR", "french": "FR",
    "united states": "US", "usa": "US", "us": "US",
    "egypt": "EG", "egyptian": "EG",
    "syria": "SY", "syrian": "SY",
    "turkey": "TR", "turkish": "TR",
    "germany": "DE", "german": "DE",
    "italy": "IT", "italian": "IT",
    "spain": "ES", "spanish": "ES",
    "greece": "GR", "greek": "GR",
    "china": "CN", "chinese": "CN",
    "japan": "JP", "japanese": "JP",
    "india": "IN", "indian": "IN",
    "russia": "RU", "russian": "RU",
    "brazil": "BR", "brazilian": "BR",
    "mexico": "MX", "mexican": "MX",
    "canada": "CA", "canadian": "CA",
    "australia": "AU", "australian": "AU",
    "united kingdom": "GB", "uk": "GB", "britain": "GB", "british": "GB",
    "iran": "IR", "iranian": "IR", "persia": "IR", "persian": "IR",
    "iraq": "IQ", "iraqi": "IQ",
    "israel": "IL", "israeli": "IL",
    "poland": "PL", "polish": "PL",
    "portugal": "PT", "portuguese": "PT",
    "netherlands": "NL", "dutch": "NL",
    "sweden": "SE", "swedish": "SE",
    "norway": "NO", "norwegian": "NO",
    "austria": "AT", "austrian": "AT",
    "switzerland": "CH", "swiss": "CH",
}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def country_code(query: Column) -> Column:
    """Code of a country's name or of its people's, null for other words."""
    return F.try_element_at(_map(COUNTRIES), query)


def default_confidence(score: Column, method: Column, ambiguous: Column) -> Column:
    """Of a match for which none was worked out."""
    return score / 100.0 * F.coalesce(F.try_element_at(_map(PRIORS), method), F.lit(0.80)) * F.when(ambiguous, AMBIGUOUS).otherwise(1.0)


def confidence(score: Column, method: Column, ambiguous: Column, query: Column, entity_type: Column, rivals: Column, margin: Column) -> Column:
    """Within 0 and the method's cap: less for ambiguous ones, small margins, generic words, persons and organisations."""
    cap = F.coalesce(F.try_element_at(_map(CAPS), method), F.lit(0.80))
    fuzzy = method == "trigram_fuzzy"
    share = F.when(fuzzy & margin.isNotNull() & (rivals >= 2), 0.65 + 0.35 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / MARGIN))).otherwise(1.0)
    base = F.least(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) / 100.0, cap) * F.when(ambiguous, AMBIGUOUS).otherwise(1.0) * share
    less = F.when(fuzzy & generic_place(query), GENERIC_PENALTY).otherwise(0.0) + F.when(F.upper(F.coalesce(entity_type, F.lit(""))).isin("PERSON", "ORG"), ENTITY_PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(cap, base - less))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in NAMED_REGIONS.items()], "region string, lat double, lon double, radius double")


def region_places(places: DataFrame, km: float = 50.0) -> DataFrame:
    """(region, geonameid): the place with the most people near the middle of each historical region."""
    near = radius_join(regions(places.sparkSession).select("region", "lat", "lon"), places, km)
    most = F.max_by("p_geonameid", F.struct(F.coalesce("p_population", F.lit(0)), -F.col("p_geonameid")))
    return near.groupBy("region").agg(most.alias("geonameid"))


def _first(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, geonameid, score, method, ambiguous, rivals, margin) of names that are an alias: the place with the most people; ambiguous where the next has over RIVAL of them."""
    hit = names.join(aliases.select(F.col("alias").alias("query"), "geonameid", F.coalesce("population", F.lit(0)).alias("population")).distinct(), "query")
    own = hit.groupBy("query", "geonameid").agg(F.max("population").alias("population"))
    w = Window.partitionBy("query").orderBy(F.desc("population"), "geonameid")
    ranked = own.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("population").over(w)).withColumn("rivals", F.count(F.lit(1)).over(Window.partitionBy("query")))
    rival = F.coalesce(F.col("next") > F.col("population") * RIVAL, F.lit(False))
    return ranked.where("k = 1").select("query", "geonameid", F.lit(100.0).alias("score"), F.lit("exact").alias("method"), rival.alias("ambiguous"), "rivals", F.lit(None).cast("double").alias("margin"))


def by_region(names: DataFrame, places: DataFrame) -> DataFrame:
    found = region_places(places).withColumnRenamed("region", "query")
    return names.join(F.broadcast(found), "query").select("query", "geonameid", F.lit(95.0).alias("score"), F.lit("region_table").alias("method"), F.lit(False).alias("ambiguous"), F.lit(1).cast("long").alias("rivals"), F.lit(None).cast("double").alias("margin"))


def alike(names: DataFrame, aliases: DataFrame, threshold: float = 72.0, close: float = 5.0) -> DataFrame:
    """Names by likeness to aliases that share a trigram with them, compared where the lengths allow the threshold."""
    ship_package(names.sparkSession)
    grams = lambda df, c: df.select(c, F.explode(T.trigrams(F.col(c))).alias("g"))
    own = aliases.select("alias").distinct()
    room = F.least(F.length("query"), F.length("alias")) * 200.0 >= threshold * (F.length("query") + F.length("alias"))
    pairs = grams(names, "query").join(grams(own, "alias"), "g").where(room).select("query", "alias").distinct()
    scored = pairs.withColumn("score", similar.token_sort_ratio(F.col("query"), F.col("alias"))).where(F.col("score") >= threshold)
    by_place = scored.join(aliases.select("alias", "geonameid", F.coalesce("population", F.lit(0)).alias("population")), "alias").groupBy("query", "geonameid").agg(F.max("score").alias("score"), F.max("population").alias("population"))
    w, group = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("population"), "geonameid"), Window.partitionBy("query")
    ranked = by_place.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("best", F.max("score").over(group))
    ranked = ranked.withColumn("rivals", F.sum((F.col("score") >= F.col("best") - close).cast("long")).over(group))
    return ranked.where("k = 1").select("query", "geonameid", "score", F.lit("trigram_fuzzy").alias("method"), (F.col("rivals") > 1).alias("ambiguous"), "rivals", (F.col("score") - F.col("next")).alias("margin"))


def by_country(names: DataFrame, places: DataFrame) -> DataFrame:
    top = _first(places.where("country is not null"), ["country"], F.desc(F.coalesce("population", F.lit(0))), "geonameid").select(F.col("country").alias("code"), "geonameid")
    return names.withColumn("code", country_code(F.col("query"))).join(top, "code").select("query", "geonameid", F.lit(93.0).alias("score"), F.lit("query").alias("method"), F.lit(False).alias("ambiguous"), F.lit(1).cast("long").alias("rivals"), F.lit(None).cast("double").alias("margin"))


def forward(names: DataFrame, name: str, places: DataFrame, aliases: DataFrame, threshold: float = 72.0, entity_type: str | None = None) -> DataFrame:
    """names with geonameid, score, method, ambiguous and confidence, null where nothing fits. Each distinct name is resolved once: exact, then historical regions, then likeness, then countries; the first that answers."""
    keyed = names.withColumn("query", T.normal_place(F.col(name)))
    left = keyed.where("query <> ''").select("query").distinct()
    found = None
    for stage in (lambda n: exact(n, aliases), lambda n: by_region(n, places), lambda n: alike(n, aliases, threshold), lambda n: by_country(n, places)):
        got = stage(left)
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("query"), "query", "left_anti")
    kind = F.col(entity_type) if entity_type else F.lit(None).cast("string")
    out = keyed.join(found, "query", "left")
    return out.withColumn("confidence", F.when(F.col("geonameid").isNotNull(), confidence(F.col("score"), F.col("method"), F.col("ambiguous"), F.col("query"), kind, F.col("rivals"), F.col("margin"))))


def resolve_all(names: DataFrame, name: str, places: DataFrame, aliases: DataFrame, **settings) -> DataFrame:
    """forward without the names that nothing fits."""
    return forward(names, name, places, aliases, **settings).where("geonameid is not null")


def coherent(candidates: DataFrame, by: list[str], name: str) -> DataFrame:
    """One place a name and group, of candidates (geonameid, lat, lon, population): the one with most people, where it has over five times the next's; else by people and nearness to the best places of the group's other names.

    Mean distances need a pair of each open candidate and each other name of its own group (a document): a pair of names, not of rows.
    """
    own = candidates.withColumn("__pop", F.coalesce("population", F.lit(0)))
    key = [*by, name]
    w = Window.partitionBy(*key).orderBy(F.desc("__pop"), "geonameid")
    ranked = own.withColumn("__k", F.row_number().over(w)).withColumn("__next", F.lead("__pop").over(w))
    best = ranked.where("__k = 1")
    clear = best.where("__next is null or __pop > 5 * greatest(__next, 1)").select(*key)
    open_ = own.join(clear, key, "left_anti").select(*key, "geonameid", "lat", "lon", "__pop")
    other = best.select(*by, F.col(name).alias("__other"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    met = open_.join(other, by, "left").where(F.col("__other").isNull() | (F.col("__other") != F.col(name)))
    km = G.haversine(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    near = met.groupBy(*key, "geonameid", "__pop").agg(F.avg(km).alias("__km"))
    # a name alone in its group has no other: people decide, as in best
    score = F.sqrt(F.greatest("__pop", F.lit(1))) * (1 + 0.5 * F.exp(-F.col("__km") / 500.0))
    chosen = _first(near.withColumn("__s", score), key, F.desc("__s"), F.desc("__pop"), "geonameid").select(*key, F.col("geonameid").alias("__chosen"))
    return best.select(*key, "geonameid").join(chosen, key, "left").select(*key, F.coalesce("__chosen", "geonameid").alias("geonameid"))


def centre(names: DataFrame, name: str, places: DataFrame, aliases: DataFrame, **settings) -> DataFrame:
    """names with lat, lon and radius: of a historical region, else of the place, with 50 km."""
    found = forward(names, name, places, aliases, **settings).join(places.select("geonameid", F.col("lat").alias("__lat"), F.col("lon").alias("__lon")), "geonameid", "left")
    table = F.broadcast(regions(names.sparkSession).withColumnRenamed("region", "__region"))
    out = found.join(table, F.lower(F.trim(F.col(name))) == F.col("__region"), "left")
    radius = F.coalesce("radius", F.when(F.col("__lat").isNotNull(), F.lit(50.0)))
    return out.select(*names.columns, F.coalesce("lat", "__lat").alias("lat"), F.coalesce("lon", "__lon").alias("lon"), radius.alias("radius"))


def flat_aliases(aliases: DataFrame, places: DataFrame, most: int = 12) -> DataFrame:
    """(geonameid, alias): up to ``most`` aliases of each wanted place, in their order."""
    own = aliases.join(places.select("geonameid").distinct(), "geonameid", "left_semi").select("geonameid", "alias").distinct()
    return own.withColumn("place", F.row_number().over(Window.partitionBy("geonameid").orderBy("alias"))).where(F.col("place") <= most)


def expansion(matches: DataFrame, aliases: DataFrame, most: int = 6) -> DataFrame:
    """(geonameid, term, weight) for search: a place's name with 1.0, then its likest aliases with 0.4 to 0.7, ``most`` terms in all."""
    ship_package(matches.sparkSession)
    named = matches.select("geonameid", "name").distinct()
    other = named.join(aliases.select("geonameid", F.trim("alias").alias("term")).distinct(), "geonameid").where("term <> '' and lower(term) <> lower(name)")
    weighed = other.withColumn("weight", F.bround(0.4 + 0.3 * similar.ratio(F.lower("name"), F.lower("term")) / 100.0, 2))
    ranked = weighed.withColumn("k", F.row_number().over(Window.partitionBy("geonameid").orderBy(F.desc("weight"), "term"))).where(F.col("k") < most)
    return named.select("geonameid", F.col("name").alias("term"), F.lit(1.0).alias("weight")).unionAll(ranked.select("geonameid", "term", "weight"))


def mentions_of(chunks: DataFrame, names: str, places: DataFrame, aliases: DataFrame, least: float = 0.5, **settings) -> DataFrame:
    """Mention rows of chunks (source_id, chunk_id and an array of names): resolved, of at least a confidence, the first of each place and chunk."""
    each = chunks.select("source_id", "chunk_id", F.posexplode(names).alias("nth", "matched_input"))
    found = resolve_all(each, "matched_input", places, aliases, **settings).where(F.col("confidence") >= least)
    first = _first(found, ["source_id", "chunk_id", "geonameid"], "nth")
    return first.join(places.select("geonameid", F.col("name").alias("place_name"), "lat", "lon"), "geonameid").select("source_id", "chunk_id", "geonameid", "place_name", "lat", "lon", "matched_input", "method", "confidence")


def feature(lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON point, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties")))


def clusters(points: DataFrame, zoom: int, pixels: int = 50, widest: int = 14, tile: int = 512) -> DataFrame:
    """(cx, cy, n, lat, lon): points by cells of some pixels in the web map's projection; beyond the widest zoom each place is its own."""
    if zoom > widest:
        return points.groupBy(F.col("lon").alias("cx"), F.col("lat").alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    size = tile * 2**zoom / pixels
    s = F.sin(F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col("lat")))))
    x, y = (F.col("lon") + 180) / 360, 0.5 - F.log((1 + s) / (1 - s)) / (4 * F.lit(3.141592653589793))
    return points.groupBy(F.floor(x * size).alias("cx"), F.floor(y * size).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def version(spark: SparkSession, path: str, stale_days: int = 180) -> DataFrame:
    """(file, checksum, size, age_days, stale) of gazetteer files."""
    own = spark.read.format("binaryFile").load(path)
    age = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modificationTime")) / 86400
    return own.select(F.col("path").alias("file"), F.substring(F.sha2("content", 256), 1, 16).alias("checksum"), F.col("length").alias("size"), age.alias("age_days"), (age > stale_days).alias("stale"))
