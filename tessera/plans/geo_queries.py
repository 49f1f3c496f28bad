"""Queries on places: distances, boosts, joins by distance, alias search. Coordinates are made from keys, alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.functions import text as T
from tessera.operators import spatial as S
from tessera.registry import query
from tessera.session import table

SQL_PLACES = "places AS (SELECT s_suppkey AS id, s_name AS name, (s_suppkey * 37 % 180)::DOUBLE - 90 AS lat, (s_suppkey * 73 % 360)::DOUBLE - 180 AS lon FROM supplier)"
SQL_POINTS = "points AS (SELECT c_custkey AS cid, (c_custkey * 37 % 180)::DOUBLE - 90 AS lat, (c_custkey * 73 % 360)::DOUBLE - 180 AS lon FROM customer)"
SQL_KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def _at(key):
    return ((F.col(key) * 37 % 180).cast("double") - 90).alias("lat"), ((F.col(key) * 73 % 360).cast("double") - 180).alias("lon")


def places(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), *_at("s_suppkey"))


def points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cid"), *_at("c_custkey"))


@query("ge01_haversine", f"WITH {SQL_POINTS}, o AS (SELECT 48.85 AS lat, 2.35 AS lon) SELECT cid, round({SQL_KM.format(a='p', b='o')}, 3) AS km FROM points p, o")
def ge01(spark, d):
    return points(spark, d).select("cid", F.round(G.haversine(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 3).alias("km"))


@query("ge02_unit_vector", f"WITH {SQL_POINTS} SELECT cid, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS y, round(sin(radians(lat)), 6) AS z FROM points")
def ge02(spark, d):
    v = points(spark, d).select("cid", G.unit_vector(F.col("lat"), F.col("lon")).alias("v"))
    return v.select("cid", (F.round("v.x", 6) + 0.0).alias("x"), (F.round("v.y", 6) + 0.0).alias("y"), F.round("v.z", 6).alias("z"))


@query("ge05_geo_boost", f"WITH {SQL_POINTS}, o AS (SELECT 10.0 AS lat, 10.0 AS lon), k AS (SELECT cid, {SQL_KM.format(a='p', b='o')} AS km FROM points p, o) SELECT cid, round(CASE WHEN km > 4000 THEN 0.0 ELSE 0.18 * power(2.0, -km / 1000.0) * least(1.0, cid % 10 / 5.0) END, 6) AS boost FROM k")
def ge05(spark, d):
    km = G.haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(10.0))
    return points(spark, d).select("cid", F.round(G.boost(km, 2000.0, F.col("cid") % 10 / 5.0), 6).alias("boost"))


@query("jn08_radius_join", f"WITH {SQL_PLACES}, {SQL_POINTS}, j AS (SELECT cid, q.id AS place, {SQL_KM.format(a='p', b='q')} AS km FROM points p, places q) SELECT cid, place, round(km, 3) AS km FROM j WHERE km <= 500")
def jn08(spark, d):
    return S.radius_join(points(spark, d), places(spark, d), 500.0).select("cid", F.col("p_id").alias("place"), F.round("km", 3).alias("km"))


@query("jn09_nearest", f"WITH {SQL_PLACES}, {SQL_POINTS}, j AS (SELECT cid, q.id AS place, round({SQL_KM.format(a='p', b='q')}, 6) AS km FROM points p, places q), r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY km, place) AS rank FROM j) SELECT cid, place, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def jn09(spark, d):
    return S.nearest(points(spark, d), places(spark, d), "cid", "id", 3).select("cid", F.col("p_id").alias("place"), "rank")


@query("jn07_trigram_candidates", """
WITH a AS (SELECT c_custkey, unnest(list_distinct(list_transform(generate_series(1, length(c_name) + 2), lambda i: substring('  ' || lower(c_name) || '  ', i, 3)))) AS g FROM customer),
q AS (SELECT s_suppkey, unnest(list_distinct(list_transform(generate_series(1, length(s_name) + 2), lambda i: substring('  ' || lower(s_name) || '  ', i, 3)))) AS g FROM supplier),
c AS (SELECT s_suppkey, c_custkey, count(*) AS shared FROM q JOIN a USING (g) GROUP BY ALL)
SELECT s_suppkey, c_custkey, shared FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY shared DESC, c_custkey) AS k FROM c) WHERE k <= 20""")
def jn07(spark, d):
    """Names by shared trigrams, the likeliest twenty of each query."""
    from tessera.operators.retrieval import most_shared

    a = table(spark, d, "customer").select("c_custkey", T.trigrams(F.lower("c_name")).alias("own"))
    q = table(spark, d, "supplier").select("s_suppkey", T.trigrams(F.lower("s_name")).alias("own"))
    return most_shared(q, "s_suppkey", a, "c_custkey", 20).select("s_suppkey", "c_custkey", "shared")


@query("ge13_context_score", f"WITH {SQL_PLACES}, o AS (SELECT 40.0 AS lat, -74.0 AS lon) SELECT id, round(5 * sqrt(id / 1000.0) + CASE WHEN id % 3 = 0 THEN 4 ELSE 0 END + 1.5 * exp(-({SQL_KM.format(a='p', b='o')}) / 150), 6) AS score FROM places p, o")
def ge13(spark, d):
    km = G.haversine(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-74.0))
    return places(spark, d).select("id", F.round(5 * F.sqrt(F.col("id") / 1000.0) + F.when(F.col("id") % 3 == 0, 4).otherwise(0) + 1.5 * F.exp(-km / 150), 6).alias("score"))


@query("sc22_place_aliases", "WITH n AS (SELECT s_suppkey, s_name, unnest(list_distinct([lower(trim(s_name)), lower(trim(replace(s_name, '_', ' '))), lower(trim('alt ' || s_suppkey))])) AS alias FROM supplier) SELECT alias, s_suppkey AS geonameid FROM n")
def sc22(spark, d):
    from tessera.sources.files import place_aliases

    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("geonameid"), F.col("s_name").alias("name"), F.regexp_replace("s_name", "_", " ").alias("asciiname"), F.concat(F.lit("alt "), F.col("s_suppkey").cast("string")).alias("altnames"), F.lit(1).alias("population"))
    return place_aliases(own).select("alias", "geonameid")
