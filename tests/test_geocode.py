"""Likeness, geocoding by likeness and expansion against plain versions; nulls, blanks and empty tables."""

from tessera.functions import similar
from tessera.functions import text as T
from tessera.operators import geocode as C
from tessera.operators import spatial as S
from tessera.functions.geo import haversine
from pyspark.sql import functions as F


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_common_is_the_longest_common_subsequence():
    words = ["", "a", "aab", "paris", "parsi", "saint denis", "denis saint", "ééa", "x" * 70 + "y" + "z" * 70, "xyz" * 40]
    for a in words:
        for b in words:
            assert similar.common(a, b) == plain_common(a, b)
    assert similar.likeness("", "") == 100


def tables(spark):
    places = spark.createDataFrame([(1, "Paris", 48.9, 2.4, 100, "FR"), (2, "Paris", 33.7, -95.5, 10, "US"), (3, "London", 51.5, -0.1, 90, "GB"), (4, "Baghdad", 33.4, 44.4, None, "IQ")], "geonameid long, name string, lat double, lon double, population long, country string")
    return places, places.select(T.index_form(F.col("name")).alias("alias"), "geonameid", "population")


def test_forward_takes_the_first_stage_that_answers(spark):
    places, aliases = tables(spark)
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Paris", " the PARIS ", "Mesopotamia", "Londom", "French", "qqq", "", None, "Paris"])], "i int, name string")
    got = {r["i"]: (r["geonameid"], r["method"], r["ambiguous"]) for r in C.forward(names, "name", places, aliases).collect()}
    assert got == {0: (1, "exact", True), 1: (1, "exact", True), 2: (4, "region_table", False), 3: (3, "trigram_fuzzy", False), 4: (1, "query", False), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: (1, "exact", True)}
    assert C.resolve_all(names, "name", places.limit(0), aliases.limit(0)).count() == 0


def test_likeness_stage_agrees_with_all_pairs(spark):
    _, aliases = tables(spark)
    own = {r["alias"] for r in aliases.collect()}
    names = ["pariss", "aris", "londn", "bagdad", "lon don"]
    got = {r["query"]: r["score"] for r in C.alike(spark.createDataFrame([(n,) for n in names], "query string"), aliases, 72).collect()}
    level = lambda t: " ".join(sorted(t.split()))
    best = {n: max(200 * plain_common(level(n), level(a)) / (len(n) + len(a)) for a in own) for n in names}
    assert got == {n: s for n, s in best.items() if s >= 72}


def test_expansion_weighs_aliases(spark):
    matches = spark.createDataFrame([(1, "Rome")], "geonameid long, name string")
    aliases = spark.createDataFrame([(1, a) for a in ["rome", "roma", "Urbs", " ", None, "romae", "r", "ro", "rom"]], "geonameid long, alias string")
    got = {r["term"]: r["weight"] for r in C.expansion(matches, aliases, 4).collect()}
    assert got == {"Rome": 1.0, "romae": 0.67, "rom": 0.66, "roma": 0.62}


def test_radius_join_at_poles_and_date_line(spark):
    at = [(0, 89.9, 10.0), (1, 89.9, -170.0), (2, 0.0, 179.9), (3, 0.0, -179.9), (4, -89.99, 0.0), (5, 45.0, 45.0), (6, None, 1.0)]
    df = spark.createDataFrame(at, "id int, lat double, lon double")
    got = {(r["id"], r["p_id"]) for r in S.radius_join(df, df, 50.0).collect()}
    p = df.select(*(F.col(c).alias(f"p_{c}") for c in df.columns))
    want = {(r["id"], r["p_id"]) for r in df.crossJoin(p).where(haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= 50).collect()}
    assert got == want and (0, 1) in got and (2, 3) in got
