"""Joins by distance: grid cells make them equi-joins. Distances are worked out between distinct coordinates, however many rows share them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import RADIUS_KM, chord, haversine, unit_vector
from tessera.session import fresh_folder

#: Points at one spot are dealt to at most so many tasks.
SHARES = 16


def _located(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def _renamed(places: DataFrame) -> DataFrame:
    return places.select(*(F.col(c).alias(f"p_{c}") for c in places.columns))


def _close(spots: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """spots (lat, lon) and sites (p_lat, p_lon) within km of each other, all columns and ``km``. The sphere lies in a grid of cubes with the chord of km as edge: a site is in one cube, a spot meets the 27 around it. Poles and the date line are like any other place."""
    edge = max(chord(km), 1e-9) * (1 + 1e-9)

    def cubed(df: DataFrame, lat: str, lon: str) -> DataFrame:
        v = unit_vector(F.col(lat), F.col(lon))
        return df.withColumns({f"__{x}": F.floor(v[x] / edge) for x in "xyz"})

    steps = F.array(*(F.struct(*(F.lit(o).alias(x) for x, o in zip("xyz", off))) for off in itertools.product((-1, 0, 1), repeat=3)))
    left = cubed(spots, "lat", "lon").withColumn("__o", F.explode(steps)).withColumns({f"__{x}": F.col(f"__{x}") + F.col(f"__o.{x}") for x in "xyz"}).drop("__o")
    near = left.join(cubed(sites, "p_lat", "p_lon"), ["__x", "__y", "__z"]).drop("__x", "__y", "__z").withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    return near.where(F.col("km") <= km)


def radius_join(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """Pairs within km. points and places have lat and lon; places' columns are named with a leading p_. Spots and sites are joined first; then their rows meet, those of a spot in up to SHARES tasks. Rows without coordinates meet nothing."""
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = _located(points).withColumn("__share", F.pmod(F.xxhash64(*points.columns), F.lit(SHARES)).cast("int"))
    right = _located(_renamed(places), "p_lat", "p_lon")
    spots = own.groupBy("lat", "lon").agg(F.collect_set("__share").alias("__shares"))
    near = _close(spots, right.select("p_lat", "p_lon").distinct(), km).withColumn("__share", F.explode("__shares")).drop("__shares")
    # few rows make many pairs, so their size says nothing of the work: the number of tasks is given
    met = near.join(right, ["p_lat", "p_lon"]).repartition(tasks, "lat", "lon", "__share")
    pairs = own.repartition(tasks, "lat", "lon", "__share").hint("merge").join(met, ["lat", "lon", "__share"])
    return pairs.select(*points.columns, *right.columns, "km")


def nearest(points: DataFrame, places: DataFrame, key: str, place_key: str, k: int = 1) -> DataFrame:
    """The k nearest places of each point, equally near ones (to a millimetre) by place_key. Of the places of one site only the first k by place_key can be among them. Spots look within a reach that doubles until k places are nearer than it. Where coordinates are missing, km is null and comes last."""
    spark = points.sparkSession
    scratch = fresh_folder(spark, "nearest")
    right = _renamed(places)
    place = f"p_{place_key}"
    order = (F.round("km", 6).asc_nulls_last(), F.col(place).asc_nulls_last())
    first = Window.partitionBy("p_lat", "p_lon").orderBy(F.col(place).asc_nulls_last())
    _located(right, "p_lat", "p_lon").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k).drop("__n").write.parquet(f"{scratch}/sites")
    sites = spark.read.parquet(f"{scratch}/sites")
    _located(points).select("lat", "lon").distinct().write.parquet(f"{scratch}/spots-0")
    reach, turn, found = min(4 * RADIUS_KM * math.sqrt(k / max(1, sites.count())), 4 * RADIUS_KM), 0, []
    while True:
        spots, last = spark.read.parquet(f"{scratch}/spots-{turn}"), reach > math.pi * RADIUS_KM
        close = spots.crossJoin(sites).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))) if last else _close(spots, sites, reach)
        best = close.withColumn("__k", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(*order))).where(F.col("__k") <= k).drop("__k")
        sure = F.count(F.when(F.col("km") < reach - 1e-5, 1)).over(Window.partitionBy("lat", "lon")) == k
        (best if last else best.withColumn("__sure", sure).where("__sure").drop("__sure")).write.parquet(f"{scratch}/found-{turn}")
        found.append(spark.read.parquet(f"{scratch}/found-{turn}"))
        left = spots.join(found[-1].select("lat", "lon").distinct(), ["lat", "lon"], "left_anti")
        if last or left.isEmpty():
            break
        turn, reach = turn + 1, reach * 2
        left.write.parquet(f"{scratch}/spots-{turn}")
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    # places without coordinates come last, and a point without them has all places so
    none = F.lit(None).cast("double")
    lost = right.where(F.col("p_lat").isNull() | F.col("p_lon").isNull()).orderBy(F.col(place).asc_nulls_last()).limit(k)
    some = right.orderBy(F.col(place).asc_nulls_last()).limit(k)
    there = points.where(F.col("lat").isNull() | F.col("lon").isNull())
    pairs = _located(points).join(near, ["lat", "lon"]).unionByName(_located(points).crossJoin(F.broadcast(lost)).withColumn("km", none)).unionByName(there.crossJoin(F.broadcast(some)).withColumn("km", none))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(*points.columns, *right.columns, "km", "rank")
