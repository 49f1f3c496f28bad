"""Pairs of names that are much alike, without comparing all with all.

Names are compared as their tokens in order, by the share of a longest common subsequence (0 to 100).
At a likeness of ``t`` at most ``(1 - t / 100) * (a + b)`` characters are inserted or deleted. The
shorter name is cut into one piece more than these, so one piece stands in the longer name as it is,
moved by no more than what is inserted or deleted before it: lengths, number and text of the piece
are the join keys. Where the longer name has over ``PIECES_UP_TO`` characters, keys are bigrams: each change touches two
at most, so of each name's bigrams, the rarest first, two such names share one of the first few.
What meets there and fits in length is compared, once.

Defined cases: null and empty names have no partners; a name is its own partner (100) where it is on
both sides; repeated names count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similar
from tessera.session import fresh_folder, ship_package

#: Under this, names share too few bigrams for a filter.
LEAST = 90.0
#: Longer names have too many pieces.
PIECES_UP_TO = 64


def bigrams(text: Column) -> Column:
    """Neighbouring pairs of signs, each with its number among its equals; of a single sign, itself."""
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array(text))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g)).cast("string")))


def _changes(short: Column, long: Column, t: float) -> Column:
    """Characters inserted or deleted at most between names of these lengths; odd if their difference is."""
    most = F.floor((1 - t / 100) * (short + long) + 1e-9).cast("int")
    return F.greatest(most - F.pmod(most - (long - short), F.lit(2)), long - short)


def _piece(form: Column, short: Column, long: Column, d: Column, i: Column, moved: Column | int) -> Column:
    start, end = F.floor(i * short / (d + 1)).cast("int"), F.floor((i + 1) * short / (d + 1)).cast("int")
    return F.struct(short.alias("na"), long.alias("nb"), i.alias("i"), F.when(start + moved >= 0, F.substring(form, start + moved + 1, end - start)).alias("piece"))


def _meet_by_pieces(forms: DataFrame, t: float) -> DataFrame:
    """(fa, fb): forms that share a piece, the shorter first."""
    form, n = F.col("form"), F.col("n")

    def own(m):
        return F.transform(F.sequence(F.lit(0), _changes(n, m, t)), lambda i: _piece(form, n, m, _changes(n, m, t), i, 0))

    def met(m):
        d, more = _changes(m, n, t), n - m
        shifts = F.sequence(-((d - more) / 2).cast("int"), ((d + more) / 2).cast("int"))
        return F.flatten(F.transform(F.sequence(F.lit(0), d), lambda i: F.transform(shifts, lambda x: _piece(form, m, n, d, i, x))))

    up = F.least(F.floor(n * (200 / t - 1) + 1e-9).cast("int"), F.lit(PIECES_UP_TO))
    down = F.ceil(n / (200 / t - 1) - 1e-9).cast("int")
    short = forms.where(n <= PIECES_UP_TO)
    keys = lambda made, name: short.select(form.alias(name), F.explode(F.array_distinct(F.flatten(made))).alias("key")).select(name, "key.*").where(F.col("piece").isNotNull())
    x, y = keys(F.transform(F.sequence(n, up), own), "fa"), keys(F.transform(F.sequence(down, n), met), "fb")
    return x.join(y, ["na", "nb", "i", "piece"]).where((F.col("na") < F.col("nb")) | (F.col("fa") <= F.col("fb"))).select("fa", "fb").distinct()


def _meet_by_bigrams(forms: DataFrame, threshold: float) -> DataFrame:
    """(fa, fb): forms that share one of their rarest bigrams, one of them at least over PIECES_UP_TO."""
    grams = forms.where(F.col("n") * 200 >= threshold * (F.col("n") + PIECES_UP_TO + 1)).select("form", "n", F.explode(bigrams(F.col("form"))).alias("g"))
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("form").orderBy("c", "g"))
    # the longest partner of a name has 200 / t - 1 times its length
    changes = F.floor((1 - threshold / 100) * F.col("n") * 200 / threshold + 1e-9)
    keys = grams.join(counts, "g").withColumn("k", rank).where(F.col("k") <= 2 * changes + 1).select("form", "n", "g")
    x, y = keys.select(F.col("form").alias("fa"), F.col("n").alias("na"), "g"), keys.select(F.col("form").alias("fb"), F.col("n").alias("nb"), "g")
    room = 200.0 * F.least("na", "nb") >= threshold * (F.col("na") + F.col("nb"))
    return x.join(y, "g").where(room & (F.greatest("na", "nb") > PIECES_UP_TO) & (F.col("fa") <= F.col("fb"))).select("fa", "fb").distinct()


def alike_pairs(left: DataFrame, name: str, right: DataFrame, other: str, threshold: float = 93.0) -> DataFrame:
    """(name, other, score) of all pairs of distinct names with a likeness of at least threshold."""
    if threshold < LEAST:
        raise ValueError(f"a likeness of at least {LEAST:g}")
    spark = left.sparkSession
    ship_package(spark)
    form = lambda df, c: df.select(F.col(c).cast("string").alias("name")).where(F.col("name") != "").distinct().withColumn("form", similar.sorted_tokens(F.col("name")))
    scratch = fresh_folder(spark, "alike")
    for side, df in (("a", form(left, name)), ("b", form(right, other))):
        df.write.parquet(f"{scratch}/{side}")
    # names are worked out once, however often they are used below
    a, b = (spark.read.parquet(f"{scratch}/{side}") for side in "ab")
    forms = a.select("form").unionAll(b.select("form")).distinct().withColumn("n", F.length("form"))
    forms.write.parquet(f"{scratch}/forms")
    forms = spark.read.parquet(f"{scratch}/forms")
    met = _meet_by_pieces(forms, threshold).unionAll(_meet_by_bigrams(forms, threshold))
    scored = met.withColumn("score", F.when(F.col("fa") == F.col("fb"), F.lit(100.0)).otherwise(similar.ratio(F.col("fa"), F.col("fb")))).where(F.col("score") >= threshold)
    both = scored.unionAll(scored.where("fa <> fb").select(F.col("fb"), F.col("fa"), "score"))
    return both.join(a.select(F.col("form").alias("fa"), F.col("name").alias(name)), "fa").join(b.select(F.col("form").alias("fb"), F.col("name").alias(other)), "fb").select(name, other, "score")
