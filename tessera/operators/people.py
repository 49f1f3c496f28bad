"""Resolution of person mentions into canonical names, in order, as a registry that grows would give it.

A mention goes to the entry that has its normal name; else, by its surname, to the only entry known by
the bare surname, or (a bare surname) to the entry of most mentions and longest name if one alone is
first, or to the entry with the likest name of that surname (96); else to the entry with the likest of
all names (93); else it is a new entry. An entry is called by the name with most tokens, then most
characters, that it has had so far; each mention keeps the name that held when it came.

That is a chain of decisions, but only the first mention of a name decides anything: later ones are
exact, and merely count. So:

1. names are put into blocks that no decision crosses: those joined by a surname or by likeness
   (``similar_join``), as components of the graph of surnames;
2. within a block the first mentions of its distinct names are folded in order; the counts that bare
   surnames are decided by are summed beforehand, in Spark;
3. the fold gives each name's canonical names over time, and mentions are joined with these. A block
   holds names, not mentions: a surname with a third of all mentions is a few rows there.

Defined cases: mentions whose name is null, blank or only titles are dropped; NER scores that are null
or no numbers count as 0, and are held within [0, 1]; mentions are ordered by the given columns, and
repeated rows count each; names that are equally like go to the lesser one; empty tables give none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.operators.similar_join import alike_pairs
from tessera.session import fresh_folder, ship_package

#: Likeness by surname, and of whole names, at which a name is taken for another.
BY_SURNAME, BY_NAME = 96.0, 93.0
#: Confidence that a mention needs, as found and as resolved.
LEAST_NER, LEAST_CONFIDENCE = 0.70, 0.70


class Registry:
    """Entries of one block: what each is called, its normal names, and who has which."""

    def __init__(self):
        self.called: list[str] = []
        self.names: list[list[str]] = []
        self.owner: dict[str, int] = {}
        self.kin: dict[str, list[str]] = {}

    @staticmethod
    def rank(name: str) -> tuple[int, int]:
        return len(name.split()), len(name)

    def find(self, normal: str, count, alike: dict[str, float]) -> tuple[int | None, str, float]:
        """(entry, method, share of likeness). count(name): its mentions so far. alike: likenesses of at least BY_NAME to other names."""
        if normal in self.owner:
            return self.owner[normal], "exact", 1.0
        last = normal.split(" ")[-1]
        kin = self.kin.get(last, ())
        entries = {self.owner[n] for n in kin}
        if " " in normal and last in kin and len(entries) == 1:
            return entries.pop(), "fuzzy_last", 1.0
        if " " not in normal and entries:
            placed = sorted(((sum(map(count, self.names[e])), self.rank(self.called[e])), e) for e in entries)
            if len(placed) == 1 or placed[-1][0] > placed[-2][0]:
                return placed[-1][1], "fuzzy_last", 1.0
        known = [(-x, n) for n, x in alike.items() if n in self.owner]
        for among, least, method in (([x for x in known if x[1].split(" ")[-1] == last], BY_SURNAME, "fuzzy_last"), (known, BY_NAME, "fuzzy_full")):
            best = min((x for x in among if -x[0] >= least), default=None)
            if best:
                return self.owner[best[1]], method, -best[0] / 100
        return None, "new", 0.0

    def meet(self, normal: str, display: str, count, alike: dict[str, float]) -> tuple[int, str, float, bool]:
        """Resolves the first mention of a name, or of another display of it; whether the entry is called otherwise now."""
        entry, method, share = self.find(normal, count, alike)
        if entry is None:
            entry = len(self.called)
            self.called.append(display)
            self.names.append([])
        if normal not in self.owner:
            self.owner[normal] = entry
            self.names[entry].append(normal)
            self.kin.setdefault(normal.split(" ")[-1], []).append(normal)
        better = self.rank(display) > self.rank(self.called[entry])
        if better:
            self.called[entry] = display
        return entry, method, share, better


def merge(survivor: dict, absorbed: dict) -> dict:
    """Two entries as one: mentions summed, sources joined, variants' counts added."""
    variants = dict(survivor["variants"])
    for name, n in absorbed["variants"].items():
        variants[name] = variants.get(name, 0) + n
    return survivor | {"mention_count": survivor["mention_count"] + absorbed["mention_count"], "source_ids": sorted({*survivor["source_ids"], *absorbed["source_ids"]}), "variants": variants}


def _fold(rows: pd.DataFrame) -> Iterator[tuple]:
    """Of a block: (normal, place, canonical) whenever it changes, with method and share at a name's first mention."""
    alike: dict[str, dict[str, float]] = {}
    counts: dict[str, tuple[list[int], list[int]]] = {}
    for r in rows[rows["kind"] == "pair"].itertuples():
        alike.setdefault(r.a, {})[r.b] = r.x
    # of each name, its mentions up to a moment, as sums
    for r in rows[rows["kind"] == "count"].sort_values("k").itertuples():
        moments, sums = counts.setdefault(r.a, ([], [0]))
        moments.append(r.k)
        sums.append(sums[-1] + int(r.x))

    def so_far(name: str, before: int) -> int:
        moments, sums = counts.get(name, ((), (0,)))
        return sums[bisect_right(moments, before)]

    registry, surnames = Registry(), 0
    for r in rows[rows["kind"] == "name"].sort_values("k").itertuples():
        # mentions before this one, if it is a bare surname's first: those that came before so many of these
        before = surnames
        known = r.a in registry.owner
        entry, method, share, better = registry.meet(r.a, r.b, lambda n, before=before: so_far(n, before), alike.get(r.a, {}))
        if " " not in r.a and not known:
            surnames += 1
        if not known:
            yield r.a, r.k, registry.called[entry], method, share
        if better:
            for name in registry.names[entry]:
                if known or name != r.a:
                    yield name, r.k, registry.called[entry], None, 0.0


def _components(edges: DataFrame, scratch: str) -> DataFrame:
    """(node, block): nodes of a graph by the least node that they reach; edges of both directions, with loops. Labels jump along labels, so long paths take few rounds."""
    spark = edges.sparkSession
    labels = edges.groupBy("a").agg(F.min("b").alias("block")).withColumnRenamed("a", "node")
    turn = 0
    while True:
        labels.write.mode("overwrite").parquet(f"{scratch}/labels-{turn}")
        labels = spark.read.parquet(f"{scratch}/labels-{turn}")
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("block").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "block", F.least("block", "least").alias("least"))
        far = labels.select(F.col("node").alias("least"), F.col("block").alias("jump"))
        after = lower.join(far, "least", "left").select("node", "block", F.least("least", "jump").alias("next"))
        after.write.mode("overwrite").parquet(f"{scratch}/next-{turn}")
        after = spark.read.parquet(f"{scratch}/next-{turn}")
        if after.where("next < block").isEmpty():
            return labels
        labels, turn = after.select("node", F.col("next").alias("block")), turn + 1


def resolve(mentions: DataFrame, raw: str, order: list[str], ner: str | None = None) -> DataFrame:
    """mentions that have a name, all columns, with canonical_name, method, confidence and role_hint. order: columns that put mentions in order; equal ones count as one moment, ordered by the name as it stands."""
    spark = mentions.sparkSession
    ship_package(spark)
    scratch = fresh_folder(spark, "people")
    score = F.coalesce(F.col(ner).try_cast("double"), F.lit(0.0)) if ner else F.lit(0.0)
    held = mentions.select(F.struct(*mentions.columns).alias("row"), N.collapse_spaces(F.col(raw)).alias("said"), F.struct(*order, N.collapse_spaces(F.col(raw)).alias("said")).alias("at"), F.when(F.isnan(score), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).alias("ner"))
    held.withColumn("normal", N.normalize_name(F.col("said"))).withColumn("display", N.display_form(F.col("said"))).where("normal <> ''").write.parquet(f"{scratch}/mentions")
    held = spark.read.parquet(f"{scratch}/mentions")
    held.groupBy("normal", "display").agg(F.min("at").alias("at")).write.parquet(f"{scratch}/names")
    first = spark.read.parquet(f"{scratch}/names")
    distinct = first.select("normal").distinct()
    alike_pairs(distinct, "normal", distinct.select(F.col("normal").alias("other")), "other", BY_NAME).where("normal <> other").write.parquet(f"{scratch}/pairs")
    pairs = spark.read.parquet(f"{scratch}/pairs")
    # blocks of surnames
    ends = pairs.select(N.last_token(F.col("normal")).alias("a"), N.last_token(F.col("other")).alias("b")).where("a <> b").distinct()
    surnames = distinct.select(N.last_token(F.col("normal")).alias("a")).distinct()
    blocks = _components(ends.unionAll(surnames.select("a", F.col("a").alias("b"))), scratch)
    named = first.withColumn("surname", N.last_token(F.col("normal"))).join(blocks, F.col("surname") == F.col("node")).select("block", "normal", "display", "at")
    numbered = named.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("at", "normal", "display")).cast("long"))
    numbered.write.parquet(f"{scratch}/numbered")
    numbered = spark.read.parquet(f"{scratch}/numbered")
    block_of = numbered.select("normal", "block").distinct()
    # where bare surnames are decided, how many mentions came before
    bare = numbered.where(~F.contains("normal", F.lit(" "))).groupBy("block", "normal").agg(F.min("at").alias("at"))
    seen = held.groupBy("normal", "at").agg(F.count(F.lit(1)).alias("n")).join(block_of.join(bare.select("block").distinct(), "block"), "normal")
    moments = seen.select("block", "normal", "at", "n", F.lit(0).alias("met")).unionAll(bare.select("block", F.lit(None).cast("string"), "at", F.lit(0).cast("long"), F.lit(1)))
    # a running sum, equal moments counting together: no list of a block's moments is held
    counts = moments.withColumn("k", F.sum("met").over(Window.partitionBy("block").orderBy("at"))).where("normal is not null").groupBy("block", "normal", "k").agg(F.sum("n").alias("n"))
    parts = (
        numbered.select("block", F.lit("name").alias("kind"), F.col("normal").alias("a"), F.col("display").alias("b"), "k", F.lit(0.0).alias("x"))
        .unionAll(counts.select("block", F.lit("count"), "normal", F.lit(None).cast("string"), F.col("k").cast("long"), F.col("n").cast("double")))
        .unionAll(pairs.join(block_of, "normal").select("block", F.lit("pair"), "normal", "other", F.lit(0).cast("long"), "score"))
    )
    columns = ["block", "normal", "k", "canonical", "method", "share"]

    def folded(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in _fold(rows)], columns=columns)

    told = parts.groupBy("block").applyInPandas(folded, "block string, normal string, k long, canonical string, method string, share double")
    timed = told.join(numbered.select("block", "k", "at"), ["block", "k"])
    lines = timed.groupBy("normal").agg(F.array_sort(F.collect_list(F.struct("at", "k", "canonical"))).alias("line"), F.min(F.when(F.col("method").isNotNull(), F.struct("at", "method", "share"))).alias("start"))
    found = held.join(lines, "normal")
    fresh = (F.col("at") == F.col("start.at")) & (F.row_number().over(Window.partitionBy("normal", "at").orderBy("ner")) == 1)
    found = found.withColumn("fresh", fresh)
    share = F.when(F.col("fresh"), F.col("start.share")).otherwise(F.lit(1.0))
    return found.select(
        "row.*", F.element_at(F.filter("line", lambda x: x["at"] <= F.col("at")), -1)["canonical"].alias("canonical_name"),
        F.when(F.col("fresh"), F.col("start.method")).otherwise(F.lit("exact")).alias("method"), F.round(F.greatest("ner", share), 4).alias("confidence"), N.role_hint().alias("role_hint"),
    )


def registry(resolved: DataFrame, raw: str, source: str) -> DataFrame:
    """Per canonical name: mention_count, source_ids and variants with their counts, of the mentions as they stand."""
    own = resolved.groupBy("canonical_name", N.collapse_spaces(F.col(raw)).alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(source).alias("sources"))
    return own.groupBy("canonical_name").agg(F.sum("n").alias("mention_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_ids"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "n")))).alias("variants"))


def without(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """A registry (canonical_name, mention_count, source_ids, variants) after mentions (canonical_name, raw_name, source_id) were taken away: counts and variants go down, none below 0, entries without mentions go, what is left is called by its best name, and a source that was named goes too. Entries that are called alike then are one."""
    gone = removed.select("canonical_name", N.collapse_spaces(F.col("raw_name")).alias("variant"), F.col("source_id")).groupBy("canonical_name", "variant").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source_id").alias("sources"))
    per = gone.groupBy("canonical_name").agg(F.sum("n").alias("less"), F.map_from_entries(F.collect_list(F.struct("variant", "n"))).alias("fewer"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("left_sources"))
    own = entries.join(per, "canonical_name", "left")
    kept = F.map_filter(F.transform_values("variants", lambda k, n: n - F.coalesce(F.try_element_at("fewer", k), F.lit(0))), lambda k, n: n > 0)
    variants = F.when(F.col("fewer").isNull(), F.col("variants")).otherwise(kept)
    after = own.select("canonical_name", (F.col("mention_count") - F.coalesce("less", F.lit(0))).alias("mention_count"), F.array_except("source_ids", F.coalesce("left_sources", F.array().cast("array<string>"))).alias("source_ids"), variants.alias("variants"), F.col("fewer").isNotNull().alias("touched")).where("mention_count > 0")
    best = F.aggregate(F.map_keys("variants"), N.display_form(F.col("canonical_name")), lambda acc, v: N.better_display(acc, N.display_form(v)))
    called = after.withColumn("canonical_name", F.when(F.col("touched"), best).otherwise(F.col("canonical_name")))
    flat = called.select("canonical_name", "mention_count", "source_ids", F.explode_outer("variants").alias("v", "n")).groupBy("canonical_name", "v").agg(F.sum("n").alias("n"))
    maps = flat.where("v is not null").groupBy("canonical_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("variants"))
    sums = called.groupBy("canonical_name").agg(F.sum("mention_count").alias("mention_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"))
    return sums.join(maps, "canonical_name", "left").withColumn("variants", F.coalesce("variants", F.map_from_entries(F.array().cast("array<struct<k:string,n:bigint>>"))))


def peopletag(mentions: DataFrame, raw: str, source: str, snippet: str, order: list[str], ner: str) -> DataFrame:
    """Mentions found with LEAST_NER or more, one for each (source, lower-cased name, snippet), resolved, and those of LEAST_CONFIDENCE kept."""
    sure = mentions.where(F.col(ner) >= LEAST_NER)
    one = F.row_number().over(Window.partitionBy(source, F.lower(N.collapse_spaces(F.col(raw))), snippet).orderBy(*order))
    first = sure.withColumn("__k", one).where("__k = 1").drop("__k")
    return resolve(first, raw, order, ner).where(F.col("confidence") >= LEAST_CONFIDENCE)
