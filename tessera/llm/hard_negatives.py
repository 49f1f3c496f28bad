"""Hard-negative mining over one-dimensional distance keys.

Vectors become whole numbers, ``floor(256 * x)``, and scores their inner products. With one more
component, ``sqrt(M - |v|^2)`` where ``M`` is the largest squared length, the score of an anchor ``a``
orders rows as the distance does: ``d^2 = M + |a|^2 - 2 * score``.

1. Pivots are centres of a sample of at most ``SAMPLE`` rows. Every row gets the key (nearest pivot,
   distance to it), and the rows are stored sorted by it, in a table of the shared folder.
2. For a wanted list (the 5 best rows of an anchor's label; then, for each of those, the 5 best rows
   of other labels within the band of its score) the sample's own list gives a distance that the true
   list cannot exceed. A row within distance ``R`` of the anchor has, at each pivot, a key within
   ``R`` of the anchor's own distance to that pivot. So intervals of keys are scanned, first those of
   a smaller ``R``, then the ring that is new. A list ends when its last distance is at most ``R``, or
   ``R`` has reached its bound; no row is left out. Files are skipped by their key statistics, runs of
   rows by their key ranges, and scores are matrix products of a run with the anchors that reach it.
3. Each task keeps the best rows of each list; a window merges the tasks' rows.

Anchors are taken in blocks of at most ``BLOCK``, in the order of keys: a stated query set against
all rows, block by block. A block's lists of positives pass the driver, results do not.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no
part; shorter vectors end in zeros; repeated rows each count, but anchors that are alike in all are
one; a row with the anchor's vec_id is never its positive; equal scores go by ascending vec_id, null
last; a null vec_id is no anchor; an anchor without positives or a positive without rows in its band
gives no rows, and so does an empty table; other columns are not read. Products are exact: doubles
where they cannot round, else 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import Scratch

#: Rows that pivots are fitted on and first bounds come from; pivots; turns of fitting.
SAMPLE, PIVOTS, TURNS = 2048, 48, 6
#: Anchors of one block; rows of a run that is scored at once.
BLOCK, RUN = 8192, 1024
#: Radii that are scanned one after the other, as shares of a list's bound.
SHARES = (0.85, 1.0)
#: Rows of a list.
LIST = 5
#: Squared lengths have to stay under this.
MOST = 1 << 62
#: Stands for a null vec_id while rows are ranked.
NO_ID = (1 << 63) - 1


def usable(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part. label: the label to use, of the table's own columns."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(256 * x).cast("long")).alias("vector"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, zeros at the end of short ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """The pivots and sizes that keys are measured by. width: components; longest: the largest squared length."""

    def __init__(self, width: int, longest: int, sample: np.ndarray):
        self.width, self.longest = width, longest
        self.exact = np.float64 if longest < 1 << 52 else np.int64
        rng, points = np.random.default_rng(7), self.lift(sample)
        centres = points[rng.permutation(len(points))[:PIVOTS]]
        for _ in range(TURNS):
            near = self.gaps(points, centres).argmin(1)
            for p in range(len(centres)):
                if (near == p).any():
                    centres[p] = points[near == p].mean(0)
        self.pivots = centres

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))])

    @staticmethod
    def gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((points * points).sum(1)[:, None] + (centres * centres).sum(1) - 2 * points @ centres.T, 0))

    def reach(self, anchors: np.ndarray) -> np.ndarray:
        """Distances of anchors (last component 0) to the pivots."""
        return self.gaps(np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))]), self.pivots)

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        return (rows.astype(self.exact) @ anchors.astype(self.exact).T).astype(np.int64)

    def distance(self, squared: np.ndarray, score: np.ndarray) -> np.ndarray:
        """squared: the anchors' squared lengths."""
        return np.sqrt(np.maximum(self.longest + squared - 2.0 * score, 0))

    @property
    def slack(self) -> float:
        """More than the rounding of any distance here."""
        return 1e-6 * (1 + self.longest**0.5)


class Lists:
    """Wanted lists of the anchors of one block: anchor (its place), own label or others', least and greatest score, and the radii scanned so far and next."""

    def __init__(self, anchor, same, least, most, bound):
        self.anchor, self.same, self.least, self.most, self.bound = anchor, same, least, most, bound
        self.inner, self.outer = np.full(len(anchor), -1.0), bound * SHARES[0]

    def take(self, at: np.ndarray) -> Lists:
        out = Lists(self.anchor[at], self.same[at], self.least[at], self.most[at], self.bound[at])
        out.inner, out.outer = self.inner[at], self.outer[at]
        return out


class Anchors:
    """Anchors of one block: ids, labels, vectors, squared lengths, and distances to the pivots."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.squared = (vectors.astype(np.float64) ** 2).sum(1)
        self.reach = space.reach(vectors)

    def __len__(self) -> int:
        return len(self.ids)


def wanted(score, row_ids, row_labels, anchors: Anchors, lists: Lists) -> np.ndarray:
    """Which (row, list) are of the list's label and within its scores. score: of each row and list."""
    own = row_labels[:, None] == anchors.labels[lists.anchor]
    return (own == lists.same) & ~(lists.same & (row_ids[:, None] == anchors.ids[lists.anchor])) & (score >= lists.least) & (score <= lists.most)


def best(of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first LIST of each list: highest score, then least id."""
    order = np.lexsort((ids, -score, of))
    rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    return order[rank < LIST]


class Scan:
    """The best rows of each list in the runs that one task sees."""

    def __init__(self, space: Space, anchors: Anchors, lists: Lists):
        self.space, self.anchors, self.lists = space, anchors, lists
        self.of, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(len(lists.anchor), -(1 << 62), np.int64)

    def run(self, pivot: int, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of one pivot, keys ascending."""
        at = self.anchors.reach[self.lists.anchor, pivot]
        inner, outer = self.lists.inner, self.lists.outer + self.space.slack
        # out of reach, or wholly in what was scanned before
        live = np.flatnonzero((keys[0] <= at + outer) & (keys[-1] >= at - outer) & ~((inner >= 0) & (np.abs(keys[0] - at) <= inner + self.space.slack) & (np.abs(keys[-1] - at) <= inner + self.space.slack)))
        if not len(live):
            return
        part = self.lists.take(live)
        own, back = np.unique(part.anchor, return_inverse=True)
        score = self.space.scores(vectors, self.anchors.vectors[own])[:, back]
        gap = np.abs(keys[:, None] - at[live])
        fits = (gap <= outer[live]) & ((part.inner < 0) | (gap > part.inner + self.space.slack)) & (score >= self.last[live])
        fits &= wanted(score, ids, labels, self.anchors, part)
        if not fits.any():
            return
        if len(keys) > LIST:
            masked = np.where(fits, score, -(1 << 62))
            fits &= masked >= np.partition(masked, len(keys) - LIST, axis=0)[len(keys) - LIST]
        row, column = np.nonzero(fits)
        of, score, ids = (np.concatenate(x) for x in ((self.of, live[column]), (self.score, score[row, column]), (self.ids, ids[row])))
        kept = best(of, score, ids)
        self.of, self.score, self.ids = of[kept], score[kept], ids[kept]
        full = np.bincount(self.of, minlength=len(self.last)) >= LIST
        least = np.full(len(self.last), 1 << 62, np.int64)
        np.minimum.at(least, self.of, self.score)
        self.last[full] = least[full]


def _runs(batches, width: int) -> Iterator[tuple]:
    """Runs of at most RUN neighbouring rows of one pivot."""
    for batch in batches:
        pivot, keys, ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        vectors = matrix(batch.column(4), width)
        cuts = np.flatnonzero((np.diff(pivot, prepend=-1) != 0) | (np.diff(keys, prepend=0) < 0)).tolist() + [len(pivot)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for a in range(lo, hi, RUN):
                b = min(a + RUN, hi)
                yield int(pivot[a]), keys[a:b], ids[a:b], labels[a:b], vectors[a:b]


class Index:
    """Rows (pivot, key, vec_id, label, vector) sorted by their keys, with the space that they are measured in and the sample."""

    def __init__(self, rows: DataFrame, space: Space | None, sample: Anchors | None):
        self.rows, self.space, self.sample = rows, space, sample


def build_index(rows: DataFrame, scratch: Scratch) -> Index:
    """rows: those of usable()."""
    spark = rows.sparkSession
    kept = scratch.save(rows, "rows")
    longest, width = kept.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)), F.max(F.size("vector"))).first()
    if longest is None:
        return Index(kept, None, None)
    if longest >= MOST:
        raise ValueError(f"a vector's squared length in 256ths is {longest:g}; scores are 64-bit whole numbers")
    longest = math.ceil(longest)
    own = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    vectors = matrix(own.column("vector").combine_chunks(), width)
    space = Space(width, longest, vectors)
    sample = Anchors(space, own.column("vec_id").to_numpy(), own.column("label").to_numpy(), vectors)
    sent = spark.sparkContext.broadcast(space)

    def keyed(batches):
        space = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, RUN):
                part = batch.slice(a, RUN)
                gaps = space.gaps(space.lift(matrix(part.column(2), space.width)), space.pivots)
                near = gaps.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(gaps[np.arange(len(near)), near]), *part.columns], names=["pivot", "key", "vec_id", "label", "vector"])

    out = kept.mapInArrow(keyed, "pivot int, key double, vec_id long, label long, vector array<bigint>")
    index = scratch.save(out.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id"), "index")
    scratch.drop("rows")
    return Index(index, space, sample)


def _near(index: Index, anchors: Anchors, lists: Lists) -> DataFrame:
    """The index's rows whose keys some list may reach: what the scan can skip by statistics."""
    at, outer, ranges = anchors.reach[lists.anchor], lists.outer[:, None] + index.space.slack, []
    lo, hi = (at - outer).min(0), (at + outer).max(0)
    for p in range(len(lo)):
        ranges.append((F.col("pivot") == p) & F.col("key").between(float(lo[p]), float(hi[p])))
    return index.rows.where(reduce(lambda a, b: a | b, ranges))


def _scanned(index: Index, anchors: Anchors, lists: Lists) -> DataFrame:
    """(list, score, vec_id): the first rows of each list among those in its new ring."""
    sent = index.rows.sparkSession.sparkContext.broadcast((index.space, anchors, lists))

    def scanned(batches):
        space, anchors, lists = sent.value
        scan = Scan(space, anchors, lists)
        for run in _runs(batches, space.width):
            scan.run(*run)
        yield pa.RecordBatch.from_arrays([pa.array(scan.of.astype(np.int32)), pa.array(scan.score), pa.array(scan.ids)], names=["list", "score", "vec_id"])

    return _first(_near(index, anchors, lists).mapInArrow(scanned, "list int, score long, vec_id long")).drop("rank")


def _bounds(index: Index, anchors: Anchors, lists: Lists, farthest: np.ndarray) -> None:
    """The distance that each list's last row cannot exceed: that of the sample's list, or else farthest."""
    sample, space = index.sample, index.space
    lists.bound = farthest.copy()
    for lo in range(0, len(lists.anchor), 4096):
        at = np.arange(lo, min(lo + 4096, len(lists.anchor)))
        part = lists.take(at)
        own, back = np.unique(part.anchor, return_inverse=True)
        score = space.scores(sample.vectors, anchors.vectors[own])[:, back]
        masked = np.where(wanted(score, sample.ids, sample.labels, anchors, part), score, -(1 << 62))
        if len(masked) >= LIST:
            last = np.partition(masked, len(masked) - LIST, axis=0)[len(masked) - LIST]
            sure = last > -(1 << 62)
            lists.bound[at[sure]] = np.minimum(farthest[at[sure]], space.distance(anchors.squared[part.anchor[sure]], last[sure]))
    lists.outer = lists.bound * SHARES[0]


def search(index: Index, anchors: Anchors, lists: Lists, scratch: Scratch, name: str) -> DataFrame:
    """(list, score, vec_id): the first rows of each ring of each list, stored; the list's own first rows are among them. Rings are scanned until every list is certified."""
    open_, found, ends = np.arange(len(lists.anchor)), [], None
    for turn, share in enumerate(SHARES):
        part = lists.take(open_)
        part.outer = part.bound * share
        part.inner = part.bound * SHARES[turn - 1] if turn else part.inner
        rows = _scanned(index, anchors, part)
        if turn:
            # the lists of one block
            names = index.rows.sparkSession.createDataFrame(pa.table([pa.array(np.arange(len(open_), dtype=np.int32)), pa.array(open_.astype(np.int32))], names=["list", "of"]))
            rows = rows.join(F.broadcast(names), "list").select(F.col("of").alias("list"), "score", "vec_id")
        found.append(scratch.save(rows, f"{name}-{turn}"))
        if share == SHARES[-1]:
            break
        # certified: LIST rows, the last of them no farther than what was scanned
        ends = found[-1].groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= LIST).toArrow()
        full, least = ends.column("list").to_numpy(), ends.column("least").to_numpy()
        far = index.space.distance(anchors.squared[lists.anchor[full]], least)
        open_ = np.setdiff1d(open_, full[far <= lists.bound[full] * share])
        if not len(open_):
            break
    return reduce(DataFrame.unionAll, found)


def _first(found: DataFrame) -> DataFrame:
    """found with the rank of each row in its list, the first LIST."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= LIST)


def _blocks(index: Index, every: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the anchors, BLOCK at a time, in the order of keys."""
    picked = index.rows.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)).distinct().orderBy("pivot", "key", "vec_id", "label", "vector").select("vec_id", "label", "vector")
    held: list = []
    for row in picked.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield _packed(held, index.space.width)
            held = []
    if held:
        yield _packed(held, index.space.width)


def _packed(rows: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        vectors[i, : len(row["vector"])] = row["vector"]
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), vectors


def mine(embeddings: DataFrame, *, label: Column | None = None, every: int = 100, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: vec_id divisible by every; a negative's score lies between share percent of its positive's score and that score."""
    spark = embeddings.sparkSession
    ship_package(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    scratch = Scratch(spark, "negatives")
    index = build_index(usable(embeddings, label), scratch)
    out = spark.createDataFrame([], schema)
    if index.space is None:
        return out
    for number, (ids, labels, vectors) in enumerate(_blocks(index, every)):
        anchors = Anchors(index.space, ids, labels, vectors)
        farthest = index.space.distance(anchors.squared, -np.sqrt(anchors.squared * index.space.longest)) + index.space.slack
        n, far = len(anchors), 1 << 62
        lists = Lists(np.arange(n), np.ones(n, bool), np.full(n, -far + 1), np.full(n, far), farthest)
        _bounds(index, anchors, lists, farthest)
        rows = _first(search(index, anchors, lists, scratch, f"positives-{number}")).orderBy("list", "rank").toArrow()
        anchor, positive, positive_ids = (rows.column(c).to_numpy().astype(np.int64) for c in ("list", "score", "vec_id"))
        # 100 * score >= share * positive, rounded up to a whole score
        bands = Lists(anchor, np.zeros(len(anchor), bool), -(-share * positive // 100), positive, farthest[anchor])
        some = bands.least <= bands.most
        bands, anchor, positive, positive_ids = bands.take(some), anchor[some], positive[some], positive_ids[some]
        if not len(anchor):
            continue
        _bounds(index, anchors, bands, np.minimum(farthest[anchor], index.space.distance(anchors.squared[anchor], bands.least) + index.space.slack))
        found = _first(search(index, anchors, bands, scratch, f"bands-{number}"))
        # the positives of one block
        named = spark.createDataFrame(pa.table([pa.array(np.arange(len(anchor), dtype=np.int32)), pa.array(ids[anchor]), pa.array(positive_ids), pa.array(positive)], names=["list", "anchor_id", "positive_id", "positive_score"]))
        some_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias
        out = out.unionAll(found.join(F.broadcast(named), "list").select("anchor_id", some_id("positive_id")("positive_id"), "rank", some_id("vec_id")("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        scratch.drop(*(f"positives-{number}-{turn}" for turn in range(len(SHARES))))
    return out
