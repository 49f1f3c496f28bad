"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find groups.

A document's set is that of its distinct 5-word shingles (words: runs of non-space bytes, A-Z
lower-cased; fewer words: the whole sequence as one). Documents are linked where
100 * |intersection| >= 75 * |union|; groups are the connected components of the links.

1. Signatures. SuperMinHash gives each element a random permutation of the ``size`` slots, drawn step
   by step, with step j's value in [j, j+1); a slot keeps its least value. Once every slot is below
   j + 1 no later step can matter, so elements stop early. All elements of a batch take step j
   together, which gives the same minima as one element after another. 16 bits of each slot are kept.
2. Equal sets (copies) are one node from here on, named by their least doc_id.
3. Bands. ``rows`` slots make a band's key; nodes sharing a key are candidates. With 128 slots and
   bands of 4, a pair at similarity 0.75 shares no band with probability 5e-6, at 0.8 3e-7.
4. Stars. Each bucket is led by its node that shares most buckets with others: of copies that differ
   from one original, that is the original. Pairs of leader and member whose signatures agree in at
   least ``sketch_least`` of the slots are verified on full sets. (An estimate lies 0.18 below the truth
   with probability under 2e-6.) This joins nearly all of each group, with rows linear in a bucket.
5. The rest, exactly. Buckets that still hold several components are open. There each node outside the
   bucket's largest component is compared with every node of the bucket: such nodes are dealt into
   blocks of bounded size, the bucket streams past each block, and signatures are compared as whole
   matrices. Nodes with a partner above ``sketch_least`` in another component go on, and their full
   sets are compared the same way. A pair that shares several buckets is looked at in the first of
   them only. Rows are members times blocks; only links that join two components are given out.
6. Components by alternating large-star and small-star steps on tables of edges, the second time
   between numbers of components; no driver, and no task, ever holds the edges.

Texts move only if their doc_id is in a candidate pair that the signatures leave: a bitmap of the
wanted ids, of at most 32 MB, is tested before the shuffle (beyond that size it lets more through).
Joins on tables that grow with the input are merge joins at every size.

Defined cases: null and empty texts have n_shingles 0 and are their own component; repeated rows are
one node, and each row is returned; a doc_id with several texts is one document, linked through each
of them; ties need no rule, as components are numbered by their least doc_id; an empty table gives no
rows; other columns are not read, or kept as they are (``keep_first``); doc_id must be a whole number,
and rows with a null one are returned with null component and kept true.

A very long text's shingles are held by one task; ties between documents go to the lesser doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, Words, buffers, mix, perhaps, runs, shingles

SLICE = 1 << 20
#: Shingles that take their steps together; each needs ``size`` bytes.
ELEMENTS = 1 << 17
#: Nodes, and shingles of theirs, in one block; members of one star that meet its leader in one task.
BLOCK, BLOCK_SHINGLES, STAR = 1024, 1 << 20, 4096
#: Numbers in one matrix.
MATRIX = 1 << 22


@dataclass(frozen=True)
class Settings:
    size: int = 128
    rows: int = 4
    k: int = 5
    percent: int = 75
    sketch_least: float = 0.57


def superminhash(values: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """[n, size] signatures of n sets; values: 64-bit hashes of elements, owner: their set. Sets without elements keep infinity."""
    out = np.full((n, size), np.inf)
    for lo in range(0, len(values), ELEMENTS):
        v, o = values[lo : lo + ELEMENTS].copy(), owner[lo : lo + ELEMENTS]
        order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(v), 1))
        place = np.arange(len(v))
        for j in range(size):
            v = mix(v + np.uint64(0x9E3779B97F4A7C15))
            # the high bits choose the slot, the low ones the value
            k = j + ((v >> np.uint64(40)) % np.uint64(size - j)).astype(np.int64)
            rank = (v & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40) + j
            slot = order[place, k]
            order[place, k] = order[place, j]
            np.minimum.at(out.reshape(-1), o * size + slot, rank)
            live = out.max(1)[o] > j + 1
            if not live.any():
                break
            if not live.all():
                v, o, place = v[live], o[live], place[live]
    return out


def _signed(batches, s: Settings):
    """Features of each document: set size, 128-bit hash of the set, and 16 bits of each slot."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for lo, hi in runs(offsets, SLICE):
            n = hi - lo
            value, bound = shingles(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), n, s.k)
            count = np.diff(bound)
            signature = superminhash(value, np.repeat(np.arange(n), count), n, s.size)
            slots = (mix(signature.view(np.uint64)) >> np.uint64(48)).astype("<u2")
            # order-free 128-bit hash of the set
            both = [np.add.reduceat(np.append(mix(value ^ np.uint64(salt)), np.uint64(0)), np.minimum(bound[:-1], len(value))) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
            both = [np.where(count > 0, b, np.uint64(0)).astype(np.uint64).view(np.int64) for b in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(count, pa.int64()), pa.array(both[0]), pa.array(both[1]), pa.array([x.tobytes() for x in slots], pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "slots"],
            )


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A merge join at every size: what grows with the input is never broadcast."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): component is the least node reachable. Alternating stars, each step a written table, until a step changes nothing."""

    def seal(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now, turn = scratch.save(both, f"{name}-0"), 0
    sealed = seal(now)
    while sealed[0]:
        # large star: neighbours that are larger than a node go to the node's least neighbour
        around = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = meet(around, least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = meet(large, least, "b").select(F.col("m").alias("p"), F.col("a").alias("q"), "b")
        small = small.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("b").alias("b")), F.struct(F.col("p").alias("a"), F.col("q").alias("b")))).alias("e")).select("e.*").where("a < b").distinct()
        turn, before = turn + 1, sealed
        now = scratch.save(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        sealed = seal(now)
        if sealed == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


# --- groups that stream past a block ----------------------------------------


def _segments(batches):
    """Of batches sorted by (key, salt, mine first): (batch, lo, hi, opens, closes), each part of one group; opens and closes tell whether it begins and ends there. A batch is held until the next one is known."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        opens = last != (key[0], salt[0])
        if held is not None:
            yield (*held, opens)
        cuts = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1)
        ends = np.append(cuts[1:], len(key)).tolist()
        for i, (lo, hi) in enumerate(zip(cuts.tolist(), ends)):
            held = (batch, lo, hi, opens or i > 0)
            if i < len(ends) - 1:
                yield (*held, True)
        last = (key[-1], salt[-1])
    if held is not None:
        yield (*held, True)


def _close(batches, s: Settings):
    """Of rows (key, salt, mine, rep, component, band, slots): those with a partner in another component that the signatures let through, a pair in the first of its common bands only."""
    least, blk = int(np.ceil(s.sketch_least * s.size)), None
    keys: list = []

    def row(batch, i, mine):
        keys.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), mine, batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))

    def flush():
        cols = list(zip(*keys)) or [()] * 5
        keys.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["key", "salt", "mine", "rep", "component"])

    seen, slots, reps, comps = None, None, None, None
    for batch, lo, hi, opens, closes in _segments(batches):
        if seen is not batch:
            seen = batch
            mines, reps, comps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            slots = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u2").reshape(-1, s.size)
        if opens:
            blk = {"slots": [], "rep": [], "comp": [], "from": [], "band": batch.column(5)[lo].as_py()}
        m = lo + int(mines[lo:hi].sum())
        if m > lo:
            blk["slots"].append(slots[lo:m]), blk["rep"].append(reps[lo:m]), blk["comp"].append(comps[lo:m])
            blk["from"] += [(batch, i) for i in range(lo, m)]
        if m < hi and blk["rep"]:
            if "all" not in blk:
                blk["all"], blk["r"], blk["c"] = np.concatenate(blk["slots"]), np.concatenate(blk["rep"]), np.concatenate(blk["comp"])
                blk["hit"] = np.zeros(len(blk["r"]), bool)
            own, size = blk["all"], max(1, MATRIX * 4 // (len(blk["all"]) * s.size))
            for i in range(m, hi, size):
                j = min(i + size, hi)
                same = own[:, None, :] == slots[None, i:j]
                near = (same.sum(2, dtype=np.int16) >= least) & (blk["c"][:, None] != comps[None, i:j])
                x, y = np.nonzero(near)
                if len(x):
                    first = same[x, y].reshape(len(x), -1, s.rows).all(2).argmax(1) == blk["band"]
                    blk["hit"][x[first]] = True
                    for k in np.unique(y[first]).tolist():
                        row(batch, i + k, False)
        if closes and "all" in blk:
            for i in np.flatnonzero(blk["hit"]).tolist():
                row(*blk["from"][i], True)
            blk = None
        if len(keys) > 4096:
            yield flush()
    yield flush()


class _Sets:
    """The full sets of a block, and which components the links found so far have joined."""

    def __init__(self):
        self.parts, self.size, self.comp, self.known, self.root = [], [], [], set(), {}
        self.value = None

    def add(self, rep: int, comp: int, values: np.ndarray) -> None:
        mark = (rep, len(values), int(values.sum(dtype=np.uint64)))
        if mark not in self.known and len(values):  # repeated rows
            self.known.add(mark)
            self.parts.append(values), self.size.append(len(values)), self.comp.append(comp)

    def _find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            x = self.root[x]
        return x

    def links(self, value: np.ndarray, bound: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Pairs of components that the sets bound[i] to bound[i + 1] of value link with the block's, none that follows from the others."""
        if self.value is None:
            all_ = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
            order = np.argsort(all_, kind="stable")
            self.value, self.owner = all_[order], np.repeat(np.arange(len(self.parts)), self.size)[order]
            self.n, self.own = np.array(self.size, np.int64), np.array(self.comp, np.int64)
        out, n = [], len(self.n)
        lo = np.searchsorted(self.value, value)
        count = np.searchsorted(self.value, value, side="right") - lo
        total = np.append(0, np.cumsum(count))[bound]
        i = 0
        while n and i < len(comp):
            j = max(i + 1, min(i + MATRIX // n, int(np.searchsorted(total, total[i] + MATRIX, side="right")) - 1))
            part = slice(bound[i], bound[j])
            own = np.repeat(np.arange(part.stop - part.start), count[part])
            which = np.repeat(np.arange(j - i), np.diff(bound[i : j + 1]))
            at = np.arange(len(own)) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + lo[part][own]
            common = np.bincount(self.owner[at] * (j - i) + which[own], minlength=n * (j - i)).reshape(n, j - i)
            either = self.n[:, None] + np.diff(bound[i : j + 1])[None] - common
            x, y = np.nonzero((common > 0) & (100 * common >= percent * either) & (self.own[:, None] != comp[None, i:j]))
            for a, b in zip(self.own[x].tolist(), comp[i:j][y].tolist()):
                p, q = self._find(a), self._find(b)
                if p != q:
                    self.root[max(p, q)] = min(p, q)
                    out.append((a, b))
            i = j
        return out


def _linked(batches, s: Settings):
    """Of rows (key, salt, mine, rep, component, text): links (a, b) between components, of each group those that join two of them."""
    seen, done, part, sets = None, 0, (0, 0), None
    for batch, lo, hi, opens, _ in _segments(batches):
        if seen is not batch:
            seen, done = batch, 0
            mine, rep, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            data, offsets = buffers(batch.column(5))
            slices = runs(offsets, SLICE)
            part = (0, 0)
        if opens:
            sets = _Sets()
        out = []
        while lo < hi:
            if lo >= part[1]:
                part = next(slices)
                value, bound = shingles(Words(data[offsets[part[0]] : offsets[part[1]]], offsets[part[0] : part[1] + 1] - offsets[part[0]]), part[1] - part[0], s.k)
            end = min(hi, part[1])
            m = lo + int(mine[lo:end].sum())
            for i in range(lo, m):
                sets.add(int(rep[i]), int(comp[i]), value[bound[i - part[0]] : bound[i - part[0] + 1]])
            if m < end:
                own = bound[m - part[0] : end - part[0] + 1]
                out += sets.links(value[own[0] : own[-1]], own - own[0], comp[m:end], s.percent)
            lo = end
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirmed(rows: DataFrame, source: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between components, of rows (key, salt, mine, rep, component) whose groups are compared on full sets: rows that are mine with the others."""
    texts = perhaps(source, rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").withColumnRenamed("doc_id", "rep")
    full = meet(rows, texts, "rep").select("key", "salt", "mine", "rep", "component", "text")
    return full.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("mine"), "rep").mapInArrow(lambda b: _linked(b, s), "a long, b long")


# --- the operator ------------------------------------------------------------


def _buckets(reps: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """(key, band, rep, n) of the buckets that hold n >= 2 nodes."""
    width = 2 * s.rows
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("slots", i * width + 1, width)) for i in range(s.size // s.rows)))
    banded = reps.select("rep", F.posexplode(keys).alias("band", "key"))
    shared = scratch.save(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "n"), "keys")
    return scratch.save(meet(perhaps(banded, shared.select("key"), "key"), shared, "key").select("key", "band", "rep", "n"), "entries")


def _stars(entries: DataFrame, reps: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """Rows for ``_confirmed``: each leader with the members that its signature is near to."""
    degree = entries.groupBy("rep").agg(F.sum("n").alias("degree"))
    marked = meet(entries, degree, "rep").select("key", "rep", "degree")
    leaders = marked.groupBy("key").agg(F.max(F.struct("degree", "rep")).alias("top")).select("key", F.col("top.rep").alias("leader"))
    pairs = scratch.save(meet(marked, leaders, "key").where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).distinct()
    known = scratch.save(perhaps(reps, wanted, "rep").select("rep", "slots"), "slots")
    both = meet(meet(pairs, known.select(F.col("rep").alias("a"), F.col("slots").alias("sa")), "a"), known.select(F.col("rep").alias("b"), F.col("slots").alias("sb")), "b")

    def near(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, s.size) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= s.sketch_least))

    rated = scratch.save(both.select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long"), "rated")
    sizes = rated.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    members = meet(rated, sizes, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), "parts").alias("salt"), F.lit(False).alias("mine"), F.col("b").alias("rep"), F.col("b").alias("component"))
    heads = sizes.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("mine"), F.col("a").alias("rep"), F.col("a").alias("component"))
    return scratch.save(members.unionAll(heads), "star-rows")


def _apart(entries: DataFrame, reps: DataFrame, placed: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """Rows for ``_confirmed``: in buckets of several components, the nodes outside the largest one, in blocks, with all nodes that their signatures are near to."""
    found = meet(entries, placed.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
    found = scratch.save(found, "found")
    counted = found.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).where("kinds > 1").select("key", F.col("main.component").alias("main"))
    sized = reps.select("rep", "n_shingles", "slots")
    open_ = scratch.save(meet(found, mixed, "key").select("key", "band", "rep", "component", (F.col("component") != F.col("main")).alias("outside")), "open")
    full = meet(open_, perhaps(sized, open_.select("rep").distinct(), "rep"), "rep")
    full = scratch.save(full.select("key", "band", "rep", "component", "outside", "n_shingles", "slots"), "full")
    parts = full.where("outside").groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    dealt = meet(full, parts, "key")
    fields = ("rep", "component", "band", "slots")
    mine = dealt.where("outside").select("key", F.pmod(F.xxhash64("rep"), "parts").alias("salt"), F.lit(True).alias("mine"), *fields)
    others = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("mine"), *fields)
    rows = mine.unionAll(others).repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("mine"), "rep")
    return scratch.save(rows.mapInArrow(lambda b: _close(b, s), "key long, salt long, mine boolean, rep long, component long"), "close")


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents."""
    s, scratch = settings, Scratch(documents.sparkSession, "near-dup")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = source.mapInArrow(lambda batches: _signed(batches, s), "doc_id long, n_shingles long, h1 long, h2 long, slots binary")
    source = source.where("doc_id is not null")
    features = scratch.save(signed, "features")
    real = features.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.save(real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("slots").alias("slots")), "reps")
    same = ["h1", "h2", "n_shingles"]
    member = scratch.save(meet(real.select("doc_id", *same), reps.select("rep", *same), same).select("doc_id", "rep").distinct(), "member")

    entries = _buckets(reps, scratch, s)
    links = _confirmed(_stars(entries, reps, scratch, s), source, s)
    # a doc_id with several texts ties their nodes together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("doc_id", "a")
    links = links.unionAll(meet(member, several, "doc_id").select("a", F.col("rep").alias("b")))
    first = components(scratch, links, "cc")
    more = _confirmed(_apart(entries, reps, first, scratch, s), source, s)
    second = components(scratch, more, "rest").toDF("component", "last")

    nodes = meet(member, first.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    placed = meet(nodes, second, "component", "left").groupBy("doc_id").agg(F.min(F.coalesce("last", "component")).alias("component_id"))
    out = meet(features.select("doc_id", "n_shingles"), placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "out")
    scratch.drop_but("out")
    return out


def keep_first(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents, all columns, one document of each group; of a doc_id that is repeated, every row of the kept document stays. Only texts that a bitmap takes for removed ones are shuffled."""
    gone = near_duplicates(documents, settings).where("not kept").select("doc_id").distinct()
    marked = documents.withColumn("__id", F.col("doc_id").cast("long"))
    maybe, sure = perhaps(marked, gone.withColumnRenamed("doc_id", "__id"), "__id", split=True)
    left = maybe.hint("merge").join(gone.withColumnRenamed("doc_id", "__id").hint("merge"), "__id", "left_anti")
    return sure.select(*documents.columns).unionAll(left.select(*documents.columns))
