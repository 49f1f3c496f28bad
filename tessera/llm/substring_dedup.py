"""Substring dedup: collinear chaining of shared word k-mers, then alignment, to find fuzzy passages.

1. Seeds. Of the 5-word shingles of each document (words: runs of non-space bytes, A-Z lower-cased),
   those with the least hash of any 8 neighbours are seeds: two texts that share 12 words in a row
   share a seed.
2. Join. All places of a seed are matched with the document that has it most often, of several the
   least, so a passage in n documents gives
   n - 1 pairs of documents, not n * n: every other document is linked through that one. Seeds that a
   sample shows to be very frequent are dealt over ``salts`` tasks, each with a first document of its
   own, and those are joined in a second step. The sample steers balance only, never results.
3. Chains. Matches of a pair on one diagonal become anchors. Anchors are chained in the order of both
   texts so as to maximise words covered less a cost for each word of the gaps; a Fenwick tree over
   places in the second text gives each anchor its best predecessor.
4. Alignment. Chains are extended at both ends while words agree (score +1, -2, stop 6 below the
   best), and the longest common subsequence of the two passages must cover at least ``percent`` of
   the longer one, which must have at least ``min_words`` words in both texts. A chain that fails is
   parted at its widest gap and its parts are looked at in the same way: two passages far apart may be
   one chain, but are not one passage. Of one pair, chains inside passages that are found are left out.
5. The rest. One leader for each seed can hold only a part of what two others share. Seed places
   outside the passages found so far are open. Places of a seed are put in the order of the seeds that
   follow them, and documents side by side there, of which one place is open or whose classes so far
   differ, are compared on all their shared seeds, each place with each, by chains and alignment as
   before: rows are linear in the places, however many documents share a seed. Of all
   documents with a seed, those with the longest common continuation stand together, so a document's
   neighbours share as much with it as any other does; passages of ``min_words + window`` words that are
   alike word for word are so never lost to a leader that holds a part. The order is dealt by ranges
   of (seed, continuation, document), so that a frequent seed is no single task.
6. Classes. Documents that share passages, directly or not, form a class, by alternating stars. Links
   are not listed for all pairs: within a class, a document's passages are linked to some other that has
   them.

Result: one row per document that has such a passage, none for others.

Defined cases: null, empty and short texts have no passages; copies of a document are passages over
their whole texts; repeats within one document, and rows that repeat a doc_id, do not count as
another document; ties go to the smaller document and the earlier place; an empty table gives no
rows; rows with a null doc_id are left out; other columns are not read.

A very long text's words and seeds are held by one task. So are, of two texts that repeat the same seeds
over and over, the diagonals on which they agree (not the places: these are met in blocks).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import components, meet
from .shared import Scratch, Words, buffers, mix, perhaps, runs

SLICE = 1 << 20
#: Frequent seeds that are salted, at most; they go to every worker.
MAX_HOT = 50_000
#: Matches of two documents' places that are held at once, about.
MATCHES = 1 << 20


@dataclass(frozen=True)
class Settings:
    k: int = 5
    window: int = 8
    min_words: int = 50
    percent: int = 75
    gap_cost: float = 0.04
    salts: int = 32
    sample: int = 32
    hot: int = 64
    ahead: int = 12

    @property
    def reach(self) -> int:
        """Words that a shared passage may have beyond its outermost seeds."""
        return self.k + self.window

    @property
    def least(self) -> int:
        """Words from the first to the last seed of a passage, at least."""
        return max(self.k, self.min_words - 2 * self.reach)

    @property
    def apart(self) -> int:
        """Words between two anchors of a chain, at most, where those before the second cover under ``least`` words: the gap costs more otherwise."""
        return int(self.least / self.gap_cost) + self.least


def seeds(words: Words, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each seed."""
    n = len(words) - s.k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(s.k):
        h = h * np.uint64(0x9E3779B97F4A7C15 | 1) + words.hash[j : j + n]
    h = mix(h)
    whole = words.row[:n] == words.row[s.k - 1 : s.k - 1 + n]
    long = np.diff(words.first)[words.row[:n]] >= s.min_words
    at = np.flatnonzero(whole & long)
    h, row = h[at], words.row[at]
    if len(h) < s.window:
        return h, at
    # the least of every window that lies in one document
    views = np.lib.stride_tricks.sliding_window_view(h, s.window)
    best = np.arange(len(views)) + np.argmin(views, axis=1)
    chosen = np.zeros(len(h), bool)
    chosen[best[row[: len(views)] == row[s.window - 1 :]]] = True
    return h[chosen], at[chosen]


def _seeded(batches, s: Settings, hot: np.ndarray):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = buffers(batch.column(1))
        for lo, hi in runs(offsets, SLICE):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            h, at = seeds(words, s)
            row = words.row[at]
            doc, seed = ids[lo:hi][row].astype(np.int64), h.view(np.int64)
            # how often a document has each of its seeds
            order = np.lexsort((h, row))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(h)]
            times = np.zeros(len(h), np.int32)
            times[order] = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1] if len(h) else 0
            salt = np.zeros(len(seed), np.int16)
            if len(hot):
                own = hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed
                salt[own] = 1 + (mix(doc[own].astype(np.uint64)) % np.uint64(s.salts)).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(salt), pa.array(doc), pa.array((at - words.first[row]).astype(np.int32)), pa.array(times)], names=["seed", "salt", "doc", "at", "times"])


def _led(batches):
    """Of rows sorted by (seed, salt, times descending, doc, at): a row (a, x, b, y, seed) for each place in another document than the group's first, and one (a, x, -, times, seed) that is marked as up for each place of the first of a salted group.

    The i-th place in a document is matched with the i-th of the first document, or with its last if
    it has fewer: so texts that repeat a few words over and over match in order. Places of the first
    document beyond those that the next one has are matched with that one's last, so that none is left out."""

    def matched(cols, known, told):
        """known: so many rows at the start are the first document of the first group, met before; told: with another document."""
        seed, salt, doc, at, times = cols
        n = len(seed)
        new = np.append(True, (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1]))
        run = new | np.append(True, doc[1:] != doc[:-1])
        heads, begins = np.flatnonzero(new), np.flatnonzero(run)
        group, part = np.cumsum(new) - 1, np.cumsum(run) - 1
        sizes = np.diff(np.append(begins, n))
        led = sizes[part[heads]][group]
        head = heads[group]
        place = at[head + np.minimum(np.arange(n) - begins[part], led - 1)]
        other = doc[head] != doc
        up = np.flatnonzero(~other & (salt > 0) & (np.arange(n) >= known))
        # the document after the first one of a group
        after = np.minimum(part[heads] + 1, len(begins) - 1)
        single = group[begins[after]] != np.arange(len(heads))
        single |= after == part[heads]
        single[0] |= told
        beyond = np.flatnonzero(~other & ~single[group] & (np.arange(n) - begins[part] >= sizes[after][group]))
        last = (begins[after] + sizes[after] - 1)[group[beyond]]
        other = np.flatnonzero(other)
        none = len(up)
        kept = len(other) + len(beyond)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([doc[head][other], doc[beyond], doc[up]])), pa.array(np.concatenate([place[other], at[beyond], at[up]]).astype(np.int32)),
                pa.array(np.concatenate([doc[other], doc[last], np.zeros(none, np.int64)])), pa.array(np.concatenate([at[other], at[last], times[up]]).astype(np.int32)),
                pa.array(np.concatenate([seed[other], seed[beyond], seed[up]])), pa.array(np.append(np.zeros(kept, bool), np.ones(none, bool))),
            ],
            names=["a", "x", "b", "y", "seed", "up"],
        )

    held, known, told = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        seed, salt, doc = cols[:3]
        same = (seed == seed[-1]) & (salt == salt[-1])
        first = int(np.argmax(same))
        own = np.flatnonzero(doc[first:] != doc[-1])
        tail = first + int(own[-1]) + 1 if len(own) else first  # the document that may go on in the next batch
        lead = first + int((doc[first:tail] == doc[first]).sum()) if tail > first else first
        if tail > known:
            yield matched([c[:tail] for c in cols], known, told)
            known, told = lead - first, tail > lead or (first == 0 and told)
        elif tail == first:
            known, told = 0, False
        held = [np.concatenate([c[first:lead], c[tail:]]) for c in cols]
    if held is not None:
        yield matched(held, known, told)


class Fenwick:
    """Greatest value, and whose it is, among places up to a given one."""

    def __init__(self, n: int):
        self.best, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.who[i] = value, who
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Among places under i."""
        value, who = float("-inf"), -1
        while i > 0:
            if self.best[i] > value:
                value, who = self.best[i], self.who[i]
            i -= i & -i
        return value, who


def _joined(x: np.ndarray, y: np.ndarray, size: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches (x, y, words): neighbours on one diagonal, no further apart than seeds may be, as one."""
    d = x - y
    order = np.lexsort((y, d))
    x, y, d, size = x[order], y[order], d[order], size[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (y[1:] - y[:-1] - size[:-1] + s.k > s.reach)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return x[first], y[first], y[last] + size[last] - y[first]


def anchors(x: np.ndarray, y: np.ndarray, s: Settings) -> list[tuple[int, int, int]]:
    """Matches of k words as (x, y, words): neighbours on one diagonal, no further apart than seeds may be, are one anchor."""
    return sorted(zip(*(c.tolist() for c in _joined(x, y, np.full(len(x), s.k), s))))


def chain(found: list[tuple[int, int, int]], s: Settings) -> list[tuple[int, int, int, int]]:
    """(x begin, x end, y begin, y end) of the chains of anchors that are sorted by (x, y), best first, each anchor in one of them."""
    return [_span(own) for own in chains(found, s)]


def _span(own: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    """(x begin, x end, y begin, y end) of anchors in their order."""
    return own[0][0], max(x + m for x, _, m in own), own[0][1], max(y + m for _, y, m in own)


def chains(found: list[tuple[int, int, int]], s: Settings) -> list[list[tuple[int, int, int]]]:
    """The anchors of each chain."""
    n, c = len(found), s.gap_cost
    if n == 1:
        return [found]
    places = sorted({y for _, y, _ in found})
    tree, score, back = Fenwick(len(places)), [0.0] * n, [-1] * n
    i = 0
    while i < n:  # anchors at one x cannot follow one another: all are scored before any is put in
        j = i
        while j < n and found[j][0] == found[i][0]:
            x, y, m = found[j]
            value, who = tree.top(bisect.bisect_left(places, y))
            gain = value - c * (x + y)
            score[j], back[j] = (m + gain, who) if who >= 0 and gain > 0 else (float(m), -1)
            j += 1
        for k in range(i, j):
            x, y, m = found[k]
            tree.put(bisect.bisect_left(places, y), score[k] + c * (x + y + 2 * m), k)
        i = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        own, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            own.append(found[at])
            at = back[at]
        out.append(own[::-1])
    return out


def _rows(a: int, b: int, found: list[tuple[int, int, int]], s: Settings):
    """A row of a pair's chains that are wide enough: the range that they lie in, and (chain, x, y, words) of their anchors, best chain first."""
    own = [c for c in chains(found, s) if _wide(_span(c), s)]
    if own:
        x0, x1, y0, y1 = zip(*map(_span, own))
        yield a, b, min(x0), max(x1), min(y0), max(y1), np.array([(i, *z) for i, c in enumerate(own) for z in c], np.int32).tobytes()


def _wide(span: tuple[int, int, int, int], s: Settings) -> bool:
    return span[1] - span[0] >= s.least and span[3] - span[2] >= s.least


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    got = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, kinds)], names=["a", "b", "x0", "x1", "y0", "y1", "anchors"])


def _chained(batches, s: Settings):
    """Chains (a, b, x0, x1, y0, y1, anchors) of rows sorted by (a, b)."""
    least = s.least
    held: list[np.ndarray] | None = None

    def chained(cols):
        a, b, x, y = cols
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(a))
        wide = (np.maximum.reduceat(y, lo) - np.minimum.reduceat(y, lo) + s.k >= least) & (np.maximum.reduceat(x, lo) - np.minimum.reduceat(x, lo) + s.k >= least)
        rows = []
        for i, j in zip(lo[wide].tolist(), hi[wide].tolist()):
            rows += _rows(int(a[i]), int(b[i]), anchors(x[i:j], y[i:j], s), s)
        return _chain_batch(rows)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        a, b = cols[:2]
        if not len(a):
            continue
        # the last pair may go on in the next batch
        same = np.flatnonzero((a != a[-1]) | (b != b[-1]))
        cut = int(same[-1]) + 1 if len(same) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield chained([c[:cut] for c in cols])
    if held is not None and len(held[0]):
        yield chained(held)


def _small(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _word_hashes(text) -> np.ndarray:
    return _small(Words(*buffers(pa.array([text], pa.string()))).hash)


def _cut_out(batches, s: Settings):
    """The words of each chain in text a, with a margin."""
    for batch in batches:
        doc, words, out = None, None, []
        for a, x0, x1, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(7)):
            if a != doc:
                doc, words = a, _word_hashes(text.as_py())
            out.append(words[max(0, x0 - 2 * s.reach) : x1 + 2 * s.reach].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out, pa.binary())], names=["a", "b", "x0", "x1", "y0", "y1", "anchors", "words"])


def extend(p: np.ndarray, q: np.ndarray, i: int, j: int, step: int) -> int:
    """Words by which a match may grow from p[i], q[j] in a direction: +1 for equal words, -2 else, until 6 under the best."""
    score = best = taken = n = 0
    while 0 <= i < len(p) and 0 <= j < len(q) and score > best - 6:
        score += 1 if p[i] == q[j] else -2
        n += 1
        if score > best:
            best, taken = score, n
        i, j = i + step, j + step
    return taken


def common(p: np.ndarray, q: np.ndarray) -> int:
    """Length of the longest common subsequence of words."""
    if len(p) == len(q) and np.array_equal(p, q):
        return len(p)
    masks: dict[int, int] = {}
    for i, h in enumerate(p.tolist()):
        masks[h] = masks.get(h, 0) | 1 << i
    full = (1 << len(p)) - 1
    v = full
    for h in q.tolist():
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(p) - v.bit_count()


def _both(p: np.ndarray, q: np.ndarray) -> int:
    """How many words both have, each as often as the one that has it less often."""
    (v, n), (w, m) = (np.unique(x, return_counts=True) for x in (p, q))
    _, i, j = np.intersect1d(v, w, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def passages(p: np.ndarray, base: int, q: np.ndarray, found: list[tuple[int, int, int]], s: Settings):
    """(x0, x1, y0, y1, share) of a chain's anchors if that is a passage; else of the parts on both sides of its widest gap. p: the words of the first text from base on, q: those of the second."""
    todo = [found]
    while todo:
        own = todo.pop()
        x0, x1, y0, y1 = _span(own)
        if min(x1 - x0, y1 - y0) < s.least:
            continue
        left = extend(p, q, x0 - base - 1, y0 - 1, -1)
        right = extend(p, q, x1 - base, y1, 1)
        x0, x1, y0, y1 = x0 - left, x1 + right, y0 - left, y1 + right
        if min(x1 - x0, y1 - y0) < s.min_words:
            continue
        longer = max(x1 - x0, y1 - y0)
        one, other = p[x0 - base : x1 - base], q[y0:y1]
        # the subsequence has at most the words that both have, however ordered
        n = common(one, other) if 100 * _both(one, other) >= s.percent * longer else 0
        if 100 * n >= s.percent * longer:
            yield x0, x1, y0, y1, n / longer
        elif len(own) > 1:
            at = max(range(1, len(own)), key=lambda i: own[i][0] + own[i][1] - own[i - 1][0] - own[i - 1][1] - 2 * own[i - 1][2])
            todo += [own[at:], own[:at]]


def _aligned(batches, s: Settings):
    """The chains that are passages: a, b, x0, x1, y0, y1 after extension, and the share of words in common."""
    for batch in batches:
        doc, words, rows = None, None, []
        cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 6, 7)]
        for a, b, x0, found, raw, text in zip(*cols, batch.column(8)):
            if b != doc:
                doc, words = b, _word_hashes(text.as_py())
            p, base, found = np.frombuffer(raw, np.uint32), max(0, x0 - 2 * s.reach), np.frombuffer(found, np.int32).reshape(-1, 4)
            known = np.zeros(len(p), bool), np.zeros(len(words), bool)
            for own in np.split(found[:, 1:], np.flatnonzero(np.diff(found[:, 0])) + 1):
                own = list(map(tuple, own.tolist()))
                lo, hi, low, high = _span(own)
                # where both texts have passages of this pair already, shifted ones say nothing more
                if known[0][lo - base : hi - base].all() and known[1][low:high].all():
                    continue
                for x in passages(p, base, words, own, s):
                    known[0][x[0] - base : x[1] - base], known[1][x[2] : x[3]] = True, True
                    rows.append((a, b, *x))
        got = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, kinds)], names=["a", "b", "x0", "x1", "y0", "y1", "share"])


def _whole(batches, columns: int):
    """The columns of batches sorted by the first, cut so that equal values stay together."""
    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _line(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places on one line, documents (sorted) far apart."""
    return (np.cumsum(np.append(False, doc[1:] != doc[:-1])) << 32) + at


def _places(batches):
    """(doc, at, hi = 0, seed) of both sides of matches."""
    for batch in batches:
        a, x, b, y, seed = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(a), bool)  # the rows of a leader's place often follow one another
        order = np.lexsort((x, a))
        new[1:] = (a[order][1:] != a[order][:-1]) | (x[order][1:] != x[order][:-1])
        own = order[new]
        doc = np.append(a[own], b)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.append(x[own], y)), pa.array(np.zeros(len(doc), np.int32)), pa.array(np.append(seed[own], seed))], names=["doc", "at", "hi", "seed"])


def _open(batches, s: Settings):
    """Of places (hi = 0) and known passages (at to hi), sorted by doc: the places that may belong to a passage, whether they are open, as none is known there, and the seeds that follow."""
    for doc, at, hi, seed in _whole(batches, 4):
        line = _line(doc, at.astype(np.int64))
        known = np.flatnonzero(hi > 0)
        lo = line[known]
        order = np.argsort(lo, kind="stable")
        ends = np.append(-1, np.maximum.accumulate((lo + hi[known] - at[known])[order]))
        own = np.flatnonzero(hi == 0)
        own = own[np.argsort(line[own], kind="stable")]
        own = own[np.append(True, line[own][1:] != line[own][:-1])[: len(own)]]
        place = line[own]
        free = ends[np.searchsorted(lo[order], place, side="right")] < place + s.k

        def near(among):
            """Which places have another at such a distance that both can be of one chain."""
            count = lambda low, high: np.searchsorted(among, place + high, side="right") - np.searchsorted(among, place + low)
            return (count(s.least - s.k, s.apart) > 0) | (count(-s.apart, s.k - s.least) > 0)

        wanted = near(place)
        if wanted.any():
            small = (seed[own].view(np.uint64) >> np.uint64(32)).astype(">u4")
            small, far = np.append(small, np.zeros(s.ahead, ">u4")), np.append(place, np.full(s.ahead, 1 << 62))
            begin = np.flatnonzero(wanted)
            after = begin[:, None] + np.arange(1, s.ahead + 1)
            context = np.where(far[after] - place[begin][:, None] <= s.ahead * s.reach, small[after], 0).astype(">u4")
            got = own[wanted]
            yield pa.RecordBatch.from_arrays([pa.array(doc[got]), pa.array(seed[got]), pa.array(free[wanted]), pa.array([c.tobytes() for c in context], pa.binary())], names=["doc", "seed", "open", "context"])


NEIGHBOURS = "a long, b long, alike int, seed long, context binary, open boolean"


def _neighbours(batches, s: Settings):
    """Of rows (doc, seed, open, context) in the order of (seed, context): pairs of documents that stand side by side at a seed, the seeds that both have after it, and whether one place is open; and, with b null, the first and last row of the task, as a neighbour may be in another one."""
    last, first = None, None

    def out(a, b, alike, seed, context, free):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.int32()), pa.array(seed, pa.int64()), pa.array(context, pa.binary()), pa.array(free, pa.bool_())], names=["a", "b", "alike", "seed", "context", "open"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        doc, seed, free = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        context = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(-1, s.ahead)
        if first is None:
            first = batch.slice(0, 1)
        i = np.flatnonzero((seed[1:] == seed[:-1]) & (doc[1:] != doc[:-1]))
        alike = np.cumprod((context[i] == context[i + 1]) & (context[i] != 0), axis=1).sum(1)
        yield out(np.minimum(doc[i], doc[i + 1]), np.maximum(doc[i], doc[i + 1]), alike, seed[i], pa.nulls(len(i), pa.binary()), free[i] | free[i + 1])
        last = batch.slice(batch.num_rows - 1, 1)
    for edge in (first, last):
        if edge is not None:
            yield out(edge.column(0).to_pylist(), [None], [0], edge.column(1).to_pylist(), edge.column(3).to_pylist(), edge.column(2).to_pylist())


def _packed(batches, s: Settings):
    """(doc, its seeds, their places) of places (doc, at, hi, seed) sorted by doc."""
    for doc, at, _, seed in _whole(batches, 4):
        order = np.lexsort((at, doc))
        order = order[np.append(True, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1]))]
        doc, at, seed = doc[order], at[order], seed[order]
        bounds = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        raw = [(seed[i:j].tobytes(), at[i:j].astype(np.int32).tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(doc[bounds[:-1]]), pa.array([r[0] for r in raw], pa.binary()), pa.array([r[1] for r in raw], pa.binary())], names=["doc", "seeds", "places"])


def crossed(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (x, y, words) of equal seeds p, q at places x, y, each place with each. Those of so many places that about ``MATCHES`` matches arise are met at once and joined by diagonals: texts that repeat a few words over and over have few of these."""
    i, j = np.argsort(x, kind="stable"), np.lexsort((y, q))
    p, x, q, y = p[i], x[i].astype(np.int64), q[j], y[j].astype(np.int64)
    lo = np.searchsorted(q, p)
    count = np.searchsorted(q, p, side="right") - lo
    ends = np.cumsum(count)
    found, begin = [np.zeros(0, np.int64)] * 3, 0
    while begin < len(p):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + MATCHES, side="right")))
        n, own = count[begin:end], np.repeat(np.arange(begin, end), count[begin:end])
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]
        met = x[own], y[at], np.full(len(own), s.k)
        found = list(_joined(*(np.concatenate(c) for c in zip(found, met)), s))
        begin = end
    return tuple(found)


def _compared(batches, s: Settings):
    """Chains (a, b, x0, x1, y0, y1, anchors) of pairs with the seeds and places of both."""
    for batch in batches:
        rows = []
        a, b, *raw = (batch.column(i).to_pylist() for i in range(6))
        for one, other, p, x, q, y in zip(a, b, *raw):
            x, y, size = crossed(np.frombuffer(p, np.int64), np.frombuffer(x, np.int32), np.frombuffer(q, np.int64), np.frombuffer(y, np.int32), s)
            if not len(x) or (x + size).max() - x.min() < s.least or (y + size).max() - y.min() < s.least:
                continue
            rows += _rows(one, other, sorted(zip(x.tolist(), y.tolist(), size.tolist())), s)
        yield _chain_batch(rows)


SPANS = "a long, b long, x0 int, x1 int, y0 int, y1 int"
CHAINS = f"{SPANS}, anchors binary"


def _verified(chains: DataFrame, source: DataFrame, s: Settings, scratch: Scratch, name: str) -> DataFrame:
    """The chains that are passages, written. Only texts of documents in chains are shuffled."""
    chains = scratch.save(chains, f"chains{name}")
    texts = perhaps(source, chains.select(F.col("a").alias("doc_id")).unionAll(chains.select("b")).distinct(), "doc_id")
    first = meet(chains, texts.withColumnRenamed("doc_id", "a"), "a").select("a", "b", "x0", "x1", "y0", "y1", "anchors", "text")
    cut = scratch.save(first.mapInArrow(lambda b: _cut_out(b, s), f"{CHAINS}, words binary"), f"cut{name}")
    second = meet(cut, texts.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "x0", "x1", "y0", "y1", "anchors", "words", "text")
    links = scratch.save(second.mapInArrow(lambda b: _aligned(b, s), f"{SPANS}, share double"), f"links{name}")
    scratch.drop(f"cut{name}", f"chains{name}")
    return links


def _rest(pairs: DataFrame, links: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Chains between documents that share open places, or are of different classes, whoever leads them."""
    kind = "doc long, at int, hi int, seed long"
    places = pairs.mapInArrow(_places, kind)
    known = links.select(F.col("a").alias("doc"), F.col("x0").alias("at"), F.col("x1").alias("hi")).unionAll(links.select("b", "y0", "y1")).distinct().withColumn("seed", F.lit(0).cast("long"))
    wanted = scratch.save(places.unionAll(known).repartition("doc").sortWithinPartitions("doc").mapInArrow(lambda b: _open(b, s), "doc long, seed long, open boolean, context binary"), "wanted")
    order = ("seed", "context", "doc")
    beside = scratch.save(wanted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _neighbours(b, s), NEIGHBOURS), "beside")
    edges = beside.where("b is null").select(F.col("a").alias("doc"), "seed", "open", "context")
    across = edges.repartition("seed").sortWithinPartitions(*order).mapInArrow(lambda b: _neighbours(b, s), NEIGHBOURS)
    met = beside.where("b is not null").unionAll(across.where("b is not null")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("alike").alias("alike"), F.max("open").alias("open"))
    met = scratch.save(met.where((F.col("n") > 1) | (F.col("alike") > 1)).select("a", "b", "open"), "met-all")
    # what both are known to share with others links them already, if these are of one class
    of = components(scratch, links.select("a", "b"), "known")
    classes = [of.select(F.col("node").alias(n), F.col("component").alias(f"class_{n}")) for n in "ab"]
    apart = meet(meet(met.where("not open"), classes[0], "a"), classes[1], "b").where("class_a <> class_b")
    both = scratch.save(met.where("open").select("a", "b").unionAll(apart.select("a", "b")), "met")
    docs = both.select(F.col("a").alias("doc")).unionAll(both.select("b")).distinct()
    packed = perhaps(places, docs, "doc").repartition("doc").sortWithinPartitions("doc").mapInArrow(lambda b: _packed(b, s), "doc long, seeds binary, places binary")
    packed = scratch.save(packed, "packed")
    sides = [packed.select(F.col("doc").alias(n), F.col("seeds").alias(f"seeds_{n}"), F.col("places").alias(f"places_{n}")) for n in "ab"]
    full = meet(meet(both, sides[0], "a"), sides[1], "b").select("a", "b", "seeds_a", "places_a", "seeds_b", "places_b")
    return full.mapInArrow(lambda b: _compared(b, s), CHAINS)


def find_passages(documents: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """Links: a row for each passage that document b shares with a: a, b, their word ranges (x0 to x1, y0 to y1), share."""
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    source = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "seed long, salt short, doc long, at int, times int"
    nothing = np.zeros(0, np.int64)
    sampled = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(s.sample)) == 0).mapInArrow(lambda b: _seeded(b, s, nothing), schema)
    often = sampled.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.hot).orderBy(F.desc("n"), "seed").limit(MAX_HOT)
    hot = np.sort(np.array([r["seed"] for r in often.select("seed").collect()], np.int64))
    sent = spark.sparkContext.broadcast(hot)
    seeded = source.mapInArrow(lambda b: _seeded(b, s, sent.value), schema)
    led = "a long, x int, b long, y int, seed long, up boolean"
    dealt = seeded.repartition("seed", "salt").sortWithinPartitions("seed", "salt", F.desc("times"), "doc", "at")
    matches = scratch.save(dealt.mapInArrow(_led, led), "matches")
    tops = matches.where("up").select("seed", F.lit(0).cast("short").alias("salt"), F.col("a").alias("doc"), F.col("x").alias("at"), F.col("y").alias("times"))
    more = scratch.save(tops.repartition("seed").sortWithinPartitions("seed", "salt", F.desc("times"), "doc", "at").mapInArrow(_led, led), "more")
    pairs = matches.where("not up").unionAll(more).select("a", "x", "b", "y", "seed")
    chained = pairs.select("a", "b", "x", "y").repartition("a", "b").sortWithinPartitions("a", "b", "y", "x").mapInArrow(lambda b: _chained(b, s), CHAINS)
    links = _verified(chained, source, s, scratch, "")
    rest = _verified(_rest(pairs, links, s, scratch), source, s, scratch, "-rest")
    scratch.drop("matches", "more", "wanted", "beside", "met-all", "met", "packed")
    return links.unionAll(rest).distinct()


def repeated_passages(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document with a passage that other documents have: doc_id, class_id, n_links, n_words (in such passages), spans (word ranges, merged, as begin:end joined by commas), least_share."""
    scratch = Scratch(documents.sparkSession, "substring")
    links = scratch.save(find_passages(documents, s, scratch), "passages")
    sides = links.select(F.col("a").alias("doc_id"), F.col("x0").alias("lo"), F.col("x1").alias("hi"), "share").unionAll(links.select("b", "y0", "y1", "share"))
    # equal spans are counted first, so that a document in very many links stays small
    spans = sides.groupBy("doc_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("share"))
    merged = F.aggregate(
        "parts",
        F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("done"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")),
        lambda acc, p: F.when(acc["lo"].isNull(), F.struct(acc["done"].alias("done"), p["lo"].alias("lo"), p["hi"].alias("hi")))
        .when(p["lo"] <= acc["hi"], F.struct(acc["done"].alias("done"), acc["lo"].alias("lo"), F.greatest(acc["hi"], p["hi"]).alias("hi")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))).alias("done"), p["lo"].alias("lo"), p["hi"].alias("hi"))),
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))),
    )
    docs = spans.groupBy("doc_id").agg(F.sum("n").alias("n_links"), F.min("share").alias("least_share"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("parts")).withColumn("merged", merged)
    classes = components(scratch, links.select("a", "b"), "cc").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "class_id")
    out = meet(docs, classes, "doc_id").select(
        "doc_id", "class_id", "n_links",
        F.aggregate("merged", F.lit(0), lambda acc, p: acc + p["hi"] - p["lo"]).cast("long").alias("n_words"),
        F.array_join(F.transform("merged", lambda p: F.concat_ws(":", p["lo"].cast("string"), p["hi"].cast("string"))), ",").alias("spans"), "least_share",
    )
    out = scratch.save(out, "out")
    scratch.drop_but("out")
    return out
