"""Benchmark decontamination: latent semantic search, then longest common subsequence and answer checks.

1. Statistics. All documents are cut into passages of 32 words; words are hashed to ``terms``
   coordinates, and the document frequency of each over all passages gives its idf weight.
2. Index. A randomised SVD of the TF-IDF passages: tasks multiply their rows by a random matrix and
   back (A' A O), the products of bounded size are summed, and a few such rounds with
   orthonormalisation give ``rank`` right singular vectors. It is fitted on about ``fit_passages``
   passages, chosen by a hash of their words: a documented bound. Every passage is indexed.
3. Search. A benchmark item of n words is compared, by cosine in the latent space, with windows of
   about n words at every 8th word of every document, and candidates are those over ``cosine``.
4. Checks. A candidate is a leak if the longest common subsequence of words covers ``sure`` of the item,
   or ``least`` of it and also ``least`` of the answer: the item's answer column if there is one,
   else its last quarter. That finds paraphrases, where words are changed, dropped or put in.

The benchmark is a stated query set that is compared with all documents in blocks of about
``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters; the driver holds one block at a time. Documents are
never shuffled.

Defined cases: null and empty texts have no passages and no leaks; items without words leak nowhere;
items or documents that are repeated give a row for each pair; a (document, item) pair has one row,
that of the longest subsequence, ties to the earliest window; an empty table gives no rows; other
columns are not read, or kept as they are (``keep_clean``).

A very long text is searched whole, in the memory of one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import FOLD, Scratch, Words, buffers, mix, runs

SLICE = 1 << 19
PASSAGE, STEP = 32, 8
#: Items, and characters of theirs, in one block that goes to every worker.
BLOCK_ITEMS, BLOCK_CHARS = 4000, 4 << 20
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Settings:
    terms: int = 1 << 13
    rank: int = 64
    extra: int = 8
    rounds: int = 2
    fit_passages: int = 30_000
    cosine: float = 0.65
    least: float = 0.75
    sure: float = 0.9
    fit_tasks: int = 8
    seed: int = 5


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, _APART, FOLD)


def _passages(words: Words, long: int) -> np.ndarray:
    """First words of consecutive passages of so many words; the last of a document may be shorter."""
    place = np.arange(len(words)) - words.first[words.row]
    return np.flatnonzero(place % long == 0)


def _terms(words: Words, s: Settings) -> np.ndarray:
    return (words.hash % np.uint64(s.terms)).astype(np.int64)


def _slices(batches, column: int = 0) -> Iterator[Words]:
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for lo, hi in runs(offsets, SLICE):
            words = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(words):
                yield words


def _frequencies(batches, s: Settings):
    """(term, passages with it); under term -1 the number of passages."""
    total, passages = np.zeros(s.terms, np.int64), 0
    for words in _slices(batches):
        starts = _passages(words, PASSAGE)
        which = np.cumsum(np.bincount(starts, minlength=len(words))) - 1
        key = np.sort((which * s.terms + _terms(words, s)).astype(np.int32 if len(starts) * s.terms < 1 << 31 else np.int64))
        total += np.bincount(key[np.append(True, key[1:] != key[:-1])] % s.terms, minlength=s.terms)
        passages += len(starts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], passages))], names=["term", "n"])


def _sampled(batches, share: float, s: Settings):
    """Terms of the passages whose hash falls under a share."""
    for words in _slices(batches):
        starts = _passages(words, PASSAGE)
        key = mix(np.add.reduceat(words.hash, starts))
        chosen = np.flatnonzero((key >> np.uint64(11)).astype(np.float64) / (1 << 53) < share)
        terms, ends = _terms(words, s), np.append(starts[1:], len(words))
        yield pa.RecordBatch.from_arrays([pa.array([terms[starts[i] : ends[i]].astype(np.int32).tobytes() for i in chosen], pa.binary())], names=["terms"])


def _multiplied(batches, basis: np.ndarray, idf: np.ndarray):
    """A' (A basis) over this task's rows A of unit TF-IDF vectors."""
    out = np.zeros(basis.shape)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            term, n = np.unique(np.frombuffer(raw, np.int32), return_counts=True)
            value = n * idf[term]
            size = math.sqrt(float(value @ value))
            if size:
                value = value / size
                out[term] += np.outer(value, value @ basis[term])
    yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["product"])


def fit_index(documents: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """[terms, rank]: idf-weighted latent vectors of terms."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    text = documents.select(F.col("text").cast("string").alias("text"))
    got = text.mapInArrow(lambda b: _frequencies(b, s), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    passages = max(1, int(n[term < 0].sum()))
    df = np.zeros(s.terms)
    df[term[term >= 0]] = n[term >= 0]
    idf = np.log((1 + passages) / (1 + df))
    share = s.fit_passages / passages
    # documents are chosen first, eight times as many words as are needed, then passages of these
    some = min(1.0, 8 * share)
    few = text.where((F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(some * (1 << 30)))) | F.lit(some == 1.0))
    sample = scratch.save(few.mapInArrow(lambda b: _sampled(b, share / some, s), "terms binary").repartition(s.fit_tasks), "sample")
    basis = np.random.default_rng(s.seed).normal(size=(s.terms, s.rank + s.extra))
    for _ in range(s.rounds):
        basis = np.linalg.qr(basis)[0]
        sent = spark.sparkContext.broadcast((basis.astype(np.float32), idf))
        parts = sample.coalesce(s.fit_tasks).mapInArrow(lambda b, sent=sent: _multiplied(b, *sent.value), "product binary").collect()
        basis = sum((np.frombuffer(r["product"], np.float32).reshape(basis.shape).astype(np.float64) for r in parts), np.zeros(basis.shape))
    scratch.drop("sample")
    # A'A basis = Q R: the leading left vectors of the small factor rotate Q to singular vectors
    q, r = np.linalg.qr(basis)
    vectors = q @ np.linalg.svd(r)[0][:, : s.rank]
    return (vectors * idf[:, None]).astype(np.float32)


class Item:
    """A benchmark item: its words' hashes, and bit masks of where each word stands."""

    def __init__(self, key, text: str | None, answer: str | None):
        words = _words(*buffers(pa.array([text or ""])))
        self.key, self.hash = key, words.hash
        n = len(self.hash)
        self.masks = _masks(self.hash)
        own = _words(*buffers(pa.array([answer or ""]))).hash
        self.answer = own if len(own) else self.hash[n - max(1, n // 4) :]
        self.answer_masks = _masks(self.answer)


def _masks(hashes: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, h in enumerate(hashes.tolist()):
        out[h] = out.get(h, 0) | 1 << i
    return out


def common_length(masks: dict[int, int], n: int, window: list[int]) -> int:
    """Length of the longest common subsequence, by bits: one addition for each word of the window."""
    full = (1 << n) - 1
    v = full
    for h in window:
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Searcher:
    """Benchmark items as latent vectors, by the number of 8-word steps that they span."""

    def __init__(self, items: list[Item], vectors: np.ndarray, s: Settings):
        self.s, self.vectors = s, np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        # in the order of their spans
        self.items = sorted((i for i in items if len(i.hash)), key=lambda i: -(-len(i.hash) // STEP))
        terms = [(i.hash % np.uint64(s.terms)).astype(np.int64) for i in self.items]
        steps = np.array([-(-len(t) // STEP) for t in terms])
        q = np.stack([vectors[t].sum(0) for t in terms]) if terms else np.zeros((0, s.rank), np.float32)
        self.q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.spans = [(int(k), *np.searchsorted(steps, [k, k + 1]).tolist()) for k in np.unique(steps)]
        # which items have a term: the words of a window that an item has too bound their common subsequence
        self.has = np.zeros((s.terms + 1, len(terms)), np.uint8)
        for i, t in enumerate(terms):
            self.has[t, i] = 1
        self.needed = np.array([math.ceil(s.least * len(t)) for t in terms])

    def candidates(self, words: Words):
        """(first word of the window, steps, item, cosine) for all pairs over the threshold. Of these, pairs go on whose shared words could suffice: those of the range that the subsequence is looked for in, from a step before the window to a step after it, bound its length from above."""
        starts, terms = _passages(words, STEP), np.append(_terms(words, self.s), self.s.terms)
        ends = np.append(starts[1:], len(words))
        row, most = words.row[starts], self.spans[-1][0] if self.spans else 0
        for a in range(0, len(starts) if self.spans else 0, 2048):
            b = min(a + 2048, len(starts))
            c = min(b + most + 1, len(starts))
            # the terms of each step, filled up with one that stands for none
            own = starts[a:c, None] + np.arange(STEP)
            own = terms[np.where(own < ends[a:c, None], own, len(words))]
            part = self.vectors[own[:, 0]]
            for i in range(1, STEP):
                part += self.vectors[own[:, i]]
            window, taken = np.zeros((b - a, part.shape[1]), np.float32), 0
            for steps, lo, hi in self.spans:
                while taken < steps:
                    live = max(0, min(b - a, c - a - taken))
                    same = row[a + taken : a + taken + live] == row[a : a + live]
                    window[:live] += part[taken : taken + live] * same[:, None]
                    taken += 1
                size = np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-6)
                cos = (window / size) @ self.q[lo:hi].T
                hit, item = np.nonzero(cos > self.s.cosine)
                for z in range(0, len(hit), 1 << 15):
                    w, i = hit[z : z + (1 << 15)], item[z : z + (1 << 15)]
                    first, last = words.first[row[a + w]], words.first[row[a + w] + 1]
                    place = starts[a + w][:, None] + np.arange(-STEP, (steps + 1) * STEP)
                    inside = (place >= first[:, None]) & (place < last[:, None])
                    shared = self.has[terms[np.where(inside, place, len(words))], lo + i[:, None]].sum(1, dtype=np.int32)
                    enough = shared >= self.needed[lo + i]
                    w, i = w[enough], i[enough]
                    yield from zip(starts[a + w].tolist(), [steps] * len(w), (lo + i).tolist(), cos[w, i].tolist())

    def leaks(self, words: Words) -> dict[tuple[int, int], tuple[int, float, float, int]]:
        """(row, item) -> (common words, share of the item, cosine, word where the window begins)."""
        found: dict[tuple[int, int], tuple[int, float, float, int]] = {}
        for at, steps, n, cos in self.candidates(words):
            item, row = self.items[n], int(words.row[at])
            lo, hi = max(at - STEP, int(words.first[row])), min(at + (steps + 1) * STEP, int(words.first[row + 1]))
            window = words.hash[lo:hi].tolist()
            size = len(item.hash)
            common = common_length(item.masks, size, window)
            if common < self.s.least * size:
                continue
            if common < self.s.sure * size and common_length(item.answer_masks, len(item.answer), window) < self.s.least * len(item.answer):
                continue
            if (row, n) not in found or common > found[row, n][0]:
                found[row, n] = (common, common / size, cos, lo - int(words.first[row]))
        return found


def read_benchmark(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items in blocks, dealt by hash; columns item_id, text and, if there is one, answer."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"), answer.alias("answer"))
    n, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-(chars or 0) // BLOCK_CHARS))
    for i in range(blocks if n else 0):
        items = [Item(r["item_id"], r["text"], r["answer"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toLocalIterator()]
        if items:
            yield items


def find_leaks(documents: DataFrame, benchmark: DataFrame, vectors: np.ndarray | None = None, s: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, common, share, cosine, at: one row for each document and item that leaks into it."""
    spark = documents.sparkSession
    ship_package(spark)
    vectors = fit_index(documents, s) if vectors is None else vectors
    doc, item = (f.schema[c].dataType.simpleString() for f, c in ((documents, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc}, item_id {item}, common int, share double, cosine double, at long"
    out = spark.createDataFrame([], schema)
    for block in read_benchmark(benchmark):
        sent = spark.sparkContext.broadcast((block, vectors))

        def found(batches, sent=sent):
            searcher = Searcher(*sent.value, s)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                rows = []
                data, offsets = buffers(batch.column(1))
                for lo, hi in runs(offsets, SLICE):
                    words = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    if len(words):
                        rows += [(keys[lo + row], searcher.items[n].key, *x) for (row, n), x in sorted(searcher.leaks(words).items())]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, t) if t else pa.array(c) for c, t in zip(cols[1:], (None, pa.int32(), pa.float64(), pa.float64(), pa.int64())))], names=["doc_id", "item_id", "common", "share", "cosine", "at"])

        out = out.unionAll(documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(found, schema))
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, vectors: np.ndarray | None = None, s: Settings = Settings()) -> DataFrame:
    """documents, all columns, without those into which an item leaks; nothing is shuffled."""
    spark = documents.sparkSession
    ship_package(spark)
    vectors = fit_index(documents, s) if vectors is None else vectors
    text_at = documents.columns.index("text")
    for block in read_benchmark(benchmark):
        sent = spark.sparkContext.broadcast((block, vectors))

        def kept(batches, sent=sent):
            searcher = Searcher(*sent.value, s)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                data, offsets = buffers(batch.column(text_at))
                for lo, hi in runs(offsets, SLICE):
                    words = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    if len(words):
                        keep[[lo + row for row, _ in searcher.leaks(words)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(kept, documents.schema)
    return documents
