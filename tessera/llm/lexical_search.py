"""Ranked lexical search over a bit-sliced impact index.

Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term's
impact in a document is ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``, where
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, ``m = 25 + (75 * n * N) div L``, ``n`` the
document's terms, ``N`` the documents that have any, ``L`` the terms of all; a document's score is the
sum over the item's terms, repeats included.

1. Texts are read once. Each document becomes a short row of the asked terms that it holds, with
   their counts, in a table of the shared folder; ``df``, ``N`` and ``L`` are sums over that table.
2. Each block of a few thousand documents becomes a bit-sliced index: for each term one bitmap over
   the block's documents for every bit of the impact.
3. An item's scores are the sum of its terms' slices, added by carry arithmetic on whole bitmaps,
   many items at a time. The first k are found by walking the sum's slices from the most significant
   one: documents that have the bit go before those that have not. Nothing is sorted, and no row
   arises for a pair of item and document.
4. Each task keeps k documents an item over all its blocks; a window merges the tasks' lists.

Words are looked up by a 64-bit hash: another word is taken for an asked one with probability 5e-20
for each pair of them. Items are asked in sets of at most ``SET_TERMS`` terms (a bounded broadcast);
each further set reads the texts again.

Defined cases: a null text has no terms; a document without terms is in no count; an item without
terms, or an empty table of either kind, gives no rows; repeated rows of documents rank each by
itself and repeated rows of items are each answered; equal scores rank by ascending doc_id (whole
numbers), null last; very long texts are cut between terms into pieces of ``PIECE`` bytes whose
counts are summed; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import Scratch, Words, buffers, runs

#: Bytes that stand between terms: those of ASCII that are neither letters nor digits.
APART = np.ones(256, bool)
APART[128:] = False
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    APART[_first:_last] = False

#: Bytes of text looked at together, and of a text's piece.
PIECE = 1 << 22
#: Terms of the items that are asked in one set, repeats included.
SET_TERMS = 500_000
#: Documents of a block, and bytes of its slices, at most (unless one group of 64 documents has more).
BLOCK_DOCS, BLOCK_BYTES = 8192, 96 << 20
#: Items added together.
ITEMS = 32


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the rows with long ones cut between terms, and the row of each piece."""
    if not len(offsets) or int(np.diff(offsets).max(initial=0)) <= PIECE:
        return offsets, np.arange(len(offsets) - 1)
    bounds, owner = [0], []
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = lo + PIECE
        while at < hi:
            gap = np.flatnonzero(APART[data[at : min(at + 65536, hi)]])
            if not len(gap):
                at += 65536
                continue
            bounds.append(at + int(gap[0]))
            owner.append(row)
            at = bounds[-1] + PIECE
        bounds.append(hi)
        owner.append(row)
    return np.array(bounds, np.int64), np.array(owner, np.int64)


def count_terms(data: np.ndarray, offsets: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its number of terms; and (row, place in asked, count), by row and place, of the asked terms it holds. asked: sorted hashes."""
    rows, width = len(offsets) - 1, max(1, len(asked))
    n, keys, counts = np.zeros(rows, np.int64), [], []
    bounds, owner = _pieces(data, offsets)
    for lo, hi in runs(bounds, PIECE):
        words = Words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], APART)
        np.add.at(n, owner[lo:hi], np.diff(words.first))
        if len(words) and len(asked):
            at = np.minimum(np.searchsorted(asked, words.hash), len(asked) - 1)
            hit = asked[at] == words.hash
            key, count = np.unique(owner[lo + words.row[hit]] * width + at[hit], return_counts=True)
            keys.append(key)
            counts.append(count)
    if not keys:
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
    return n, key // width, key % width, count


def _postings(documents: DataFrame, asked) -> DataFrame:
    """doc_id, n, terms, counts of the documents that hold any term; asked: the broadcast hashes."""

    def counted(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n, row, term, count = count_terms(data, offsets, asked.value)
            bounds = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (term, count)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "doc_id long, n long, terms array<int>, counts array<int>")


def _statistics(postings: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each asked term: one row for each task and term that it has seen."""

    def summed(batches):
        total, df = np.zeros(2, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            total += batch.num_rows, int(batch.column(0).to_numpy(zero_copy_only=False).sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([total, df[at]]))], names=["term", "n"])

    df, total = np.zeros(width, np.int64), np.zeros(2, np.int64)
    for row in postings.select("n", "terms").mapInArrow(summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        (df if row["term"] >= 0 else total)[row["term"]] = row["n"]
    return int(total[0]), int(total[1]), df


class Items:
    """Items of one set: keys, and for each the places of its terms among the sorted hashes, repeats included."""

    def __init__(self, keys: list, texts: list):
        data, offsets = buffers(pa.array(texts, pa.string()))
        words = Words(data, offsets, APART)
        self.keys = keys
        self.hash, at = np.unique(words.hash, return_inverse=True)
        self.terms = [at[a:b] for a, b in zip(words.first[:-1], words.first[1:])]


class Slices:
    """The index of one block: rows[t] is the place of term t, bits[i, b] the bitmap of bit b of the term at place i; place 0 is empty."""

    def __init__(self, docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, width: int):
        """term, doc, impact: by term, then by doc."""
        kept = impact > 0
        term, doc, impact = term[kept], doc[kept], impact[kept]
        self.words = max(1, (docs + 63) >> 6)
        own, first = np.unique(term, return_index=True)
        self.rows = np.zeros(width, np.int64)
        self.rows[own] = np.arange(1, len(own) + 1)
        self.depth = int(impact.max(initial=0)).bit_length()
        self.bits = np.zeros((len(own) + 1, self.depth, self.words), np.uint64)
        if len(own):
            # documents of a term that share a word of the bitmap are joined into it
            cell = (self.rows[term] * self.words + (doc >> 6)).astype(np.int64)
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            at, word = cell[starts] // self.words, cell[starts] % self.words
            bit = np.uint64(1) << (doc & 63).astype(np.uint64)
            value = impact.astype(np.uint64)
            for b in range(self.depth):
                self.bits[at, b, word] = np.bitwise_or.reduceat(np.where((value >> np.uint64(b)) & np.uint64(1), bit, np.uint64(0)), starts)

    def add(self, terms: list[np.ndarray]) -> np.ndarray:
        """Slices of the sums of some items, [bit, item, word]: ripple carry over bitmaps, one term of each item at a time."""
        steps = max(map(len, terms), default=0)
        depth = self.depth + steps.bit_length()
        out = np.zeros((depth, len(terms), self.words), np.uint64)
        for step in range(steps):
            at = np.array([self.rows[t[step]] if step < len(t) else 0 for t in terms])
            live = np.flatnonzero(at)
            if not len(live):
                continue
            whole = len(live) == len(terms)
            added = self.bits[at[live]]
            carry = np.zeros((len(live), self.words), np.uint64)
            for b in range(depth):
                if b >= self.depth and not carry.any():
                    break
                own = out[b] if whole else out[b, live]
                if b < self.depth:
                    more = added[:, b]
                    half = own ^ more
                    digit, carry = half ^ carry, (own & more) | (carry & half)
                else:
                    digit, carry = own ^ carry, own & carry
                out[b, slice(None) if whole else live] = digit
        return out


def first_k(sums: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) of the k highest sums over 0 of each item, equal ones by ascending place."""
    items, words = sums.shape[1:]
    sure, open_ = np.zeros((items, words), np.uint64), np.bitwise_or.reduce(sums, axis=0)
    taken = np.zeros(items, np.int64)
    few = np.bitwise_count(open_).sum(1, dtype=np.int64) <= k
    sure[few], open_[few] = open_[few], 0
    for b in range(len(sums) - 1, -1, -1):
        ones = open_ & sums[b]
        n = np.bitwise_count(ones).sum(1, dtype=np.int64)
        enough = (taken + n >= k)[:, None]
        sure = np.where(enough, sure, sure | ones)
        taken += np.where(enough[:, 0], 0, n)
        open_ = np.where(enough, ones, open_ & ~sums[b])
    for i in range(items):
        places = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
        if not few[i] and len(places) < k:
            tied = np.flatnonzero(np.unpackbits(open_[i].view(np.uint8), bitorder="little"))
            places = np.concatenate([places, tied[: k - len(places)]])
        if len(places):
            bits = (sums[:, i, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            yield i, places, (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(0)


class Searcher:
    """The best k documents of each item over the blocks of one task."""

    def __init__(self, items: Items, weights: np.ndarray, docs: int, terms: int, k: int):
        self.items, self.weights, self.docs, self.terms, self.k = items, weights, docs, terms, k
        size = len(items.keys)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * size
        #: items of about the same number of terms are added together
        self.order = np.argsort([len(t) for t in items.terms], kind="stable")

    def block(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """ids, null, n: of the block's documents, by (null, id); doc, term, tf: its postings, by term and doc."""
        size = len(np.unique(term)) + 1
        if len(ids) > 64 and size * 40 * 8 * ((len(ids) + 63) >> 6) > BLOCK_BYTES:
            half = len(ids) // 2
            low = doc < half
            self.block(ids[:half], null[:half], n[:half], doc[low], term[low], tf[low])
            self.block(ids[half:], null[half:], n[half:], doc[~low] - half, term[~low], tf[~low])
            return
        m = 25 + (75 * n * self.docs) // self.terms
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        slices = Slices(len(ids), term, doc, impact, len(self.items.hash))
        for lo in range(0, len(self.order), ITEMS):
            chunk = self.order[lo : lo + ITEMS]
            for i, places, score in first_k(slices.add([self.items.terms[j] for j in chunk]), self.k):
                self.keep(int(chunk[i]), ids[places], null[places], score)

    def keep(self, item: int, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        own = self.best[item]
        ids, null, score = (np.concatenate([a, b]) for a, b in zip(own, (ids, null, score)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.best[item] = ids[order], null[order], score[order]


def _searched(batches, sent, k: int):
    """Rows (item, doc_id, score): the best of this task."""
    items, weights, docs, terms = sent.value
    searcher = Searcher(items, weights, docs, terms, k)
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(lo, BLOCK_DOCS)
            null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            place = np.empty(len(ids), np.int64)
            order = np.lexsort((ids, null))
            place[order] = np.arange(len(ids))
            sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(place, sizes)
            term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            by = np.lexsort((doc, term))
            searcher.block(ids[order], null[order], part.column(1).to_numpy(zero_copy_only=False)[order], doc[by], term[by], tf[by])
    kept = [(i, x) for i, x in enumerate(searcher.best) if len(x[0])]
    if kept:
        item = np.repeat([i for i, _ in kept], [len(x[0]) for _, x in kept])
        ids, null, score = (np.concatenate([x[c] for _, x in kept]) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"])


def read_items(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Keys and texts of the items in sets of at most SET_TERMS terms, or one item."""
    keys, texts, size = [], [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len(row["text"] or "") // 2 + 1
        if keys and size + n > SET_TERMS:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if keys:
        yield keys, texts


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    spark = documents.sparkSession
    ship_package(spark)
    kind = items.schema["item_id"].dataType
    scratch, out = Scratch(spark, "lexical"), None
    for number, (keys, texts) in enumerate(read_items(items)):
        own = Items(keys, texts)
        postings = scratch.save(_postings(documents, spark.sparkContext.broadcast(own.hash)), f"postings-{number}")
        docs, terms, df = _statistics(postings, len(own.hash))
        weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        sent = spark.sparkContext.broadcast((own, weights, docs, terms))
        best = scratch.save(postings.mapInArrow(lambda batches, sent=sent: _searched(batches, sent, k), "item int, doc_id long, score long"), f"best-{number}")
        scratch.drop(f"postings-{number}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # the keys of one set, of SET_TERMS items at most
        named = spark.createDataFrame(list(enumerate(keys)), f"item int, item_id {kind.simpleString()}")
        rows = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionAll(rows)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out
