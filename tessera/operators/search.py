"""Top-k search, lexical and by vectors, for a stated set of queries against all rows.

Queries are taken in blocks of at most ``MAX_QUERIES`` (a bounded broadcast) and sent to the rows.
A task scores its rows block by block, as products of small matrices, and keeps the best k of each
query; a window merges the tasks' lists. No word is shuffled, and no row arises for a pair of query
and passage.

Defined cases: null texts and vectors match nothing; vectors of another length than the query's are
not compared; a query without words or vector has no rows; equal scores (to six digits) go by
ascending key; repeated keys each count; empty tables give no rows. Keys are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import pieces, sliced
from tessera.session import ship_package

#: Queries that go to every worker at once; those that are scored together; rows of a block.
MAX_QUERIES, TOGETHER, ROWS = 4096, 256, 1024
#: What stands between words, in lower-cased text.
GAPS = "[^a-z0-9]+"
K1, B = 1.2, 0.75
#: Rows that cells are fitted on.
SAMPLE = 8192


class Best:
    """The k best rows of each query: highest score, then least key."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.of, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        #: the score of each query's k-th row so far
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, keys: np.ndarray, fits: np.ndarray, first: int) -> None:
        """scores, fits: [row, query], of the queries from first on."""
        least = self.least[first : first + scores.shape[1]]
        fits &= scores >= least
        if len(keys) > self.k:
            held = np.where(fits, scores, -np.inf)
            fits &= held >= np.partition(held, len(keys) - self.k, axis=0)[len(keys) - self.k]
        row, column = np.nonzero(fits)
        if not len(row):
            return
        of, score, key = (np.concatenate(x) for x in ((self.of, first + column), (self.score, scores[row, column]), (self.key, keys[row])))
        order = np.lexsort((key, -score, of))
        order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < self.k]
        self.of, self.score, self.key = of[order], score[order], key[order]
        full = np.bincount(self.of, minlength=self.queries) >= self.k
        last = np.full(self.queries, np.inf)
        np.minimum.at(last, self.of, self.score)
        self.least[full] = last[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.of.astype(np.int32)), pa.array(self.key), pa.array(self.score)], names=["of", "key", "score"])


@dataclass
class Asked:
    """A block of queries: their keys, and what each is asked with."""

    keys: list
    words: list[list[str]]
    vectors: list
    only: list
    terms: pa.Array = field(init=False)

    def __post_init__(self):
        self.terms = pa.array(sorted({w for own in self.words for w in own}), pa.string())

    def groups(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, the terms of some queries, which query asks which of them)."""
        at = {t: i for i, t in enumerate(self.terms.to_pylist())}
        for lo in range(0, len(self.keys), TOGETHER):
            own = [[at[w] for w in words] for words in self.words[lo : lo + TOGETHER]]
            terms = np.unique(np.concatenate([np.zeros(0, np.int64), *map(np.array, own)])).astype(np.int64)
            asks = np.zeros((len(terms), len(own)))
            for q, words in enumerate(own):
                asks[np.searchsorted(terms, words), q] = 1
            yield lo, terms, asks

    def allowed(self, only: np.ndarray | None) -> np.ndarray | None:
        """[row, query]: rows of the value that a query is bound to; all, where it is bound to none."""
        if only is None or not any(x is not None for x in self.only):
            return None
        bound = np.array(self.only, object)
        return np.equal(only[:, None], bound) | np.equal(bound, None)


def asked(queries: DataFrame, key: str, text: str | None = None, vector: str | None = None, only: str | None = None) -> Iterator[Asked]:
    """The queries in blocks; words are lower-cased runs of a-z and digits."""
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))) if text else F.array().cast("array<string>")
    rows = queries.select(F.col(key).alias("key"), own.alias("words"), (F.col(vector) if vector else F.lit(None)).cast("array<double>").alias("vector"), (F.col(only) if only else F.lit(None)).cast("string").alias("only"))
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == MAX_QUERIES:
            yield Asked(*map(list, zip(*held)))
            held = []
    if held:
        yield Asked(*map(list, zip(*held)))


def _merged(found: DataFrame, block: Asked, query_key: str, query_type: str, key: str, k: int) -> DataFrame:
    """Ranks over what the tasks found, under the queries' own keys."""
    spark = found.sparkSession
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "key"))
    # the keys of one block of queries
    named = spark.createDataFrame(list(enumerate(block.keys)), f"of int, {query_key} {query_type}")
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(named), "of").select(query_key, F.col("key").alias(key), F.round("score", 6).alias("score"), "rank")


def _all(found: list[DataFrame], spark, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema) if not found else found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


# --- lexical ------------------------------------------------------------------


def term_lists(passages: DataFrame, key: str, text: str = "text", also: list[str] = ()) -> DataFrame:
    """(key, size, terms, counts, others): each passage's words and how often it has them."""
    ship_package(passages.sparkSession)

    def listed(batches):
        for whole in batches:
            # few texts at a time, however large the batches are that come
            for batch in sliced(whole, 1):
                words = pc.split_pattern_regex(pc.fill_null(batch.column(1), ""), GAPS)
                flat = words.flatten().dictionary_encode()
                row = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
                code, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
                full = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                row, code = row[full], code[full]
                pair, count = np.unique(row * max(1, len(names)) + code, return_counts=True)
                bounds = np.searchsorted(pair // max(1, len(names)), np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), names.take(pa.array(pair % max(1, len(names))))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=batch.num_rows)), *lists, *batch.columns[2:]], names=["key", "size", "terms", "counts", *also])

    kinds = "".join(f", {c} {passages.schema[c].dataType.simpleString()}" for c in also)
    return passages.select(F.col(key).cast("long").alias("key"), F.lower(text).alias("text"), *also).mapInArrow(listed, f"key long, size long, terms array<string>, counts array<int>{kinds}")


def _hits(batch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the asked terms in a batch of term lists."""
    lists, counts = batch.column("terms"), batch.column("counts")
    at = pc.fill_null(pc.index_in(lists.flatten(), terms), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    hit = at >= 0
    return row[hit], at[hit], counts.flatten().to_numpy(zero_copy_only=False)[hit]


def _of_lists(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[tuple]:
    """(rows, their sizes, then row, term and count of the asked terms) of term lists, a block of rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, part.column("size").to_numpy(zero_copy_only=False), *_hits(part, terms)


def _of_texts(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[tuple]:
    """The same of lower-cased texts, of a bounded size at a time: no list of a text's words leaves the task, and only asked words are counted."""
    for part in pieces(batches, "text", ROWS):
        words = pc.split_pattern_regex(pc.fill_null(part.column("text"), ""), GAPS)
        row, flat = np.repeat(np.arange(part.num_rows), words.value_lengths().to_numpy(zero_copy_only=False)), words.flatten()
        size = np.bincount(row[pc.not_equal(flat, "").to_numpy(zero_copy_only=False)], minlength=part.num_rows)
        at = pc.fill_null(pc.index_in(flat, terms), -1).to_numpy(zero_copy_only=False)
        hit = at >= 0
        pair, count = np.unique(row[hit] * max(1, len(terms)) + at[hit], return_counts=True)
        yield part, size, pair // max(1, len(terms)), pair % max(1, len(terms)), count
        # else the batch that it is a part of stays while the next one is read
        del part


def statistics(rows: DataFrame, terms: pa.Array, read=_of_lists) -> tuple[int, float, np.ndarray]:
    """Number of passages, their mean size, and in how many each term occurs; one row a task and term meets in the sum."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def counted(batches):
        n, total, df = 0, 0, np.zeros(len(sent.value), np.int64)
        for part, size, _, term, _ in read(batches, sent.value):
            n, total = n + part.num_rows, total + int(size.sum())
            df += np.bincount(term, minlength=len(df))
            del part
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[n, total], df[at]]))], names=["term", "n"])

    total, df = [0, 0], np.zeros(len(terms), np.int64)
    for row in rows.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        (df if row["term"] >= 0 else total)[row["term"]] = row["n"]
    return total[0], total[1] / max(1, total[0]), df


def _bm25(rows: DataFrame, read, queries: DataFrame, key: str, query_key: str, k: int, text: str, only: tuple[str, str] | None) -> DataFrame:
    """BM25 over rows of (key, what read takes, only)."""
    spark, query_type, found = rows.sparkSession, queries.schema[query_key].dataType.simpleString(), []
    ship_package(spark)
    for block in asked(queries, query_key, text=text, only=only and only[1]):
        n, mean, df = statistics(rows, block.terms, read)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        sent = spark.sparkContext.broadcast((block, list(block.groups()), idf, mean))

        def scored(batches, sent=sent):
            block, groups, idf, mean = sent.value
            best = Best(len(block.keys), k)
            for part, size, row, term, tf in read(batches, block.terms):
                keys = part.column("key").to_numpy(zero_copy_only=False)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
                allowed = block.allowed(np.array(part.column("only").to_pylist(), object) if only else None)
                for first, terms, asks in groups:
                    at = np.searchsorted(terms, term)
                    own = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == term) if len(terms) else np.zeros(0, np.int64)
                    cells = np.zeros((part.num_rows, len(terms)))
                    cells[row[own], at[own]] = weight[own]
                    scores = np.round(cells @ asks, 6)
                    fits = scores > 0
                    if allowed is not None:
                        fits &= allowed[:, first : first + fits.shape[1]]
                    best.add(scores, keys, fits, first)
                del part, keys
            yield best.batch()

        found.append(_merged(rows.where(F.col("key").isNotNull()).mapInArrow(scored, "of int, key long, score double"), block, query_key, query_type, key, k))
    return _all(found, spark, f"{query_key} {query_type}, {key} long, score double, rank int")


def _bound_to(only: tuple[str, str] | None) -> list:
    return [F.col(only[0]).cast("string").alias("only")] if only else []


def bm25_lists(lists: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, *, text: str = "text", only: tuple[str, str] | None = None) -> DataFrame:
    """BM25 over stored term lists: (query, passage, score, rank), the first k. only: a column of the lists and one of the queries that have to be equal where the query's is not null; counts stay those of all passages."""
    return _bm25(lists.select("key", "size", "terms", "counts", *_bound_to(only)), _of_lists, queries, key, query_key, k, text, only)


def bm25_topk(passages: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, *, only: tuple[str, str] | None = None) -> DataFrame:
    """The k passages of highest BM25 for each query. Texts are read twice, for the counts and for the scores, by one Python worker a task; ``text_index`` keeps the lists."""
    return _bm25(passages.select(F.col(key).cast("long").alias("key"), F.lower("text").alias("text"), *_bound_to(only)), _of_texts, queries, key, query_key, k, "text", only)


# --- vectors ------------------------------------------------------------------


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have so many components and no nulls, and their places."""
    column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.flatnonzero(sizes == width)
    rows = flat.reshape(-1, width) if len(at) == len(sizes) else flat[(ends[at] - width)[:, None] + np.arange(width)]
    good = ~np.isnan(rows).any(1) if rows.size else np.ones(len(at), bool)
    return rows[good], at[good]


def _gaps(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((rows * rows).sum(1)[:, None] + (points * points).sum(1) - 2 * rows @ points.T, 0)


class Cells:
    """An inverted file over vectors: centres fitted on a bounded sample; every row belongs to its nearest."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @classmethod
    def fit(cls, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", cells: int = 32, turns: int = 8) -> Cells:
        """Centres of at most SAMPLE rows, picked by the hash of their keys."""
        own = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, F.col(vector).cast("array<double>").alias("v"))
        rows = [r["v"] for r in own.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").toLocalIterator()]
        if not rows:
            return cls(np.zeros((0, 0)))
        width = len(rows[0])
        points = np.array([r for r in rows if len(r) == width and all(x is not None and x == x for x in r)])
        centres = points[np.random.default_rng(3).permutation(len(points))[:cells]]
        for _ in range(turns):
            near = _gaps(points, centres).argmin(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = points[near == c].mean(0)
        return cls(centres)

    def assign(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """vectors with ``cell``; rows without a comparable vector have none. Written sorted or partitioned by it, a search skips the other cells' files."""
        ship_package(vectors.sparkSession)
        centres, place = self.centres, vectors.columns.index(vector)

        def assigned(batches):
            for batch in batches:
                cell = np.full(batch.num_rows, -1, np.int32)
                if len(centres):
                    rows, at = _matrix(batch.column(place), centres.shape[1])
                    cell[at] = _gaps(rows, centres).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, mask=cell < 0)], names=[*batch.schema.names, "cell"])

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        return vectors.mapInArrow(assigned, f"{kind}, cell int")

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """[cell, query]: the n cells nearest to each query."""
        out = np.zeros((len(self.centres), len(queries)), bool)
        near = np.argsort(_gaps(queries, self.centres), axis=1, kind="stable")[:, :n]
        out[near.T, np.arange(len(queries))] = True
        return out


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector", *, only: tuple[str, str] | None = None, cells: Cells | None = None, probes: int | None = None) -> DataFrame:
    """The k nearest vectors of each query: (query, vector, score, rank), score 1 / (1 + distance). cells, probes: vectors has a ``cell``, and of each query the so many nearest are searched (None: all, the exact form). only: a column of the vectors and one of the queries that have to be equal where the query's is not null; it holds before the ranking."""
    spark, query_type, found = vectors.sparkSession, queries.schema[query_key].dataType.simpleString(), []
    ship_package(spark)
    for block in asked(queries, query_key, vector=query_vector, only=only and only[1]):
        width = max((len(v) for v in block.vectors if v), default=0)
        able = np.array([v is not None and len(v) == width > 0 and not any(x is None or x != x for x in v) for v in block.vectors])
        points = np.array([v if ok else [0.0] * width for v, ok in zip(block.vectors, able)]).reshape(len(able), width)
        near = cells.probes(points, probes) if cells is not None and probes and len(cells.centres) else None
        sent = spark.sparkContext.broadcast((block, points, able, near))

        def scored(batches, sent=sent):
            block, points, able, near = sent.value
            best = Best(len(block.keys), k)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    rows, at = _matrix(part.column("vector"), points.shape[1])
                    keys = part.column("key").to_numpy(zero_copy_only=False)[at]
                    allowed = block.allowed(np.array(part.column("only").to_pylist(), object)[at] if only else None)
                    for first in range(0, len(points), TOGETHER):
                        some = points[first : first + TOGETHER]
                        scores = np.round(1 / (1 + np.sqrt(_gaps(rows, some))), 6)
                        # near rows lose digits in the product: measured again
                        r, q = np.nonzero(scores > 0.9)
                        scores[r, q] = np.round(1 / (1 + np.sqrt(((rows[r] - some[q]) ** 2).sum(1))), 6)
                        fits = np.broadcast_to(able[first : first + TOGETHER], scores.shape).copy()
                        if near is not None:
                            fits &= near[part.column("cell").to_numpy(zero_copy_only=False)[at].astype(np.int64)][:, first : first + TOGETHER]
                        if allowed is not None:
                            fits &= allowed[:, first : first + TOGETHER]
                        best.add(scores, keys, fits, first)
            yield best.batch()

        rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
        if near is not None:
            rows = rows.where(F.col("cell").isin(np.flatnonzero(near.any(1)).tolist()))
        rows = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), *(["cell"] if near is not None else []), *([F.col(only[0]).cast("string").alias("only")] if only else []))
        found.append(_merged(rows.mapInArrow(scored, "of int, key long, score double"), block, query_key, query_type, key, k))
    return _all(found, spark, f"{query_key} {query_type}, {key} long, score double, rank int")


# --- both ---------------------------------------------------------------------


def scaled(ranked: DataFrame, query_key: str) -> DataFrame:
    """Scores between 0, the least of a query's list, and 1, the greatest; all 1 where they are equal."""
    w = Window.partitionBy(query_key)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def hybrid(dense: DataFrame, lexical: DataFrame, query_key: str, key: str, k: int, lexical_weight: float = 0.5) -> DataFrame:
    """Two ranked lists as one: reciprocal ranks at the weight of one half, else the weighted sum of scaled scores."""
    from tessera.operators import retrieval as R

    if abs(min(1.0, max(0.0, lexical_weight)) - 0.5) <= 1e-9:
        return R.fuse_ranks([dense, lexical], query_key, key, k)
    return R.fuse_linear(scaled(dense, query_key), scaled(lexical, query_key), query_key, key, k, lexical_weight)


def search(queries: DataFrame, query_key: str, key: str, k: int, *, dense=None, lexical=None, use_hybrid: bool = True, lexical_weight: float = 0.5, depth: int | None = None) -> DataFrame:
    """The dispatcher: dense and lexical are functions (queries, k) -> ranked rows. Without hybrid, or without one of them, the other's list alone; a query with a blank text gets the dense list, as the lexical one is empty."""
    if dense is None and lexical is None:
        raise ValueError("nothing to search by")
    n = depth or k
    if lexical is None or (not use_hybrid and dense is not None):
        return dense(queries, k)
    if dense is None:
        return lexical(queries, k)
    return hybrid(dense(queries, n), lexical(queries, n), query_key, key, k, lexical_weight)

