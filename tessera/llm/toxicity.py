"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs (next to each other) and skip-grams (pairs with one or
two words between) of a text, and the beginnings of its words (of 4, 5 and 6 bytes, so that inflected
forms share weight), hashed to ``2**bits`` coordinates. Words are runs of letters, digits
and bytes above 127, A-Z lower-cased. FTRL keeps a learning rate per coordinate, and its L1 term
leaves few weights other than zero: these, at most ``2**bits`` of them, go to the workers.

The classifier is fitted on at most ``max_rows`` labelled rows, chosen by a hash of their id: a
documented bound. FTRL takes one row after another, so one task does it: it reads the rows' whole
feature lists, each at most ``2**bits`` numbers, as a stream sorted by epoch, in another order each
epoch, and returns the weights. Scores are computed for whole texts of all rows without shuffle.

Defined cases: a null or empty text has no features and is scored by the bias alone; rows without a
label, or with a null label, take no part in fitting; where a doc_id has several labels the largest
counts; repeated rows are scored each; without usable labels every score is 0 and predicted 0, as
nothing gives ground to reject; columns other than those named are not read.

A very long text is scored whole, in the memory of one task; each row is judged by itself, so no
ties arise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import POWERS, FOLD, RANDOM_OF_BYTE, Scratch, Words, buffers, mix, runs

#: Bytes of text that are turned into features at once.
SLICE = 2 << 20
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BEGINNINGS = (4, 5, 6)
_PAIR = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    max_rows: int = 8192
    epochs: int = 2
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0
    threshold: float = 0.3


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Yields (coordinate, row) arrays, one for each kind of feature; not yet distinct."""
    words = Words(data, offsets, _APART, FOLD)
    shift = np.uint64(64 - bits)
    h, row = words.hash, words.row
    yield (h >> shift).astype(np.int32), row
    if len(h):
        length, begun = words.ends - words.starts, np.zeros(len(h), np.uint64)
        for j in range(max(_BEGINNINGS)):
            has = length > j
            begun[has] += RANDOM_OF_BYTE[FOLD[data[words.starts[has] + j]]] * POWERS[j]
            if j + 1 in _BEGINNINGS:
                yield (mix(begun[has] + np.uint64(j)) >> shift).astype(np.int32), row[has]
    for gap, salt in enumerate(_PAIR, 1):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            yield (mix(h[:-gap] * salt + h[gap:]) >> shift).astype(np.int32)[same], row[gap:][same]


def _lists(batches, bits: int):
    """Each row's distinct coordinates, for fitting."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        labels = batch.column(1).to_pylist()
        for i in range(len(labels)):
            got = [c for c, _ in features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), bits)]
            own = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int32)
            # differences of sorted coordinates: smaller when compressed
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([labels[i]], pa.int32()), pa.array([np.diff(own, prepend=0).astype(np.int32).tobytes()])], names=["id", "label", "list"])


def fit_ftrl(examples, share: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights by coordinate and the bias, which is the log-odds of label 1 among the rows and stays: a text without features is judged by that share alone. examples: the (label, coordinates) of all epochs, in their order."""
    size = 1 << s.bits
    z, n = np.zeros(size), np.zeros(size)
    bias = float(np.log(share / (1 - share)))

    def weights(at):
        over = np.abs(z[at]) - s.l1
        return np.where(over <= 0, 0.0, -np.sign(z[at]) * over / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for label, at in examples:
        w = weights(at)
        g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
        z[at] += g - step * w
        n[at] += g * g
    return weights(np.arange(size)).astype(np.float32), bias


def fit_toxicity(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, usable=None) -> tuple[np.ndarray, float] | None:
    """usable: condition on doc_id of the labelled rows that may be learnt from. None if there are none."""
    spark = documents.sparkSession
    ship_package(spark)
    s = settings
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        own = own.where(usable)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    # max_rows small rows at most: safe to send to every worker
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "toxicity")
    lists = scratch.save(texts.mapInArrow(lambda batches: _lists(batches, s.bits), f"id {kind}, label int, list binary"), "lists")
    n, ones = lists.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n:
        return None

    def fitted(batches):
        def examples():
            for batch in batches:
                for label, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield label, np.cumsum(np.frombuffer(own.as_buffer(), np.int32))

        weights, bias = fit_ftrl(examples(), (ones + 0.5) / (n + 1), s)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([weights[at].tobytes()]), pa.array([bias])], names=["at", "weight", "bias"])

    epochs = lists.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(s.epochs)))))
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", F.xxhash64("id", "epoch"), "id", "list").select("label", "list")
    # long lists: few of them in a batch
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "256")
    try:
        got = ordered.mapInArrow(fitted, "at binary, weight binary, bias double").first()
    finally:
        spark.conf.set(name, before)
    scratch.drop("lists")
    weights = np.zeros(1 << s.bits, np.float32)
    weights[np.frombuffer(got["at"], np.int32)] = np.frombuffer(got["weight"], np.float32)
    return weights, got["bias"]


def score_texts(column, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Probability of label 1 for each row of a string column."""
    data, offsets = buffers(column)
    total = np.full(len(offsets) - 1, bias)
    for lo, hi in runs(offsets, SLICE):
        at, row = [], []
        for c, r in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits):
            hit = np.flatnonzero(weights[c])
            at.append(c[hit])
            row.append(r[hit])
        if at:
            pairs = np.unique((np.concatenate(row).astype(np.int64) << bits) | np.concatenate(at))
            total[lo:hi] += np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], hi - lo)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def sparse(model: tuple[np.ndarray, float] | None):
    """The weights other than zero, as they are sent."""
    if model is None:
        return None
    at = np.flatnonzero(model[0])
    return at.astype(np.int32), model[0][at], model[1]


def _dense(sent, bits: int) -> tuple[np.ndarray, float]:
    weights = np.zeros(1 << bits, np.float32)
    weights[sent[0]] = sent[1]
    return weights, sent[2]


def score_toxicity(documents: DataFrame, model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted for every row of documents."""
    sent, s = documents.sparkSession.sparkContext.broadcast(sparse(model)), settings
    ship_package(documents.sparkSession)

    def scored(batches):
        if sent.value is not None:
            weights, bias = _dense(sent.value, s.bits)
        for batch in batches:
            score = score_texts(batch.column(1), weights, bias, s.bits) if sent.value is not None else np.zeros(batch.num_rows)
            predicted = score >= s.threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(predicted.astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def keep_clean(documents: DataFrame, model, settings: Settings = Settings()) -> DataFrame:
    """documents, all columns, without the rows that the model rejects; nothing is shuffled."""
    sent, s = documents.sparkSession.sparkContext.broadcast(sparse(model)), settings
    ship_package(documents.sparkSession)
    text_at = documents.columns.index("text")

    def kept(batches):
        if sent.value is not None:
            weights, bias = _dense(sent.value, s.bits)
        for batch in batches:
            if sent.value is not None:
                batch = batch.filter(pa.array(score_texts(batch.column(text_at), weights, bias, s.bits) < s.threshold))
            yield batch

    return documents.mapInArrow(kept, documents.schema)
