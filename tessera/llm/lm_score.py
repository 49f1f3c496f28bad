"""LM scoring: pseudo-likelihood under a masked, bidirectional window network, trained in numpy.

Each word is predicted from the words on both sides (two each). A word's probability is that of its
class under the network times that of the word within its class: the most frequent hash buckets are
classes of their own, all others share classes by hash, and the share within a class comes from
counts over all documents. A document's score is the sum of its words' conditional
log-probabilities.

Counts: every document's words, by bucket; partitions send their counts, which are summed by key.
Training: in every round each partition starts from the shared parameters and goes once through all
its documents with Adagrad, at masked positions: every ``stride``-th, from an offset that differs by
document (a hash of its words) and round, so that ``stride`` rounds mask each word exactly once.
Parameters are then averaged by words seen, summed in a fixed number of tasks. Which words are masked
does not depend on how documents lie in files, but what is averaged does: scores of two layouts of the
same rows differ slightly. Nothing that reaches the driver grows with the number of documents.

Defined cases: a null or empty text has n_tokens 0 and scores 0; words next to an end of a document
see a padding class there; classes that no word falls into keep a share of half a word; repeated rows
count and are scored each; an empty table gives no rows; a table without words leaves the parameters as they began; other columns are not read.

A very long text is scored whole, in the memory of one task; each row is scored by itself, so no
ties arise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import Scratch, Words, buffers, runs

SLICE = 1 << 20
#: Words whose class probabilities are computed at once.
CHUNK = 4096


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    own_classes: int = 192
    shared_classes: int = 64
    width: int = 16
    window: int = 2
    stride: int = 6
    rounds: int = 6
    rate: float = 0.15
    seed: int = 11
    sum_tasks: int = 8

    @property
    def classes(self) -> int:
        return self.own_classes + self.shared_classes


def _buckets(words: Words, s: Settings) -> np.ndarray:
    return (words.hash >> np.uint64(64 - s.bits)).astype(np.int64)


def _counted(batches, s: Settings):
    total = np.zeros(1 << s.bits, np.int64)
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for lo, hi in runs(offsets, SLICE):
            total += np.bincount(_buckets(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), s), minlength=1 << s.bits)
    at = np.flatnonzero(total)
    for lo in range(0, len(at), 10_000):
        part = at[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])


def word_counts(documents: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Occurrences of each of the 2**bits buckets in all documents."""
    ship_package(documents.sparkSession)
    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _counted(b, s), "bucket int, n long")
    got = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << s.bits, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


@dataclass
class Model:
    """class_of and log_share by bucket; params: the network."""

    class_of: np.ndarray
    log_share: np.ndarray
    params: dict


def classes_from(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Class of each bucket, and the log of its share of the class."""
    class_of = (s.own_classes + np.arange(len(counts)) % s.shared_classes).astype(np.int16)
    order = np.lexsort((np.arange(len(counts)), -counts))[: s.own_classes]
    own = order[counts[order] > 0]
    class_of[own] = np.arange(len(own))
    smooth = counts + 0.5
    return class_of, (np.log(smooth) - np.log(np.bincount(class_of, smooth, s.classes)[class_of])).astype(np.float32)


def first_params(s: Settings) -> dict:
    rng, v = np.random.default_rng(s.seed), s.classes
    shape = {"sides": (2 * s.window, v + 1, s.width), "hidden": (s.width,), "out": (s.width, v), "bias": (v,)}
    return {k: (rng.normal(0, 0.1, x) if k in ("sides", "out") else np.zeros(x)).astype(np.float32) for k, x in shape.items()}


def _packed(params: dict) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def _unpacked(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _around(classes: np.ndarray, row: np.ndarray, at: np.ndarray, s: Settings) -> np.ndarray:
    """[len(at), 2 * window] classes of the words around positions; the padding class beyond a document's ends."""
    out = np.full((len(at), 2 * s.window), s.classes, np.int64)
    gaps = [g for g in range(-s.window, s.window + 1) if g]
    for i, gap in enumerate(gaps):
        other = np.clip(at + gap, 0, len(classes) - 1)
        same = (at + gap >= 0) & (at + gap < len(classes)) & (row[other] == row[at])
        out[same, i] = classes[other[same]]
    return out


def _hidden(p: dict, around: np.ndarray) -> np.ndarray:
    total = p["hidden"] + p["sides"][0][around[:, 0]]
    for i in range(1, around.shape[1]):
        total += p["sides"][i][around[:, i]]
    return np.tanh(total)


def _logits(p: dict, hidden: np.ndarray) -> np.ndarray:
    """In one array: copies of this size cost more than the sums."""
    out = hidden @ p["out"]
    out += p["bias"]
    return np.clip(out, -40, 40, out=out)


def log_class(p: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target class."""
    logits = _logits(p, _hidden(p, around))
    own = logits[np.arange(len(target)), target]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def _step(p: dict, past: dict, around: np.ndarray, target: np.ndarray, s: Settings) -> None:
    """One Adagrad step on the mean loss of some positions."""
    h, n = _hidden(p, around), len(target)
    e = _logits(p, h)
    np.exp(e, out=e)
    e /= e.sum(1, keepdims=True)
    e[np.arange(n), target] -= 1
    e /= n
    into = (e @ p["out"].T) * (1 - h * h)
    grads = {"out": h.T @ e, "bias": e.sum(0), "hidden": into.sum(0), "sides": np.zeros_like(p["sides"])}
    for i in range(around.shape[1]):
        flat = (around[:, i][:, None] * s.width + np.arange(s.width)).ravel()
        grads["sides"][i] = np.bincount(flat, into.ravel(), (s.classes + 1) * s.width).reshape(s.classes + 1, s.width)
    for k, g in grads.items():
        past[k] += g * g
        p[k] -= s.rate * g / (np.sqrt(past[k]) + 1e-7)


def _listed(batches, class_of: np.ndarray, s: Settings):
    """(start, classes) of each text that has words: where its masked words begin, by the sum of its hashes, and its words' classes as 16-bit numbers."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for lo, hi in runs(offsets, SLICE):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(words):
                continue
            offset = np.zeros(hi - lo, np.uint64)
            np.add.at(offset, words.row, words.hash)
            start = ((offset >> np.uint64(8)) % np.uint64(s.stride)).astype(np.int32)
            raw, ends = class_of[_buckets(words, s)].astype(np.int16).tobytes(), (2 * words.first).tolist()
            full = np.flatnonzero(np.diff(words.first))
            yield pa.RecordBatch.from_arrays([pa.array(start[full]), pa.array([raw[ends[i] : ends[i + 1]] for i in full.tolist()], pa.binary())], names=["start", "classes"])


def _together(batches, most: int):
    """(start of each text, its bounds, classes of all) for texts of some rows, of at most so many words together, or one."""
    for batch in batches:
        start, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes = np.array([len(x.as_buffer()) // 2 for x in raw], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        for lo, hi in runs(bounds, most):
            yield start[lo:hi], bounds[lo : hi + 1] - bounds[lo], np.concatenate([np.frombuffer(raw[i].as_buffer(), np.int16) for i in range(lo, hi)]).astype(np.int64)


def _trained(batches, start: np.ndarray, turn: int, s: Settings):
    """This partition's parameters times its words, and the words."""
    p = _unpacked(start, first_params(s))
    past = {k: np.zeros_like(v) for k, v in p.items()}
    seen = 0
    for begin, bounds, classes in _together(batches, SLICE):
        row = np.repeat(np.arange(len(begin)), np.diff(bounds))
        place = np.arange(len(classes)) - bounds[row]
        at = np.flatnonzero((place + begin[row] + turn) % s.stride == 0)
        for a in range(0, len(at), CHUNK):
            own = at[a : a + CHUNK]
            _step(p, past, _around(classes, row, own, s), classes[own], s)
        seen += len(classes)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % s.sum_tasks], pa.int32()), pa.array([seen], pa.int64()), pa.array([(_packed(p).astype(np.float64) * seen).tobytes()], pa.binary())], names=["slot", "words", "params"])


def _summed(batches):
    words, total = 0, None
    for batch in batches:
        for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words += n
            total = np.frombuffer(raw) + (0 if total is None else total)
    if words:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([words], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "words", "params"])


def train(documents: DataFrame, s: Settings = Settings()) -> Model:
    """Counts, classes and the network, from all documents."""
    spark = documents.sparkSession
    ship_package(spark)
    counts = word_counts(documents, s)
    model = Model(*classes_from(counts, s), first_params(s))
    shares = np.maximum(np.bincount(model.class_of, counts + 0.5, s.classes), 0.5)
    model.params["bias"] = np.log(shares / shares.sum()).astype(np.float32)
    # words are hashed once: every round reads their classes
    scratch, class_of = Scratch(spark, "lm"), spark.sparkContext.broadcast(model.class_of)
    texts = documents.select(F.col("text").cast("string").alias("text"))
    lists = scratch.save(texts.mapInArrow(lambda b: _listed(b, class_of.value, s), "start int, classes binary"), "lists")
    for turn in range(s.rounds):
        sent = spark.sparkContext.broadcast(_packed(model.params))
        parts = lists.mapInArrow(lambda b, sent=sent, turn=turn: _trained(b, sent.value, turn, s), "slot int, words long, params binary")
        got = parts.repartition(s.sum_tasks, "slot").mapInArrow(_summed, "slot int, words long, params binary").collect()
        if got:
            model.params = _unpacked(sum(np.frombuffer(r["params"]) for r in got) / sum(r["words"] for r in got), model.params)
    scratch.drop("lists")
    return model


def score(documents: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum), per_token (the mean, 0 without words)."""
    spark = documents.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        m = sent.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi in runs(offsets, SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if not len(words):
                    continue
                bucket = _buckets(words, s)
                classes, got = m.class_of[bucket].astype(np.int64), m.log_share[bucket].astype(np.float64)
                for a in range(0, len(words), CHUNK):
                    at = np.arange(a, min(a + CHUNK, len(words)))
                    got[at] += log_class(m.params, _around(classes, words.row, at, s), classes[at])
                total[lo:hi] = np.bincount(words.row, got, hi - lo)
                n[lo:hi] = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], names=["doc_id", "n_tokens", "log_prob", "per_token"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id {kind}, n_tokens long, log_prob double, per_token double")
