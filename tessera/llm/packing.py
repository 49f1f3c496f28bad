"""Packing: order-preserving dynamic programming over window cuts.

The token streams of a partition's documents, in their order, are cut into sequences of at most
``capacity`` tokens. Cuts lie at document ends (free), sentence ends (a truncation penalty) or, in
stretches without either, at a fixed grid (a larger penalty). The cuts minimise padding + penalties
+ a cost per sequence: f(j) = pen(j) + min over windows of f(i) + pad(j - i). As padding falls
linearly with length, that minimum is one of a sliding window, kept by a monotone queue; lengths
that are powers of two need no padding and are separate transitions.

No shuffle: each input partition is packed by itself, in segments of bounded size, so sequences
never mix partitions, and what is held does not grow with the partition. A task that is run again
gives the same pieces and the same sequence ids.

Tokens: the vocabulary's pre-tokenizer never joins what ASCII white space parts, nor an ASCII letter
and an ASCII sign or digit next to it (apostrophes and the signs of special tokens set aside). Each
piece between such places is encoded once by the tokenizer, then looked up by its 64-bit hash.

Defined cases: null text is empty; an empty text is the closing id alone; repeated rows are each
packed; an empty table gives no rows; other columns are not read.

A very long text's tokens are held by one task and cut into as many pieces as it takes.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

from .shared import ASCII_SPACE, FOLD, Words, buffers, runs

SLICE = 1 << 20
#: Words whose ids a worker keeps; beyond it forgets all and begins anew.
KEPT_WORDS = 1_000_000
_AS_IS = np.arange(256, dtype=np.uint8)
#: 1: ASCII letters; 2: ASCII signs and digits that part from them; 0: bytes next to which nothing is cut.
_SIDE = np.zeros(256, np.uint8)
_SIDE[33:127] = 2
_SIDE[[*range(65, 91), *range(97, 123)]] = 1
_SIDE[list(b"'<|>")] = 0
#: What a tokenizer must encode as its words one by one; others are refused.
_PROBES = ("Hello, World! It's (a) new_day: 1,234.50 x=y;z", "The  quick\tBROWN\n\nfox... jumps/over; don't \"QUOTE\" e-mail@x.org", " leading ÜBER naïve Straße #1 50% [A] {b} ~c^d* ", "a.b,c!d?e:f;g(h)i[j]k{l}m+n-o*p=q&r$s@t")


@dataclass(frozen=True)
class Settings:
    tokenizer: str = "word_bpe_49k.json"
    capacity: int = 4096
    closing: int = 2
    sentence_penalty: int = 24
    forced_penalty: int = 512
    sequence_cost: int = 64
    grid: int = 512
    segment: int = 1 << 20


def tokenizer_path(name: str) -> str:
    """A path as it is, or the name of a public tokenizer file."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts by a tokenizer, word by word and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            if token.endswith("</w>") and token[:-4] and set(token[:-4]) <= set(".!?\"')") and set(token[:-4]) & set(".!?"):
                self.sentence_end[i] = True
        self._forget()
        same = all(self.tokenizer.encode(w, add_special_tokens=False).ids == self.tokenizer.encode(w.lower(), add_special_tokens=False).ids for w in _PROBES)
        self.fold = FOLD if same else _AS_IS
        for probe in _PROBES:
            ids, _ = self.encode(np.frombuffer(probe.encode(), np.uint8), np.array([0, len(probe.encode())]))
            if ids.tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{path} does not encode texts word by word, parted at white space and between letters and signs")

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(words) > KEPT_WORDS and len(self.keys):
            self._forget()
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        at = self.used + np.cumsum(size) - size
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * (len(self.pool) + total) - self.used, np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.int32, total)
        self.used += total
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, hashes), (self.at, at), (self.size, size)))

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.searchsorted(self.keys, hashes)
        where[where == len(self.keys)] = 0
        return where, (self.keys[where] == hashes) if len(self.keys) else np.zeros(len(hashes), bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each row."""
        side = _SIDE[data]
        raw = data.tobytes()
        # the tokenizer levels case, but for its special tokens
        words = Words(data, offsets, ASCII_SPACE, _AS_IS if b"<|" in raw else self.fold, also=np.flatnonzero((side[1:] ^ side[:-1]) == 3) + 1)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        distinct, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        where, known = self._known(distinct)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > KEPT_WORDS:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self._learn(distinct[new], [raw[words.starts[i] : words.ends[i]].decode("utf-8") for i in first[new]])
            where, _ = self._known(distinct)
        size, at = self.size[where][which], self.at[where][which]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        return ids, np.bincount(words.row, size, len(offsets) - 1).astype(np.int64)


def long_rows(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Finer offsets, where rows over ``most`` bytes are cut after white space, and the row of each part."""
    if not len(offsets) or np.diff(offsets).max(initial=0) <= most:
        return offsets, np.arange(len(offsets) - 1)
    cuts, rows = [], []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while hi - lo > most:
            gap = np.flatnonzero(ASCII_SPACE[data[lo : lo + most]])
            step = int(gap[-1]) + 1 if len(gap) else 0
            if not step:
                gap = np.flatnonzero(ASCII_SPACE[data[lo + most : hi]])
                if not len(gap):
                    break
                step = most + int(gap[0]) + 1
            cuts.append(lo)
            rows.append(i)
            lo += step
        cuts.append(lo)
        rows.append(i)
    return np.array([*cuts, offsets[-1]], np.int64), np.array(rows, np.int64)


def best_cuts(bounds: np.ndarray, penalty: np.ndarray, s: Settings) -> np.ndarray:
    """Indices into bounds (from 0, rising, steps of at most capacity) of the cheapest cuts, the first and last among them."""
    n, capacity = len(bounds), s.capacity
    powers: dict[int, list[int]] = {}
    for p in range(capacity.bit_length()):
        if 1 << p < capacity:
            i = np.searchsorted(bounds, bounds - (1 << p))
            for j in np.flatnonzero(bounds[np.minimum(i, n - 1)] == bounds - (1 << p)).tolist():
                powers.setdefault(j, []).append(int(i[j]))
    b, pen = bounds.tolist(), penalty.tolist()
    f, back, queue = [0.0] * n, [0] * n, deque()
    g = [0.0] * n
    g[0] = b[0]
    queue.append(0)
    for j in range(1, n):
        least = b[j] - capacity
        while b[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        cost, frm = g[i] + capacity - b[j], i
        if j in powers:
            for i in powers[j]:
                if f[i] < cost:
                    cost, frm = f[i], i
        f[j], back[j] = cost + pen[j] + s.sequence_cost, frm
        g[j] = f[j] + b[j]
        while queue and g[queue[-1]] >= g[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return np.array(cuts[::-1])


class Packer:
    """Takes documents' tokens one after another, and gives pieces whenever a segment is full."""

    def __init__(self, s: Settings, sentence_end: np.ndarray, base: int):
        self.s, self.ends, self.sequence = s, sentence_end, base
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, first token in the segment (under 0 if begun earlier), tokens
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, self.held, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        if not self.held:
            return out
        s, ids = self.s, np.concatenate(self.ids) if len(self.ids) > 1 else self.ids[0]
        n = len(ids)
        begins, sizes = np.array([d[1] for d in self.docs]), np.array([d[2] for d in self.docs])
        stops = begins + sizes
        price = np.full(n + 1, -1, np.int64)
        price[np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1] = s.sentence_penalty
        price[0] = 0
        price[stops[stops <= n]] = 0
        at = np.flatnonzero(price >= 0)
        wide = np.flatnonzero(np.diff(np.append(at, n)) > s.capacity)
        for i in wide.tolist():
            grid = np.arange(at[i] + s.grid, at[i + 1] if i + 1 < len(at) else n, s.grid)
            price[grid] = s.forced_penalty
        if len(wide):
            at = np.flatnonzero(price >= 0)
        cuts = at[best_cuts(at, price[at], s)]
        if not last and len(cuts) > 3:
            cuts = cuts[:-2]  # the last windows may change with what follows
        done = int(cuts[-1])
        marks = np.unique(np.concatenate([cuts, begins[(begins > 0) & (begins < done)]]))
        lo, hi = marks[:-1], marks[1:]
        doc, window = np.searchsorted(begins, lo, side="right") - 1, np.searchsorted(cuts, lo, side="right") - 1
        raw = memoryview(ids.astype("<u4").tobytes())
        out["doc_id"] = [self.docs[i][0] for i in doc.tolist()]
        out["start"], out["length"], out["doc_tokens"] = lo - begins[doc], hi - lo, sizes[doc]
        out["ids_crc32"] = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist())]
        out["sequence_id"], out["offset"] = self.sequence + window, lo - cuts[window]
        self.sequence += len(cuts) - 1
        self.docs = [(d, b - done, k) for d, b, k in self.docs if b + k > done]
        self.ids = [ids[done:]] if done < n else []
        self.held = n - done
        return out


_ENCODERS: dict[str, Encoder] = {}


def pack(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship_package(documents.sparkSession)
    s, path = settings, tokenizer_path(settings.tokenizer)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def packed(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder, schema = _ENCODERS[path], None
        packer = Packer(s, encoder.sentence_end, TaskContext.get().partitionId() << 40)

        def rows(last):
            got = packer.flush(last)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got.values(), schema.types)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), *((k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
            names = batch.column(0).to_pylist()
            data, offsets = buffers(batch.column(1))
            for lo, hi in runs(offsets, SLICE):
                fine, part = long_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SLICE)
                own: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
                for a, b in runs(fine, SLICE):
                    ids, size = encoder.encode(data[offsets[lo] + fine[a] : offsets[lo] + fine[b]], fine[a : b + 1] - fine[a])
                    stop = np.cumsum(size)
                    for row, x, y in zip(part[a:b].tolist(), (stop - size).tolist(), stop.tolist()):
                        own[row].append(ids[x:y])
                for i, parts in enumerate(own):
                    packer.add(names[lo + i], np.concatenate([*parts, np.array([s.closing], np.int32)]))
                    if packer.held >= s.segment:
                        yield rows(False)
        if schema is not None:
            yield rows(True)

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(packed, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
