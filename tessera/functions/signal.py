"""Sound as arrays of samples, and long sentences: what needs a loop, in Arrow batches. Null and empty signals are silent."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

#: Samples a second; a frame's length; what makes a frame voiced: loudness, peak, share of changes of sign; least voiced frames and share. Fixed values.
RATE, FRAME_MS, LEAST_RMS, LEAST_PEAK, CHANGES, LEAST_FRAMES, LEAST_SHARE = 16_000, 30, 0.007, 0.025, (0.003, 0.35), 3, 0.08
#: Samples of at least this are sound; seconds kept around it. Fixed values.
EDGE, PAD = 0.006, 0.12
#: Where a sentence may be parted. Fixed value.
CLAUSE = re.compile(r";\s+|,\s+(?:and|but|which|or)\s+", re.IGNORECASE)


def are_voiced(signals: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Whether enough whole frames are like speech, of each row."""
    size = int(rate * FRAME_MS / 1000)
    n = signals.shape[1] // size if size >= 2 else 0
    if not n:
        return np.zeros(len(signals), bool)
    frames = signals[:, : n * size].reshape(len(signals), n, size)
    below = np.signbit(frames)
    changes = (below[:, :, 1:] != below[:, :, :-1]).mean(2)
    good = (np.sqrt((frames * frames).mean(2)) >= LEAST_RMS) & (np.abs(frames).max(2) >= LEAST_PEAK) & (changes >= CHANGES[0]) & (changes <= CHANGES[1])
    return (good.sum(1) >= LEAST_FRAMES) & (good.mean(1) >= LEAST_SHARE)


def is_voiced(samples, rate: int = RATE) -> bool:
    own = np.asarray([] if samples is None else samples, np.float64)
    return bool(are_voiced(own[None, :], rate)[0])


def sound(signals: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Where the sound of each row begins and ends, with a margin; nothing of a silent signal."""
    loud, n, pad = np.abs(signals) >= EDGE, signals.shape[1], int(PAD * rate)
    if not n:
        return np.zeros(len(signals), np.int64), np.zeros(len(signals), np.int64)
    some = loud.any(1)
    first, last = loud.argmax(1), n - 1 - loud[:, ::-1].argmax(1)
    return np.where(some, np.maximum(0, first - pad), 0), np.where(some, np.minimum(n, last + pad + 1), 0)


def without_silence(samples, rate: int = RATE) -> np.ndarray:
    """Without the silent ends, but for a margin."""
    own = np.asarray([] if samples is None else samples, np.float64)
    lo, hi = sound(own[None, :], rate)
    return own[lo[0] : hi[0]]


def clauses(sentence: str, most: int) -> list[str]:
    """Parts of at most ``most`` tokens, as far as they can be had: parted at the clause nearest the middle, or, where there is none and it is over 1.2 times too long, at the middle word."""
    done, todo = [], [sentence]
    while todo:
        own = todo.pop()
        words = own.split()
        ends = [m.start() for m in CLAUSE.finditer(own)] if len(words) > most else []
        cut = None
        if ends:
            cut = 1 + min(ends, key=lambda at: abs(at - len(own) / 2))
        elif len(words) > max(most, int(most * 1.2)):
            cut = len(" ".join(words[: len(words) // 2]))
        left, right = (own[:cut].strip(), own[cut:].strip()) if cut else ("", "")
        if left and right:
            todo += [right, left]
        else:
            done.append(own)
    return done


#: Signals that are compared at once.
TOGETHER = 256


def _signals(samples: pa.Array):
    """(first row, one signal a row) of rows of one length that follow one another; a null signal is empty. Samples that are null are not numbers."""
    sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(sizes):
        other = np.flatnonzero(sizes[lo : lo + TOGETHER] != sizes[lo])
        n = int(other[0]) if len(other) else min(TOGETHER, len(sizes) - lo)
        yield lo, samples.slice(lo, n).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, int(sizes[lo]))
        lo += n


@F.arrow_udf(BooleanType())
def voiced(samples: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, bool), *(are_voiced(own) for _, own in _signals(samples))]))


@F.arrow_udf(ArrayType(DoubleType()))
def trimmed(samples: pa.Array) -> pa.Array:
    sizes, parts = [np.zeros(1, np.int64)], [np.zeros(0)]
    for _, own in _signals(samples):
        lo, hi = sound(own)
        sizes.append(hi - lo)
        at = np.arange(own.shape[1])
        parts.append(own[(at >= lo[:, None]) & (at < hi[:, None])])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(parts)))


def split_clauses(most: int):
    """A function of a column of sentences."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(sentence: pd.Series) -> pd.Series:
        return pd.Series([clauses(s, most) if s else [] for s in sentence], dtype=object)

    return split
