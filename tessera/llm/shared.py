"""Tables in the shared folder, and the byte-level text kernels that several operators use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and all runs on this machine, one of our own (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written by one run of an operator into the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.root = spark, f"{shared_folder(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once, and return a reader of what was written: lineage is cut and survives lost executors."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Delete all tables of this run except those that a result still reads."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if system.exists(root):
            for entry in system.listStatus(root):
                if entry.getPath().getName() not in names:
                    system.delete(entry.getPath(), True)


#: Bits of a bitmap of ids: 16 for each, between these; 32 MB at most go to every worker.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def perhaps(rows: DataFrame, wanted: DataFrame, key: str, split: bool = False):
    """rows without most of those whose key is not among wanted's (which has that column): a broadcast bitmap of hashed keys spares them the shuffle of the join that follows. split: a pair, those that may be wanted and those that surely are not (null keys too)."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__map"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col("__bucket"), "left" if split else "inner")
    maybe = joined.where(has).select(*rows.columns)
    return (maybe, joined.where(~has).select(*rows.columns)) if split else maybe


# --- bytes of a column -----------------------------------------------------

_rng = np.random.default_rng(20240229)
RANDOM_OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int):
    """Ranges of rows with at most so many bytes together, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _BASE)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return POWERS if n <= len(POWERS) else np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)


class Words:
    """The words of some rows: byte ranges, the row of each, and a 64-bit hash of its folded bytes."""

    __slots__ = ("ends", "first", "hash", "row", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = ASCII_SPACE, fold: np.ndarray = FOLD, hashed: bool = True, also: np.ndarray | None = None):
        """apart: which bytes stand between words. also: places (over 0) where words are cut besides. first: for each row its first word, and the number of words at the end."""
        n, rows = len(data), len(offsets) - 1
        inside = ~apart[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            before[cuts], after[cuts - 1] = False, False
            if also is not None:
                before[also], after[also - 1] = False, False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, offsets, side="left") if rows else np.zeros(1, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if hashed and len(self.starts):
            lengths = self.ends - self.starts
            at = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
            terms = RANDOM_OF_BYTE[fold][data[inside]] * _powers(int(lengths.max()))[place]
            self.hash = mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)


def shingles(words: Words, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct k-word shingles and the bounds of each row; a row of fewer words has one of all of them, a row of none has none."""
    first, h = words.first, words.hash
    count = np.diff(first)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    spans = np.maximum(len(h) - k + 1, 0)
    whole = np.zeros(spans, np.uint64)
    for j in range(k):
        whole = whole * _BASE + h[j : j + spans]
    own = (words.row[:spans] == words.row[k - 1 : k - 1 + spans]) if spans else np.zeros(0, bool)
    value, owner = mix(whole[own] + np.uint64(k)), words.row[:spans][own]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            sums[has] = sums[has] * _BASE + h[first[short[has]] + j]
        value, owner = np.concatenate([value, mix(sums + count[short].astype(np.uint64))]), np.concatenate([owner, short])
    # distinct within a row: sort by value, then stably by row
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(rows + 1))
