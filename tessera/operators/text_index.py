"""A stored text index: term lists of passages that are appended in batches, refreshed by a policy, and searched.

In the index's folder lie ``rows/append=N`` (the passages of each append), ``lists/append=N`` (their
term lists) and ``removed/append=N`` (keys removed then). What is written is whole or absent: a folder
counts once Spark has left its ``_SUCCESS`` there. Appends without lists are what is *dirty*; nothing
else is remembered, so an index survives any lost job, and an append that is repeated under its number
replaces itself.

Policies: ``immediate`` refreshes after every append, ``batch`` once so many rows wait, ``deferred``
not before someone searches. A search refreshes first in any case, and rebuilds once if stored lists
cannot be read.

Defined cases: of a key that is appended again the latest counts; within one append, repeated keys each
count; null texts have no terms, null keys are not indexed; an index without rows finds nothing.
"""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search as S

LISTS = "key long, size long, terms array<string>, counts array<int>, append long"
POLICIES = ("immediate", "batch", "deferred")


class TextIndex:
    """rows have a key (whole number), a text and what else is kept of them (``also``, for filters)."""

    def __init__(self, spark: SparkSession, root: str, *, policy: str = "immediate", batch: int = 32, key: str = "id", text: str = "text", also: tuple[str, ...] = ()):
        if policy not in POLICIES or batch < 1:
            raise ValueError(f"a policy is one of {', '.join(POLICIES)}, a batch at least 1 row")
        self.spark, self.root, self.policy, self.batch, self.key, self.text, self.also = spark, root.rstrip("/"), policy, batch, key, text, list(also)

    # --- what is there ----------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """The appends of a kind that are whole."""
        system, folder = self._system(), self._path(kind)
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("append=") and system.exists(self._path(kind, n, "_SUCCESS")))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/append={n}" for n in numbers))

    def pending(self) -> list[int]:
        return sorted(set(self._numbers("rows")) - set(self._numbers("lists")))

    def status(self) -> dict:
        waiting, done = self.pending(), self._numbers("lists")
        return {"policy": self.policy, "dirty": bool(waiting), "pending_rows": self._read("rows", waiting).count() if waiting else 0, "version": max(done, default=-1)}

    # --- changes ----------------------------------------------------------

    def append(self, rows: DataFrame, number: int | None = None) -> None:
        """Stores rows under a number (of a micro-batch; else the next), then refreshes if the policy says so."""
        n = max([-1, *self._numbers("rows")]) + 1 if number is None else number
        self._delete("lists", n)
        rows.select(self.key, self.text, *self.also).write.mode("overwrite").parquet(f"{self.root}/rows/append={n}")
        if self.policy == "immediate" or (self.policy == "batch" and self.status()["pending_rows"] >= self.batch):
            self.refresh()

    def remove(self, keys: DataFrame) -> None:
        """Passages of these keys, as appended so far, are found no more."""
        n = max([-1, *self._numbers("rows")])
        known = self._read("removed", [n]).select("key").unionByName(keys.select(F.col(self.key).cast("long").alias("key"))) if n in self._numbers("removed") else keys.select(F.col(self.key).cast("long").alias("key"))
        # what is read may not be what is overwritten
        known.distinct().write.mode("overwrite").parquet(f"{self.root}/removing")
        self.spark.read.parquet(f"{self.root}/removing").write.mode("overwrite").parquet(f"{self.root}/removed/append={n}")

    def refresh(self) -> None:
        """Lists of the appends that have none."""
        for n in self.pending():
            S.term_lists(self._read("rows", [n]), self.key, self.text, self.also).write.mode("overwrite").parquet(f"{self.root}/lists/append={n}")

    def rebuild(self) -> None:
        """All lists anew."""
        for n in self._numbers("rows"):
            self._delete("lists", n)
        self.refresh()

    def _delete(self, kind: str, n: int) -> None:
        self._system().delete(self._path(kind, f"append={n}"), True)

    # --- reading ----------------------------------------------------------

    def lists(self) -> DataFrame:
        """The term lists as of now: key, size, terms, counts, what else is kept, and the append."""
        done = self._numbers("lists")
        if not done:
            return self.spark.createDataFrame([], LISTS)
        lists = self._read("lists", done).where(F.col("key").isNotNull()).withColumn("append", F.col("append").cast("long"))
        if len(done) > 1:
            # keys alone are compared; lists are not shuffled for it unless some key was appended twice
            again = lists.select("key", "append").distinct().groupBy("key").agg(F.max("append").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "latest")
            if not again.isEmpty():
                lists = lists.join(again, "key", "left").where(F.col("latest").isNull() | (F.col("append") == F.col("latest"))).drop("latest")
        if gone := self._numbers("removed"):
            until = self._read("removed", gone).groupBy("key").agg(F.max("append").alias("until"))
            lists = lists.join(until, "key", "left").where(F.col("until").isNull() | (F.col("append") > F.col("until"))).drop("until")
        return lists

    def postings(self) -> DataFrame:
        """(key, size, term, tf)."""
        return self.lists().select("key", "size", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("key", "size", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))

    def search(self, queries: DataFrame, query_key: str, k: int, *, only: tuple[str, str] | None = None) -> DataFrame:
        """The first k passages of each query by BM25, over an index that is refreshed first; where stored lists cannot be read it is rebuilt, once."""
        self.refresh()
        try:
            return S.bm25_lists(self.lists(), queries, self.key, query_key, k, only=only)
        except (PySparkException, Py4JError):
            self.rebuild()
            return S.bm25_lists(self.lists(), queries, self.key, query_key, k, only=only)

    def sink(self, stream: DataFrame, checkpoint: str):
        """A stream of rows into the index: each micro-batch is an append under its own number, so one that is run again replaces itself."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.append(rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
