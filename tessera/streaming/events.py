"""Streams: windows with a watermark, slices of a table read as micro-batches, and results kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.session import fresh_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of the events table; its timestamps become ones with a zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums by day and type; works on a stream (late rows beyond the watermark are dropped) and on a table alike."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


#: Groups that streams are dealt to. It holds as long as a query's state does.
BUCKETS = 1024


def bucketed(rows: DataFrame, key: str, *columns: str) -> GroupedData:
    """rows as (bucket, of, columns) by bucket, ``of`` the key as text: a call to Python and to its state costs far more than the few rows that one stream has in a micro-batch."""
    return rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(key).cast("string").alias("of"), *columns).groupBy("bucket")


def sliced(rows: DataFrame, slice_of, slices: int, key: str, files: int | None = None) -> DataFrame:
    """rows as a stream of about so many micro-batches: slice 0 first. Of one key a slice's rows come together. slice_of: a Column of 0 to slices - 1. files: of a slice; else one for each core. rows are worked out once."""
    spark = rows.sparkSession
    folder, files = fresh_folder(spark, "slices"), files or max(2, spark.sparkContext.defaultParallelism)
    rows.withColumn("__slice", slice_of.cast("int")).write.partitionBy("__slice").parquet(f"{folder}/all")
    held = spark.read.schema(StructType([*rows.schema, StructField("__slice", IntegerType())])).parquet(f"{folder}/all")
    # files are streamed in the order of their times
    for i in range(slices):
        held.where(F.col("__slice") == i).drop("__slice").repartition(files, key).write.parquet(f"{folder}/slices/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/slices")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table, written by each micro-batch into the shared folder: as a whole (complete), or each batch beside the others (append)."""
    spark = stream.sparkSession
    folder = fresh_folder(spark, name)
    to = (lambda n: f"{folder}/rows") if mode == "complete" else (lambda n: f"{folder}/rows/batch={n}")
    # state that processors keep needs this store; a query takes the setting when it starts
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(to(n))).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
