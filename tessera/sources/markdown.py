"""Markdown: sections by header, with the path of headers above each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = 6


def sections(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, section, path, body) of numbered lines. A section begins at its header line, which is part of it; before the first header it is "Document"."""
    w = Window.partitionBy(key).orderBy(order)
    mark = F.regexp_extract(line, r"^(#{1,6}) ", 1)
    own = lines.withColumn("level", F.nullif(F.length(mark), F.lit(0)))
    own = own.withColumn("section", F.sum(F.when(F.col("level").isNull(), 0).otherwise(1)).over(w))
    parts = own.groupBy(key, "section").agg(
        F.max("level").alias("level"), F.min_by(line, order).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t")))), lambda x: x["t"]), "\n").alias("body")
    )
    over = Window.partitionBy(key).orderBy("section")
    title = F.trim(F.regexp_replace("head", r"^#{1,6} ", ""))
    # the last header of each level, unless a higher one came after it
    seen = {i: F.last(F.when(F.col("level") == i, F.struct("section", title.alias("t"))), True).over(over) for i in range(1, LEVELS + 1)}
    named = parts.withColumns({f"h{i}": c for i, c in seen.items()})
    live = []
    for i in range(1, LEVELS + 1):
        above = [F.coalesce(F.col(f"h{j}.section"), F.lit(-1)) for j in range(1, i)]
        newest = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        live.append(F.when(F.col(f"h{i}.section") > newest, F.col(f"h{i}.t")))
    path = F.array_join(F.filter(F.array(*live), lambda x: x.isNotNull()), " > ")
    return named.select(key, "section", F.when(path == "", "Document").otherwise(path).alias("path"), "body")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, header path, body) of the Markdown files under a path, in any store that Spark reads."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    return sections(lines, "file", "i", "line")
