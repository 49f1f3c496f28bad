"""Tables as immutable versions: each change is a new DataFrame, written and swapped in by ``publish``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of equal keys; columns that one side lacks are null."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Fields given in changes (not null; an empty string counts as given) overwrite; keys that are new are added."""
    others = [c for c in existing.columns if c not in keys]
    given = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in others if c in changes.columns))
    return existing.join(given, keys, "full_outer").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in others))


def delete(existing: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def migrate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that are missing, as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids."""
    return df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def inventory(details: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """All sources: those with details, and those found without; has_details and has_chunks say which."""
    a, b = details.withColumn("has_details", F.lit(True)), found.select(key).distinct().withColumn("has_chunks", F.lit(True))
    return a.join(b, key, "full_outer").fillna(False, ["has_details", "has_chunks"])


def any_of(column: Column, values: list) -> Column:
    """IN, where an empty list matches nothing."""
    return column.isin(values) if values else F.lit(False)


def contains_ci(column: Column, value: str) -> Column:
    """Contains the text, whatever the case; no sign is a wildcard."""
    return F.contains(F.lower(column), F.lit(value.lower()))


def positive_int(column: Column) -> Column:
    """The whole number of at least 1 that a value reads as, else null."""
    n = column.try_cast("int")
    return F.when(n >= 1, n)


def mentions(df: DataFrame, *, sources: list | None = None, source_col: str = "source_id", min_confidence: float = 0.0, confidence_col: str = "confidence", text: str | None = None, text_cols: list[str] = (), order: list = (), limit: int = 1000, offset: int = 0) -> DataFrame:
    """A filtered page of a mention table; filters reach the scan before the page is cut."""
    if not 0 <= min_confidence <= 1 or limit < 1 or offset < 0:
        raise ValueError("confidence lies in [0, 1], limit is at least 1, offset at least 0")
    out = df.where(F.col(confidence_col) >= min_confidence)
    if sources is not None:
        out = out.where(any_of(F.col(source_col), sources))
    if text:
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | contains_ci(F.col(c), text)
        out = out.where(hit)
    return out.orderBy(*order).offset(offset).limit(limit)


def publish(spark: SparkSession, df: DataFrame, path: str, version: int) -> str:
    """Writes a version beside the others, then points ``_current`` at it: readers see the old or the new table, never a part."""
    target = f"{path}/v{version:08d}"
    df.write.mode("error").parquet(target)
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/_current.json")
    return target


def current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.json(f"{path}/_current.json").first()["version"]
    return spark.read.parquet(f"{path}/v{version:08d}")


def or_default(column: Column, default) -> Column:
    """The value, or the default where it is null or 0."""
    return F.coalesce(F.nullif(column, F.lit(0)), F.lit(default))


def escaped(text: Column) -> Column:
    """As it stands within quotes of an SQL literal; only for texts that leave the engine, conditions are Columns."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def clean_metadata(metadata: Column) -> Column:
    """A map without keys whose value is null or empty."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))


def is_share(column: Column) -> Column:
    """Lies in [0, 1]; null does not."""
    return F.coalesce(column.between(0, 1), F.lit(False))


def chat_text(content: Column, parts: Column) -> Column:
    """The content, or else the texts of the text parts, joined by blanks."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.coalesce(content, F.array_join(texts, " "))


def of_each(rows: DataFrame, by: list[str], worked_out) -> DataFrame:
    """rows with what is worked out of some of their columns, of equal values once: worked_out is a function of the table of these values, without repeats, that adds columns. Nulls are equal."""
    found = worked_out(rows.select(*by).distinct())
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by))
    return rows.alias("r").join(found.alias("f"), same).select("r.*", *(f"f.{c}" for c in found.columns if c not in by))
