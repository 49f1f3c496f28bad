"""Mentions of persons and places, the registry built from them, and what is done to a source as a whole.

Defined cases, for all: null or blank keys make a mention invalid, and it is dropped; empty tables give
empty tables; ties go to the lesser key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.folds import walk
from tessera.operators import tables as M


def _given(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""


def coerce(mentions: DataFrame, required: list[str], numbers: list[str], optional: list[str] = (), counts: list[str] = ()) -> DataFrame:
    """Texts trimmed; rows without a required text or a readable number go; optional numbers that do not read become null; counts are at least 1."""
    out = mentions
    for c, kind in mentions.dtypes:
        if kind == "string" and c not in (*numbers, *optional, *counts):
            out = out.withColumn(c, F.trim(c))
    for c in (*numbers, *optional):
        out = out.withColumn(c, F.col(c).try_cast("double"))
    for c in counts:
        out = out.withColumn(c, F.greatest(F.lit(1), F.coalesce(F.col(c).try_cast("int"), F.lit(1))))
    for c in required:
        out = out.where(_given(c))
    for c in numbers:
        out = out.where(F.col(c).isNotNull())
    return out


def upsert_mentions(existing: DataFrame, new: DataFrame, key: str, required: list[str], numbers: list[str], optional: list[str] = (), counts: list[str] = ()) -> DataFrame:
    """Coerced rows of new replace those of equal key."""
    return M.upsert(existing, coerce(new, [key, *required], numbers, optional, counts), [key])


def people_page(mentions: DataFrame, *, canonical: str | None = None, **wanted) -> DataFrame:
    """A page of person mentions; a canonical name that is blank matches nothing."""
    if canonical is not None:
        mentions = mentions.where(F.col("canonical_name") == canonical.strip() if canonical.strip() else F.lit(False))
    return M.mentions(mentions, **wanted)


def merge_canonical(mentions: DataFrame, source: str, target: str) -> DataFrame:
    """Mentions of one canonical name given another, with ``rewritten``; nothing is rewritten where either is blank or both are equal."""
    hit = F.lit(False) if not source.strip() or not target.strip() or source == target else F.coalesce(F.col("canonical_name") == source, F.lit(False))
    return mentions.withColumn("rewritten", hit).withColumn("canonical_name", F.when(hit, target).otherwise(F.col("canonical_name")))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], value) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Every table without the rows of a source, and the errors of those that lack their column: one table's failure does not keep the others."""
    kept, errors = {}, {}
    for name, (df, column) in tables.items():
        if column not in df.columns:
            errors[name] = f"no column {column}"
            continue
        kept[name] = M.delete(df, F.col(column) == value)
    return kept, errors


def append_children(existing: DataFrame, children: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Children with their vectors after the existing rows; raises if some have none, or the reverse."""
    apart = children.select(key).join(vectors.select(key), key, "left_anti").unionAll(vectors.select(key).join(children.select(key), key, "left_anti"))
    if not apart.isEmpty():
        raise ValueError("each child needs one vector, each vector one child")
    return existing.unionByName(children.join(vectors, key), allowMissingColumns=True)


def registry(mentions: DataFrame) -> DataFrame:
    """canonical_name, mention_count, sources (sorted), variants (name -> count, sorted by name), display: the best name among the canonical one and its variants."""
    own = mentions.where(_given("canonical_name") & _given("raw_name"))
    variants = own.groupBy("canonical_name", "raw_name").agg(F.count(F.lit(1)).alias("n"))
    best = lambda c: F.max(F.struct(names.display_rank(F.col(c)).alias("rank"), F.col(c).alias("name")))
    counted = variants.groupBy("canonical_name").agg(F.sum("n").alias("mention_count"), F.array_sort(F.collect_list(F.struct("raw_name", "n"))).alias("variants"), best("raw_name").alias("best"))
    sources = own.groupBy("canonical_name").agg(F.sort_array(F.collect_set("source_id")).alias("sources"))
    return counted.join(sources, "canonical_name").withColumn("display", names.better_display(F.col("canonical_name"), F.col("best.name"))).drop("best")


def surname_matches(queries: DataFrame, aliases: DataFrame, query: str, alias: str) -> DataFrame:
    """Equi-join of normal names by their last token: query, alias, and whether they are equal."""
    a = queries.select(F.col(query).alias("query"), names.last_token(F.col(query)).alias("__last")).where("__last <> ''").distinct()
    b = aliases.select(F.col(alias).alias("alias"), names.last_token(F.col(alias)).alias("__last")).distinct()
    return a.join(b, "__last").select("query", "alias", (F.col("query") == F.col("alias")).alias("same"))


def unique_winner(candidates: DataFrame, by: list[str], name: str, count: str) -> DataFrame:
    """The candidate ranked first by (count, tokens, characters); groups where several share that rank have none."""
    w = Window.partitionBy(*by).orderBy(F.desc(count), F.desc(names.display_rank(F.col(name))))
    first = candidates.withColumn("__k", F.rank().over(w)).where("__k = 1")
    return first.groupBy(*by).agg(F.min(name).alias("winner"), F.count(F.lit(1)).alias("__c")).where("__c = 1").drop("__c")


def best_of_overlaps(spans: DataFrame, by: list[str], lo: str, hi: str, score: str) -> DataFrame:
    """(by, lo, hi, score) of half-open spans within a group, taken in order: one that meets the span kept last replaces it where its score is higher, or equal and it is longer, else it goes; one that does not meet it is kept next to it. Spans are folded island by island, an island being what hangs together."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*by, lo, hi, score).withColumn("__new", F.when(before.isNull() | (F.col(lo) >= before), 1).otherwise(0))
    own = marked.withColumn("__island", F.sum("__new").over(w))
    span = lambda a, b, c: F.struct(a.alias("lo"), b.alias("hi"), c.alias("score"))
    kinds = dict(spans.dtypes)
    kind = f"struct<lo:{kinds[lo]},hi:{kinds[hi]},score:{kinds[score]}>"
    islands = own.groupBy(*by, "__island").agg(F.array_sort(F.collect_list(span(F.col(lo), F.col(hi), F.col(score)))).alias("own"))
    none = F.lit(None).cast(kind)

    def step(kept, x):
        apart = kept.isNull() | x.isNull() | (x["lo"] >= kept["hi"])
        better = (x["score"] > kept["score"]) | ((x["score"] == kept["score"]) & (x["hi"] - x["lo"] > kept["hi"] - kept["lo"]))
        return F.when(apart | better, x).otherwise(kept), F.when(apart & kept.isNotNull(), F.array(kept)).otherwise(F.array().cast(f"array<{kind}>"))

    picked = walk(F.concat("own", F.array(none)), none, step, kind)
    return islands.select(*by, F.explode(picked).alias("x")).select(*by, F.col("x.lo").alias(lo), F.col("x.hi").alias(hi), F.col("x.score").alias(score))


def citation_groups(citations: DataFrame) -> DataFrame:
    """Of (source_id, number, page): one row a source with its distinct pages and citation numbers, sorted, in the order of the least number."""
    return citations.groupBy("source_id").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.sort_array(F.collect_list("number")).alias("numbers"), F.min("number").alias("first"))


def final_dedup(ranked: DataFrame, query_key: str, child: str, parent: str, k: int, m: int) -> DataFrame:
    """In rank order: each child once, at most m of a parent (those without one are free), the first k."""
    once = ranked.withColumn("__c", F.row_number().over(Window.partitionBy(query_key, child).orderBy("rank"))).where("__c = 1")
    once = once.withColumn("__p", F.row_number().over(Window.partitionBy(query_key, parent).orderBy("rank"))).where(F.col(parent).isNull() | (F.col("__p") <= m))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(query_key).orderBy("rank"))).where(F.col("place") <= k).drop("__c", "__p")


def backfill(ranked: DataFrame, query_key: str, source: str, above: Column, tokens: Column, budget: int, floor: float, ceiling: float, most: int) -> DataFrame:
    """Rows above the threshold; where these use under floor * budget tokens, rejected rows in rank order too, marked below_threshold: only of sources with a row above (of all, if there are none), at most ``most``, and up to the first with which the total would pass ceiling * budget."""
    w, run = Window.partitionBy(query_key), Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = ranked.withColumn("tokens", tokens).withColumn("__above", above)
    own = own.withColumn("__used", F.sum(F.when(F.col("__above"), F.col("tokens")).otherwise(0)).over(w)).withColumn("__any", F.max(F.col("__above").cast("int")).over(w))
    own = own.withColumn("__hit", F.max(F.col("__above").cast("int")).over(Window.partitionBy(query_key, source)))
    free = ~F.col("__above") & ((F.col("__any") == 0) | ((F.col("__hit") == 1) & F.col(source).isNotNull()))
    own = own.withColumn("__n", F.sum(free.cast("int")).over(run)).withColumn("__total", F.col("__used") + F.sum(F.when(free, F.col("tokens")).otherwise(0)).over(run))
    more = free & (F.col("__used") < int(budget * floor)) & (F.col("__n") <= most) & (F.col("__total") <= int(budget * ceiling))
    return own.where(F.col("__above") | more).withColumn("below_threshold", ~F.col("__above")).drop("__above", "__used", "__any", "__hit", "__n", "__total")


def footnotes(marks: DataFrame, by: list[str], number: str, place: str) -> DataFrame:
    """New numbers of citation marks, from 1 by first appearance."""
    first = marks.groupBy(*by, number).agg(F.min(place).alias("first"))
    return first.withColumn("footnote", F.row_number().over(Window.partitionBy(*by).orderBy("first")))


def latency(spans: DataFrame, by: list[str], wall: str) -> DataFrame:
    """Of (name, ms) and a wall time: accounted, unaccounted, and the slowest span."""
    return spans.groupBy(*by).agg(F.sum("ms").alias("accounted"), F.max(wall).alias("wall"), (F.max(wall) - F.sum("ms")).alias("unaccounted"), F.max_by("name", F.struct("ms", "name")).alias("slowest"))


def value_quantile(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """sorted[floor(share * n)] of each group, from counts of distinct values: groups of many rows are counted before they meet."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by)
    run = counted.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    return run.where(F.col("__upto") > F.floor(F.col("__all") * share)).groupBy(*by).agg(F.min(value).alias("quantile"))
