"""License scans by ordered signature rules, by DataFrame functions only.

A text becomes its words: A-Z lower-cased, runs of letters, digits and characters beyond ASCII, joined
by single blanks. ``license_rules`` has some 260 hand-written patterns over such words.

1. A rule is tried where its keyword occurs, one substring search for each keyword; its pattern is
   then one compiled search.
2. The rules that occur are located: a mark before each match, and the words that begin with it give
   the places, so the work grows with the text.
3. Of overlapping detections, one that lies within another of a stronger level, or within a longer one
   of its own level, or within an earlier rule's of the same extent, is suppressed. In the order of
   (start, longest first, level, rule) that is a comparison with the farthest end so far of each level.
4. ``score`` is the weight of the strongest detection left, by its level.

The phrases of ``BASE`` are rules too; their places count whether suppressed or not, and their labels
stay.

Defined cases: null text is empty; a text without words or detections has counts 0, null places, empty
labels and score 0; repeated rows are each scanned; an empty table gives no rows; matches of one rule do
not overlap (the leftmost goes first); of equal extents the stronger level, then the earlier rule, stays;
a very long text is one row's strings and arrays, and takes time in proportion to its length; other
columns are not read, or kept under ``row`` (``scan``).
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.folds import walk

from .license_rules import BASE, Rule, read_rules

#: Score of a detection by its level.
WEIGHTS = (1.0, 0.9, 0.7, 0.4)
LEVELS = len(WEIGHTS)
#: Stands before a match; no word has it.
MARK = "\x01"

_SPAN = "struct<start:int,end:int,level:int,rule:int>"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased and joined by single blanks."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def whole(pattern: str) -> str:
    """A rule's pattern between the ends of words."""
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def tried(words: Column, rules: list[Rule]) -> Column:
    """Numbers of the rules that occur, keyword by keyword."""
    groups = []
    numbered = sorted(enumerate(rules), key=lambda x: x[1].keyword)
    for keyword, own in groupby(numbered, key=lambda x: x[1].keyword):
        hits = F.array(*(F.when(words.rlike(whole(rule.pattern)), F.lit(n)) for n, rule in own))
        groups.append(F.when(words.contains(keyword), hits).otherwise(F.array().cast("array<int>")))
    return F.array_compact(F.concat(*groups))


def located(words: Column, hits: Column, rules: list[Rule]) -> Column:
    """All places of the rules that occur, as (start, end, level, rule), in words from 0, end exclusive."""
    patterns, levels = F.array(*(F.lit(whole(r.pattern)) for r in rules)), F.array(*(F.lit(r.level) for r in rules))

    def places(rule):
        pattern = F.element_at(patterns, rule + 1)
        marked = F.split(F.regexp_replace(words, pattern, F.lit(MARK + "$0")), " ")
        starts = F.array_compact(F.transform(marked, lambda word, at: F.when(word.startswith(MARK), at)))
        sizes = F.transform(F.regexp_extract_all(words, pattern, F.lit(0)), lambda match: F.size(F.split(match, " ")))
        return F.zip_with(starts, sizes, lambda start, size: F.struct(start.alias("start"), (start + size).alias("end"), F.element_at(levels, rule + 1).alias("level"), rule.alias("rule")))

    return F.flatten(F.transform(hits, places))


def unsuppressed(spans: Column) -> Column:
    """The spans that do not lie within a stronger one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["level"], s["rule"])))
    ends = F.array(*[F.lit(-1)] * LEVELS)

    def step(state, s):
        end = -s["back"]
        inside = F.array_max(F.slice(state, F.lit(1), s["level"])) >= end
        kept = F.when(inside, F.array().cast(f"array<{_SPAN}>")).otherwise(F.array(F.struct(s["start"].alias("start"), end.alias("end"), s["level"].alias("level"), s["rule"].alias("rule"))))
        return F.transform(state, lambda x, i: F.when(i == s["level"] - 1, F.greatest(x, end)).otherwise(x)), kept

    return walk(ordered, ends, step, _SPAN)


def scan(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All columns of documents as a struct ``row``, n_words, ``all`` spans and those that are ``kept``."""
    rules = read_rules() if rules is None else rules
    none = F.array().cast(f"array<{_SPAN}>")
    read = documents.select(F.struct("*").alias("row"), words_of(F.col("text")).alias("words"))
    hit = read.select("row", "words", tried(F.col("words"), rules).alias("hits"))
    found = hit.select(
        "row", F.when(F.col("words") == "", F.lit(0)).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(F.size("hits") > 0, located(F.col("words"), F.col("hits"), rules)).otherwise(none).alias("all"),
    )
    return found.select("row", "n_words", "all", F.when(F.size("all") > 0, unsuppressed(F.col("all"))).otherwise(none).alias("kept"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def find_licenses(documents: DataFrame, rules: list[Rule] | None = None, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans of what is kept (label:start:end) for every row. base: phrases that are rules themselves, and their labels."""
    rules = read_rules() if rules is None else rules
    phrases = [n for n, r in enumerate(rules) if base.get(r.pattern) == r.label]
    if len(phrases) != len(base):
        raise ValueError("each base phrase has to be a rule, with its label")
    names = F.array(*(F.lit(r.label) for r in rules))
    named = lambda spans: F.transform(spans, lambda s: F.element_at(names, s["rule"] + 1))
    weight = lambda s: F.element_at(F.array(*map(F.lit, WEIGHTS)), s["level"])
    found = scan(documents, rules).select("row", "n_words", "kept", F.filter("all", lambda s: s["rule"].isin(phrases)).alias("base"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda s: s["start"])).cast("long").alias("last_word"),
        _joined(named(F.col("base"))).alias("base_labels"), _joined(F.concat(named(F.col("base")), named(F.col("kept")))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", weight)), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("kept", lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
