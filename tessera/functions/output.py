"""Texts that models give back, and records of them: blocks, cuts, novelty, templates, labels. JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def passage_blocks(context: Column) -> Column:
    """(number, block) of each [PASSAGE N] ... [PASSAGE END] that stands on lines of its own; of equal numbers all."""
    pattern = r"(?ms)^\[PASSAGE\s+(\d+)\]\n.*?^\[PASSAGE END\]$"
    numbers, blocks = (F.regexp_extract_all(context, F.lit(pattern), F.lit(g)) for g in (1, 0))
    return F.zip_with(numbers, blocks, lambda n, b: F.struct(n.try_cast("int").alias("number"), b.alias("block")))


def context_of(blocks: Column) -> Column:
    return F.array_join(blocks, "\n\n")


def novel_nouns(text: Column, context: Column) -> Column:
    """Capitalised words of a text, besides those that begin a sentence, that its context lacks; sorted, each once."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    starts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1))
    clean = F.transform(words(text), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    nouns = F.array_except(F.filter(clean, lambda w: w.rlike(r"^\p{Lu}.")), starts)
    return F.array_sort(F.filter(F.array_distinct(nouns), lambda w: ~F.contains(F.lower(context), F.lower(w))))


def cut_to_tokens(text: Column, tokens: int, reach: int = 200) -> Column:
    """At most about ``tokens`` tokens of four characters: up to the last end of a sentence shortly before, else up to there. None for no tokens."""
    if tokens <= 0:
        return F.lit(None).cast("string")
    most = tokens * 4
    lo = max(0, most - reach)
    region = F.substring(text, lo + 1, most - lo)
    # what follows the last end of a sentence in the region
    rest = F.length(F.regexp_extract(region, r"(?s)^(.*[.!?])\s", 1))
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(F.substring(text, F.lit(1), F.when(rest > 0, lo + rest).otherwise(most))))


def cut_text(value: Column, most: int) -> Column:
    """Cut texts end in three dots."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def document_record(key: Column, content: Column, score: Column, most: int = 400) -> Column:
    """As it goes to a tracer."""
    return F.struct(F.coalesce(key.cast("string"), F.lit("unknown")).alias("id"), cut_text(F.coalesce(content, F.lit("")), most).alias("content"), F.coalesce(score, F.lit(0.0)).alias("score"))


def chat_template(messages: Column) -> Column:
    """Messages (role, content) as labelled paragraphs, blank ones left out, and a last label for the answer."""
    spoken = F.filter(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    role = lambda m: F.lower(F.trim(F.coalesce(m["role"], F.lit("user"))))
    label = lambda m: F.when(role(m) == "system", "System: ").when(role(m) == "assistant", "Assistant: ").otherwise("User: ")
    return F.array_join(F.concat(F.transform(spoken, lambda m: F.concat(label(m), F.trim(m["content"]))), F.array(F.lit("Assistant:"))), "\n\n")


def without_thinking(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def summary_line(used: Column, budget: Column, docs: Column, ms: Column, before: Column, removed_pct: Column) -> Column:
    """One line on a search: budget, documents, time, and what deduplication removed, if there was any to do."""
    head = F.format_string("Budget: %,d/%,d (%.0f%%) | Docs: %d | Time: %.0fms", used, budget, 100.0 * used / budget, docs, ms)
    return F.concat(head, F.when(before > 0, F.format_string(" | Dedup: -%.0f%%", removed_pct)).otherwise(""))


def metrics_part(**values: Column) -> Column:
    """JSON of measures; those that are null are left out."""
    return F.to_json(F.struct(F.lit("metrics").alias("type"), *(c.alias(k) for k, c in values.items())))


def page_label(display: Column, page: Column, unknown: str = "Unknown page") -> Column:
    """A page as it is shown: its own label, with the word before it where it lacks one, else its number."""
    own = F.trim(F.coalesce(display, F.lit("")))
    shown = F.when(own.rlike(r"(?i)^(page|pages|p\.|pp\.)\s+"), own).when(own.rlike(r"^\d+\s*-\s*\d+$"), F.concat(F.lit("Pages "), own)).otherwise(F.concat(F.lit("Page "), own))
    return F.when(own != "", shown).when(page > 0, F.concat(F.lit("Page "), page.cast("string"))).otherwise(F.lit(unknown))


def collection_guard(intent: Column, confidence: Column, source: Column, override: Column, sources: Column, selects: Column) -> Column:
    """(intent, confidence): a question that selects among several sources, unbound and not overridden, is one on the collection."""
    force = source.isNull() & (F.coalesce(override, F.lit("")) == "") & (sources > 1) & selects
    turned = F.coalesce(force, F.lit(False)) & (intent != "COLLECTION")
    return F.struct(F.when(turned, "COLLECTION").otherwise(intent).alias("intent"), F.when(turned, F.greatest(confidence, F.lit(0.85))).otherwise(confidence).alias("confidence"), F.coalesce(force, F.lit(False)).alias("forced"))


def child_pages(text: Column, start: Column, end: Column, page: Column, display: Column) -> Column:
    """Pages of a child chunk: those of its own marks, else its parent's; the page and its label change together."""
    from tessera.functions.text import marker_range

    first, last = marker_range(text)
    return F.struct(F.coalesce(first, start).alias("start_page"), F.coalesce(last, end).alias("end_page"), F.coalesce(first, page).alias("page_number"), F.coalesce(first.cast("string"), display).alias("display_page"))
