"""Texts that go into prompts and come out of models: blocks, budgets, marks, gates. All are JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a rerank prompt besides its texts, and for each document; most tokens of a document. Fixed values.
PROMPT_TOKENS, DOC_TOKENS, MOST_DOC_TOKENS = 300, 25, 384
#: A transcript segment is kept within these. Fixed values.
MOST_SILENCE, LEAST_LOGPROB, MOST_COMPRESSION = 0.6, -1.0, 2.4
#: Loudness of speech: of the whole, and its peak. Fixed values.
SPEECH_RMS, SPEECH_PEAK = 0.008, 0.03


def renumber_block(block: Column, number: Column) -> Column:
    """The number at the head of a passage block replaced; other blocks stay."""
    return F.when(block.rlike(r"^\[PASSAGE\s+\d+\]"), F.concat(F.lit("[PASSAGE "), number.cast("string"), F.lit("]"), F.regexp_replace(block, r"^\[PASSAGE\s+\d+\]", ""))).otherwise(block)


def without(text: Column, marks: list[str]) -> Column:
    """Without special marks that a user may have put in."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def cut_tokens(text: Column, most: int = MOST_DOC_TOKENS) -> Column:
    """The first tokens of a document."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda t: t != ""), 1, most), " ")


def prompt_tokens(docs: Column, tokens: Column, query_tokens: Column) -> Column:
    return F.lit(PROMPT_TOKENS) + DOC_TOKENS * docs + tokens + query_tokens


def to_encode(text: Column, task: str | None = None) -> Column:
    """As it goes to an encoder: stripped, "[empty]" for a blank one, with the instruction of a query before it."""
    own = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    own = F.when(own == "", "[empty]").otherwise(own)
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), own) if task else own


def source_legend(pairs: Column) -> Column:
    """Lines "- id → name", sorted, of (id, name) structs whose name differs from the id; empty without any."""
    named = F.array_sort(F.filter(pairs, lambda p: p["id"] != p["name"]))
    lines = F.array_join(F.transform(named, lambda p: F.concat(F.lit("- "), p["id"], F.lit(" → "), p["name"])), "\n")
    return F.when(F.size(named) > 0, F.concat(F.lit("SOURCE LEGEND:\n"), lines)).otherwise("")


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    """Within the limits; what is no finite number becomes the fallback."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), value))).otherwise(F.lit(fallback))


def footnote(number: Column, label: Column, page: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), label, F.coalesce(F.concat(F.lit(", p."), page.cast("string")), F.lit("")), F.lit("."))


def server_event(payload: Column) -> Column:
    """A JSON text as one server-sent event."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def error_body(code: Column, message: Column) -> Column:
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error")))


def best_match(haystack: Column, needle: Column, least: int = 20) -> Column:
    """Where the needle, or else its longest beginning of ``least`` characters or more, stands first; 0 if nowhere. Case does not matter."""
    low, own = F.lower(haystack), F.lower(needle)
    n = F.length(own)
    places = F.transform(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0))), lambda cut: F.position(F.substring(own, F.lit(1), n - cut), low))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(F.filter(places, lambda p: p > 0), F.lit(1)), F.lit(0)))


def transcript(segments: Column, text: Column) -> Column:
    """Texts of the segments that pass the gates, joined; without segments, the text itself, trimmed."""
    fits = lambda s: (F.coalesce(s["silence"], F.lit(0.0)) <= MOST_SILENCE) & (F.coalesce(s["logprob"], F.lit(0.0)) >= LEAST_LOGPROB) & (F.coalesce(s["compression"], F.lit(0.0)) <= MOST_COMPRESSION) & (F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    kept = F.array_join(F.transform(F.filter(segments, fits), lambda s: F.trim(s["text"])), " ")
    return F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, F.trim(F.coalesce(text, F.lit("")))).otherwise(kept)


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two half-open spans meet."""
    return (a_lo < b_hi) & (b_lo < a_hi)


def context_words(text: Column, lo: Column, hi: Column, words: int, reach: int = 240) -> Column:
    """Up to half of so many words (at least one) before a span, the rest behind it, within ``reach`` characters."""
    if words <= 0:
        return F.array().cast("array<string>")
    take = max(1, words // 2)
    left = F.regexp_extract_all(F.substring(text, F.greatest(F.lit(0), lo - reach) + 1, F.least(lo, F.lit(reach))), F.lit(r"(\S+)"), F.lit(1))
    right = F.regexp_extract_all(F.substring(text, hi + 1, F.lit(reach)), F.lit(r"(\S+)"), F.lit(1))
    last = F.slice(left, F.greatest(F.size(left) - take + 1, F.lit(1)), F.lit(take))
    return F.concat(last, F.slice(right, F.lit(1), F.lit(max(0, words - take))))
