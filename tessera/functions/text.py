"""Text functions: tokens, windows, sentences, page markers, names. All are JVM-side Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _bases() -> tuple[str, str]:
    """Letters of the Latin and Greek blocks that are one letter and marks, and those letters."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if unicodedata.category(x) != "Mn") for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000))}
    own = {k: v for k, v in plain.items() if len(v) == 1 and v != k}
    return "".join(own), "".join(own.values())


ACCENTED, PLAIN = _bases()


def tokens(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Where windows of ``size`` tokens begin, each sharing ``overlap`` with the one before; the last reaches the end. No tokens: no windows."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window needs size > 0 and 0 <= overlap < size")
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def token_windows(text: Column, size: int, overlap: int, own: Column | None = None) -> Column:
    """Windows as texts. own: the text's tokens, where they are a column already, as an expression is worked out wherever it stands."""
    own = tokens(text) if own is None else own
    return F.transform(window_starts(F.size(own), size, overlap), lambda s: F.array_join(F.slice(own, s + 1, size), " "))


def parent_windows(text: Column, whole: int = 1500, size: int = 1200, overlap: int = 150, least: int = 1000, own: Column | None = None) -> Column:
    """Parent chunks: a text of up to ``whole`` tokens is one; else windows, a last one under ``least`` tokens being appended, overlap and all, to the one before."""
    own = tokens(text) if own is None else own
    n = F.size(own)
    starts = window_starts(n, size, overlap)
    part = lambda s: F.array_join(F.slice(own, s + 1, size), " ")
    tail = n - F.element_at(starts, -1)
    last = F.element_at(starts, -1)
    # each window once: the one before a short tail takes it in
    merged = F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda s: F.when(s == last - (size - overlap), F.concat_ws(" ", part(s), part(last))).otherwise(part(s)))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= whole, F.array(F.array_join(own, " ")))
        .when((tail < least) & (F.size(starts) > 1), merged)
        .otherwise(F.transform(starts, part))
    )


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def pack_units(units: Column, most: int = 200, carry: int = 2, least: int = 120) -> Column:
    """Child chunks: units (sentences) packed in order up to ``most`` tokens, the last ``carry`` units repeated in the next chunk; a chunk of under ``least`` tokens joins the one before it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))
    count = lambda parts: token_count(F.array_join(parts, " "))

    def step(acc, unit):
        full = (F.size(acc["now"]) > 0) & (count(F.concat(acc["now"], F.array(unit))) > most)
        kept = F.slice(acc["now"], F.greatest(F.size(acc["now"]) - carry + 1, F.lit(1)), carry)
        return F.when(full, F.struct(F.concat(acc["done"], F.array(F.array_join(acc["now"], " "))).alias("done"), F.concat(kept, F.array(unit)).alias("now"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(unit)).alias("now"))
        )

    packed = F.aggregate(units, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]))

    def join_short(acc, chunk):
        short = (token_count(chunk) < least) & (F.size(acc) > 0)
        return F.when(short, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), chunk)))).otherwise(F.concat(acc, F.array(chunk)))

    return F.aggregate(packed, F.array().cast("array<string>"), join_short)


def clean_ocr(text: Column) -> Column:
    """Joins words that a hyphen and a line break part."""
    return F.regexp_replace(text, r"([A-Za-z])-[\t\r\n ]+([A-Za-z])", "$1$2")


def page_marker(page: Column) -> Column:
    return F.concat(F.lit("[Page "), F.greatest(F.lit(1), page).cast("string"), F.lit("]"))


def page_markers(text: Column) -> Column:
    """Page numbers of [Page N] marks, in order, of at least 1."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[Page\s+(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")), lambda p: p >= 1)


def marker_range(text: Column) -> tuple[Column, Column]:
    """First and last mark by place, null without any."""
    pages = page_markers(text)
    return F.try_element_at(pages, F.lit(1)), F.try_element_at(pages, F.lit(-1))


def sample_context(text: Column, limit: int, gap: str = "\n...\n") -> Column:
    """A long text's head, middle and tail, a third of the limit each."""
    part = limit // 3
    middle = (F.length(text) / 2).cast("int") - part // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat_ws(gap, F.substring(text, 1, part), F.substring(text, middle + 1, F.lit(part)), F.substring(text, F.length(text) - part + 1, F.lit(part))))


def snippet(text: Column, start: Column, end: Column, radius: int = 120) -> Column:
    """Characters around a span, white space collapsed."""
    lo = F.greatest(F.lit(0), start - radius)
    return F.trim(F.regexp_replace(F.substring(text, lo + 1, end + radius - lo), r"\s+", " "))


def estimate_tokens(text: Column) -> Column:
    """max(1, 1.6 a word, one for 3.2 characters), in whole tokens."""
    return F.greatest(F.lit(1), F.floor(token_count(text) * 1.6), F.floor(F.length(text) / 3.2)).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_accents(text: Column) -> Column:
    """Letters of the Latin, Greek and Cyrillic blocks without their marks, whether these are part of a letter or stand after it."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}", ""), ACCENTED, PLAIN)


def index_form(text: Column) -> Column:
    """As names are indexed: without accents, in lower case, trimmed."""
    return F.lower(F.trim(strip_accents(text)))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of a text with two blanks at either end."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def normal_place(text: Column) -> Column:
    """A place query: accents, blanks and case levelled, a leading "the " dropped."""
    return F.regexp_replace(F.lower(strip_accents(collapse(text))), "^the ", "")


def safe_file_name(name: Column) -> Column:
    """The name itself if it is safe and short, else the first 16 digits of its SHA-256."""
    return F.when(name.rlike(r"^[A-Za-z0-9._-]+$") & (F.length(name) <= 200), name).otherwise(F.substring(F.sha2(name, 256), 1, 16))


def source_id(file_name: Column, most: int = 120) -> Column:
    """From the name of a file: without folders and the last extension, signs as single underscores."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"(?s)^.*/", ""), r"(?s)^(.+)\.[^.]+$", "$1")
    safe = F.btrim(F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-]", "_"), "_+", "_"), F.lit("_"))
    return F.when(safe == "", "uploaded_doc").otherwise(F.substring(safe, 1, most))


def citation_marks(text: Column) -> Column:
    """Numbers of inline marks [N] or [N, p.XX]."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)(?:,\s*p\.\s*\d+)?\]"), F.lit(1)), lambda x: x.cast("int"))


def session_title(text: Column, most: int = 57) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def strip_blocks(text: Column, opens: str, closes: str) -> Column:
    """Without the parts between two marks."""
    return F.regexp_replace(text, f"(?s){opens}.*?{closes}", "")
