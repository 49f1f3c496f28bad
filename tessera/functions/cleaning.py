"""What a model's answer is freed of, where a needle stands in a raw text, and windows of a bounded size."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Lines of instructions that leak into an answer. Fixed values.
LEAKED = ("Important:", "Grounding rule:", "Base your answer", "Do not substitute", "Task:", "Format:", "Tone:")
#: Phrases that end an answer, in this order. Fixed values.
CHATTER = (
    "answer ends here", "this answer acknowledges", "this answer was generated", "this response reflects", "this response was", "this explanation covers", "this summary covers", "this analysis covers",
    "i hope this helps", "let me know if", "feel free to ask", "is there anything else", "the texts leave open the possibility", "future research may", "it remains to be seen", "only time will tell",
)
#: A denial at the end, repeated list items, words that cannot end a sentence. Fixed values.
DENIAL = r"(?i)\n+\s*The provided context does not contain sufficient information[^\n]*$"
REPEATED = r"(?i)(\d+\.\s+[A-Z][^.]{10,50}\.?)(\s*\1)+"
INCOMPLETE = r"(?i)\b(the|a|an|to|of|in|for|and|or|but|is|are|was|were|that|this|with)\s*$"
#: Least length of a text whose end or halves are looked at, and likeness of halves that are one.
LONG, HALVES = 200, 0.85


def _fields(*names: str) -> StructType:
    return StructType([StructField(n, IntegerType()) for n in names])


def _trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def _last(text: Column, part: str) -> Column:
    """Where the last occurrence of a part begins, from 0; -1 if there is none."""
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(-1)


def without_chatter(text: Column) -> Column:
    """Ends at the first of the phrases, in their order, whose last place is beyond four fifths of what is left; long texts lose a closing denial before."""

    def cut(left: Column, phrase: Column) -> Column:
        at = F.position(F.reverse(phrase), F.reverse(F.lower(left)))
        place = F.length(left) - at - F.length(phrase) + 1
        return F.when((at > 0) & (place > F.length(left) * 0.8), _trim_end(F.substring(left, F.lit(1), place))).otherwise(left)

    start = F.when(F.length(text) > LONG, _trim_end(F.regexp_replace(text, DENIAL, ""))).otherwise(text)
    return F.aggregate(F.array(*map(F.lit, CHATTER)), start, cut)


def once_if_repeated(text: str | None) -> str | None:
    """The first half of a text whose halves are alike, blanks and case apart, by matching blocks."""
    if not text or len(text) < LONG:
        return text
    first, second = text[: len(text) // 2].strip(), text[len(text) // 2 :].strip()
    if not first or not second:
        return text
    a, b = (" ".join(x.split()).lower() for x in (first, second))
    match = difflib.SequenceMatcher(None, a, b)
    # both bounds are never below the ratio, and cost less
    return first if match.real_quick_ratio() >= HALVES and match.quick_ratio() >= HALVES and match.ratio() >= HALVES else text


@F.pandas_udf(StringType())
def _once(text: pd.Series) -> pd.Series:
    return text.map(once_if_repeated)


def once(text: Column) -> Column:
    return _once(text)


def complete(text: Column) -> Column:
    """A text whose last line breaks off ends with its last sentence, if that ends beyond its middle."""
    line = F.element_at(F.split(_trim_end(text), "\n"), -1)
    broken = line.rlike(INCOMPLETE) | ((line != "") & ~line.rlike(r"[.!?:]$"))
    places = [_last(text, mark + after) for mark in ".!?" for after in " \n"]
    # the first of the six kinds that lies far enough
    at = F.coalesce(*(F.when(p > F.length(text) * 0.5, p) for p in places))
    return F.when(broken & at.isNotNull(), F.substring(text, F.lit(1), at + 1)).otherwise(text)


def sanitize(text: Column) -> Column:
    """Leaked lines, chatter, a repeated half, repeated list items and a broken end taken away; null and empty stay."""
    out = text
    for leaked in LEAKED:
        out = F.regexp_replace(out, rf"(?im)^\s*{leaked}.*$", "")
    out = F.regexp_replace(once(without_chatter(out)), REPEATED, "$1")
    return F.when(text == "", text).otherwise(F.regexp_replace(complete(out), r"^\s+|\s+$", ""))


# --- places in raw texts ------------------------------------------------------


def normal_with_places(raw: str) -> tuple[str, np.ndarray]:
    """A text with runs of white space as one blank, none at the ends, lower-cased sign by sign; and of each of its signs the place in raw, with raw's end."""
    signs = np.array(list(raw), dtype=object)
    blank = np.array([c.isspace() for c in raw], bool)
    kept = ~blank
    kept[1:] |= blank[1:] & ~blank[:-1]
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return "", np.array([len(raw)])
    kept[: solid[0]] = False
    kept[solid[-1] + 1 :] = False
    at = np.flatnonzero(kept)
    return "".join(" " if blank[i] else low if len(low := signs[i].lower()) == 1 else signs[i] for i in at), np.append(at, solid[-1] + 1)


@F.pandas_udf(_fields("start", "length"))
def _place(raw: pd.Series, needle: pd.Series) -> pd.DataFrame:
    out = []
    for text, part in zip(raw, needle):
        own, places = normal_with_places(text or "")
        wanted, _ = normal_with_places(part or "")
        at = own.find(wanted) if wanted else -1
        # up to the end of the last sign: a blank within may be long
        out.append((int(places[at]), int(places[at + len(wanted) - 1]) + 1 - int(places[at])) if at >= 0 else (None, None))
    return pd.DataFrame(out, columns=["start", "length"]).astype("Int32")


def place_in_raw(raw: Column, needle: Column) -> Column:
    """(start, length) of where a needle first stands in a raw text, white space and case apart; null where it does not."""
    return _place(raw, needle)


# --- windows ------------------------------------------------------------------

#: Words of a window, words that it shares with the next, and tokens that it may be estimated at.
WINDOW, SHARED, MOST = 250, 50, 300


def windows_of(text: str | None, words: int = WINDOW, shared: int = SHARED, most: int = MOST) -> Iterator[tuple[int, int, int, int]]:
    """(first word, end word, first character, end character) of windows over a text, each the longest that fits: at most ``words`` words, and at most ``most`` by 1.6 tokens a word and by 3.2 characters a token (one word always fits). A short text is one window, blanks at its ends included."""
    if shared >= words:
        raise ValueError("windows have to be longer than what they share")
    text = text or ""
    solid = np.array([not c.isspace() for c in text], bool)
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return
    if n <= most and int(n * 1.6) <= most and int(len(text) / 3.2) <= most:
        yield 0, n, 0, len(text)
        return
    # the most words, and characters, that are estimated at no more
    by_words = max(i for i in range(words + 1) if int(i * 1.6) <= most)
    by_chars = max(i for i in range(int((most + 2) * 3.2)) if int(i / 3.2) <= most)
    at = 0
    while True:
        fits = int(np.searchsorted(ends, starts[at] + by_chars, side="right"))
        end = min(max(at + 1, min(at + by_words, fits)), n)
        yield at, end, int(starts[at]), int(ends[end - 1])
        if end >= n:
            return
        at = max(at + 1, end - shared)


@F.pandas_udf(ArrayType(_fields("word", "end_word", "start", "end")))
def _windows(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [dict(zip(("word", "end_word", "start", "end"), w)) for w in windows_of(x)])


def entity_windows(text: Column) -> Column:
    """Array of a text's windows."""
    return _windows(text)
