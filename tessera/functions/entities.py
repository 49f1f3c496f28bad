"""Candidates of places and persons in texts: patterns, plausibility, bounds. JVM-side Columns but for the spans of tokens.

Defined cases: a null text has no candidates; blank names are never plausible; of places that differ in
case alone the first stays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.functions.batches import cuts
from tessera.functions.folds import once

RUNS = re.compile(r"\S+")

#: Blanks as the SQL of the queries has them, for the inside of brackets: Java's without the vertical tab.
BLANK = r" \t\n\f\r"

#: Historical regions: latitude, longitude, radius in kilometres. Fixed values.
NAMED_REGIONS = {
    "mesopotamia": (33.5, 44.4, 350),
    "levant": (33.0, 36.0, 300),
    "rhineland": (50.9, 7.0, 150),
    "iberia": (40.0, -4.0, 700),
    "anatolia": (39.0, 35.0, 600),
    "gaul": (46.5, 2.5, 600),
    "magna graecia": (39.0, 16.5, 350),
    "holy land": (31.7, 35.2, 150),
    "bohemia": (49.8, 15.5, 200),
    "transylvania": (46.5, 24.5, 200),
    "pannonia": (47.0, 18.0, 350),
    "dacia": (45.5, 25.0, 300),
    "numidia": (36.0, 6.0, 400),
    "thrace": (41.5, 26.0, 250),
    "bithynia": (40.5, 30.0, 200),
}
#: Words that name no place by themselves. Fixed values.
GENERIC_PLACES = (
    "city", "region", "area", "province", "state", "district", "county", "territory", "kingdom", "republic", "empire", "capital",
    "north", "south", "east", "west", "town", "village", "port", "fort", "mount", "lake", "river",
    "island", "peninsula", "valley", "bay", "gulf", "cape",
)
#: Headings that look like persons. Fixed values.
NO_PERSONS = ("figure", "table", "chapter", "section", "appendix", "references", "reference", "bibliography", "introduction", "conclusion", "abstract", "supplement")
#: Labels of recognisers. Fixed values.
PLACE_LABELS, PERSON_LABELS = ("CITY", "LOCATION", "LOC", "GPE"), ("PERSON", "PER")

#: Words after which a place stands, and a capitalised name of up to three words. Fixed values.
CUES = r"near|around|from|at|within|close to|proximate to|surrounding|adjacent to|vicinity of|region of|area of|province of|kingdom of"
NAME = r"[A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-]+){0,2}"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_of_each(values: Column) -> Column:
    """Without those that differ from one before in case alone, and without blank ones."""
    def firsts(own):
        return once(F.transform(own, F.lower), lambda lowered: F.filter(own, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1))

    # a value that a lambda uses is worked out for each element, unless it is one element itself
    return once(F.filter(F.transform(values, F.btrim), lambda v: v != ""), firsts)


def places_in(text: Column) -> Column:
    """Quoted names, names after a cue (parts of a chain with "and" one by one), both ends of "between", and historical regions; each once, in this order."""
    own = F.coalesce(text, F.lit(""))
    # the name is only looked at, so that a cue inside it is found too
    chains = _all(own, rf"(?i:\b(?:{CUES})\b)\s+(?=({NAME}(?:\s+and\s+{NAME})*))", 1)
    between = rf"\b[Bb]etween\s+\"?({NAME})\"?\s+[Aa]nd\s+\"?({NAME})\"?"
    pairs = F.zip_with(_all(own, between, 1), _all(own, between, 2), lambda a, b: F.array(a, b))
    regions = F.filter(F.array(*(F.when(F.lower(own).rlike(rf"\b{r}\b"), F.lit(r.title())) for r in NAMED_REGIONS)), lambda r: r.isNotNull())
    return first_of_each(F.concat(_all(own, r'"([^"]{2,60})"', 1), F.flatten(F.transform(chains, lambda c: F.split(c, r"\s+and\s+", 5))), F.flatten(pairs), regions))


def generic_place(query: Column) -> Column:
    """One to three words, all of which are generic."""
    words = _all(query, "[a-z]{2,}", 0)
    return F.size(words).between(1, 3) & F.forall(words, lambda w: w.isin(*GENERIC_PLACES))


def person_like(name: Column, lower_text: Column) -> Column:
    """Whether a candidate may be a person's name. lower_text: the text around it is in lower case, so that its own case tells nothing."""

    def like(own):
        sound = lambda tokens: ((F.size(tokens) > 1) | (F.length(own) >= 4)) & F.forall(tokens, lambda t: ~F.lower(t).isin(*NO_PERSONS) & t.rlike(r"^\p{L}[\p{L}\-'.]*\z"))
        return (F.length(own) >= 3) & (lower_text | (own != F.lower(own))) & once(F.split(own, f"[{BLANK}]+"), sound)

    # \z: a dollar sign would also stand before a last line separator
    return once(F.regexp_replace(F.coalesce(name, F.lit("")), rf"^[{BLANK}]+|[{BLANK}]+\z", ""), like)


def bounds(text: Column, name: Column, start: Column, end: Column) -> Column:
    """(start, end) of a candidate: as given, else its first place in the text, else 0; the end within the text and not before the start."""
    first = F.greatest(F.position(name, text) - 1, F.lit(0))
    lo = F.coalesce(start.cast("int"), first)
    return F.struct(lo.alias("start"), F.greatest(lo, F.least(F.length(text), F.coalesce(end.cast("int"), lo + F.length(name)))).alias("end"))


def candidates(rows: Column, labels: tuple, least: float) -> Column:
    """Of structs with entity_type and score, those of some labels with at least a score."""
    return F.filter(rows, lambda r: r["entity_type"].isin(*labels) & (r["score"] >= least))


def person_candidates(rows: Column, least: float, lower_text: Column) -> Column:
    return F.filter(candidates(rows, PERSON_LABELS, least), lambda r: person_like(r["text"], lower_text))


@F.arrow_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType())))
def _spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    # the spans of few texts at a time, which leave before the next are looked for
    for text in texts:
        for lo, n in cuts(text):
            own, ends = array("i"), [0]
            for t in text.slice(lo, n).to_pylist():
                for m in RUNS.finditer(t or ""):
                    own.extend(m.span())
                ends.append(len(own) // 2)
            flat = np.frombuffer(own, np.int32) if own else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2])], fields=list(kind)))
        del text


def token_spans(text: Column) -> Column:
    """(start, end) of each run of non-space characters. In Arrow batches: a running total over an array is quadratic in it."""
    return _spans(text.cast("string"))
