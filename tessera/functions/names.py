"""Names of persons: blanks, titles, ranks for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles before a name, fixed values.
TITLES = ("dr", "prof", "mr", "mrs", "ms", "sir", "dame", "lord", "lady", "fr", "rev", "capt", "gen")
#: Signs at either end of a token that are no part of it, fixed values.
SIGNS = r"""[.,;:()\[\]{}"']"""


def collapse_spaces(value: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def clean_token(token: Column) -> Column:
    """Without blanks and signs at its ends."""
    return F.regexp_replace(F.trim(token), f"^{SIGNS}+|{SIGNS}+$", "")


def name_tokens(value: Column) -> Column:
    """Cleaned tokens, without titles at the beginning, however many."""
    own = F.filter(F.transform(F.split(collapse_spaces(value), " "), clean_token), lambda t: t != "")
    first = F.array_position(F.transform(own, lambda t: ~F.lower(t).isin(*TITLES)), True)
    return F.when(first > 0, F.slice(own, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(own), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def strip_titles(value: Column) -> Column:
    return F.array_join(name_tokens(value), " ")


def normalize_name(value: Column) -> Column:
    """As names are compared; null counts as empty."""
    return F.lower(strip_titles(F.coalesce(value, F.lit(""))))


def display_form(value: Column) -> Column:
    """Titles stripped, unless nothing would be left."""
    stripped = strip_titles(value)
    return F.when(stripped != "", stripped).otherwise(collapse_spaces(value))


def display_rank(name: Column) -> Column:
    """(tokens, characters): the greater is the better name to show."""
    return F.struct(F.size(F.filter(F.split(name, r"\s+"), lambda t: t != "")).alias("tokens"), F.length(name).alias("length"))


def better_display(current: Column, candidate: Column) -> Column:
    """The candidate only where it ranks above the current name."""
    return F.when(display_rank(candidate) > display_rank(current), candidate).otherwise(current)


def last_token(normal: Column) -> Column:
    """The last word of a normal name, empty for an empty one."""
    return F.element_at(F.split(normal, " "), -1)


def role_hint() -> Column:
    """The only role that is told so far."""
    return F.lit("mentioned")
