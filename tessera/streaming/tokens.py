"""Token streams: thinking blocks taken out, ended by stop tokens, whatever the places where the text is cut into chunks.

``Filter`` reads chunk by chunk and keeps back only what may yet become a mark: the longest end of the
text so far with which some mark begins. Of all marks the first in the text counts, and of those that
begin together the longest. Within a thinking block only its closing mark counts. After a stop token
nothing more is seen. A thinking block that is never closed hides the rest.

With ``thinking`` a stream begins inside such a block, which is put out as parts of kind ``thinking``;
after it, opening marks are text as any other. A stream that ends without a visible part has an
``error`` part at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.session import ship_package
from tessera.streaming.events import bucketed

OPEN, CLOSE = "<think>", "</think>"
STOPS = ("<|im_end|>", "<|endoftext|>")
EXHAUSTED = "THINKING_BUDGET_EXHAUSTED"


class Filter:
    """The state of one stream."""

    def __init__(self, thinking: bool = False, stops: tuple[str, ...] = STOPS, held: str = "", inside: bool | None = None, over: bool = False, seen: bool = False, any_: bool = False):
        self.thinking, self.stops = thinking, stops
        self.held, self.inside, self.over, self.seen, self.any = held, thinking if inside is None else inside, over, seen, any_

    def state(self) -> tuple:
        return self.held, self.inside, self.over, self.seen, self.any

    def _marks(self) -> tuple[str, ...]:
        return (CLOSE,) if self.inside else self.stops if self.thinking else (OPEN, *self.stops)

    def _part(self, text: str) -> Iterator[tuple[str, str]]:
        if text and not self.inside:
            self.seen = True
            yield "answer", text
        elif text and self.thinking:
            yield "thinking", text

    def chunk(self, text: str) -> Iterator[tuple[str, str]]:
        """(kind, text) of what is sure now."""
        self.any |= bool(text)
        while not self.over:
            text, self.held = self.held + text, ""
            marks = self._marks()
            at, mark = min(((text.find(m), m) for m in marks if m in text), key=lambda x: (x[0], -len(x[1])), default=(-1, ""))
            if at < 0:
                # the longest end that a mark begins with
                longest = max(map(len, marks), default=0)
                self.held = next((text[i:] for i in range(max(0, len(text) - longest + 1), len(text)) if any(m.startswith(text[i:]) for m in marks)), "")
                yield from self._part(text[: len(text) - len(self.held)])
                return
            yield from self._part(text[:at])
            text = text[at + len(mark) :]
            if mark in (OPEN, CLOSE):
                self.inside = mark == OPEN
            else:
                self.over = True

    def end(self) -> Iterator[tuple[str, str]]:
        """What was kept back, as no mark came of it."""
        if not self.over:
            yield from self._part(self.held)
            self.held, self.over = "", True
        if self.thinking and self.any and not self.seen:
            yield "error", EXHAUSTED


class _Tokens(StatefulProcessor):
    """The Filters of a bucket's streams, kept as one value."""

    def __init__(self, thinking: bool, stops: tuple[str, ...]):
        self.thinking, self.stops = thinking, stops

    def init(self, handle) -> None:
        self.kept = handle.getValueState("filters", "filters array<struct<of string, held string, inside boolean, over boolean, seen boolean, any boolean, ended boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.kept.get()[0] if self.kept.exists() else ()
        filters = {of: [Filter(self.thinking, self.stops, *state), ended] for of, *state, ended in before}
        own, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for of, seq, chunk, last in zip(own["of"], own["seq"], own["chunk"], own["last"]):
            kept = filters.get(of) or filters.setdefault(of, [Filter(self.thinking, self.stops), False])
            filter_, ended = kept
            if not ended:
                parts = [*filter_.chunk(chunk or ""), *(filter_.end() if last else ())]
                out += [(of, int(seq), n, kind, text) for n, (kind, text) in enumerate(parts)]
                kept[1] = bool(last)
        self.kept.update(([(of, *filter_.state(), ended) for of, (filter_, ended) in filters.items()],))
        if out:
            yield pd.DataFrame(out, columns=["of", "seq", "n", "kind", "part"])


def visible(chunks: DataFrame, key: str, *, thinking: bool = False, stops: tuple[str, ...] = STOPS) -> DataFrame:
    """(key, seq, n, kind, part) of a stream of (key, seq, chunk, last): the parts that each chunk makes sure."""
    ship_package(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()
    own = bucketed(chunks, key, "seq", "chunk", "last").transformWithStateInPandas(_Tokens(thinking, stops), "of string, seq long, n int, kind string, part string", "append", "none")
    return own.select(F.col("of").cast(kind).alias(key), "seq", "n", "kind", "part")


def joined(parts: DataFrame, key: str, *by: str) -> DataFrame:
    """The parts of each stream as one text."""
    return parts.groupBy(key, *by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "n", "part"))), lambda x: x["part"]), "").alias("text"))


def marked(text: Column, turn: Column, thinking: bool) -> Column:
    """A text with a thinking block after its fifth character (from the start on, if thinking), and a stop token after its 60th in every third turn."""
    body = F.when(turn % 3 == 0, F.concat(F.substring(text, 1, 60), F.lit(STOPS[0]), F.substring(text, 61, 1 << 30))).otherwise(text)
    if thinking:
        return F.concat(F.substring(body, 1, 20), F.when(turn % 5 == 0, F.lit("")).otherwise(F.lit(CLOSE)), F.substring(body, 21, 1 << 30))
    return F.concat(F.substring(body, 1, 5), F.lit(OPEN), F.substring(body, 6, 15), F.lit(CLOSE), F.substring(body, 21, 1 << 30))


def conversation_chunks(conversations: DataFrame, size: int = 7, thinking: bool = False) -> DataFrame:
    """(stream, seq, chunk, last): the marked text of each turn in chunks of so many characters."""
    text = marked(F.coalesce("text", F.lit("")), F.col("turn"), thinking)
    own = conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream"), F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)).alias("cut"))
    return own.select("stream", F.posexplode("cut").alias("seq", "chunk"), (F.size("cut") - 1).alias("end")).select("stream", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("end")).alias("last"))


_SQL_BODY = "WITH t AS (SELECT conv_id || '-' || turn AS stream, turn, CASE WHEN turn % 3 = 0 THEN substring(coalesce(text, ''), 1, 60) || '<|im_end|>' || substring(coalesce(text, ''), 61) ELSE coalesce(text, '') END AS body FROM conversations)"
SQL_VISIBLE = _SQL_BODY + """, v AS (SELECT stream, string_split(regexp_replace(substring(body, 1, 5) || '<think>' || substring(body, 6, 15) || '</think>' || substring(body, 21), '<think>(.|\\n)*?</think>', ''), '<|im_end|>')[1] AS text FROM t)
SELECT stream, text FROM v WHERE text <> ''"""
SQL_THINKING = _SQL_BODY + """, p AS (SELECT stream, CASE WHEN turn % 5 = 0 THEN body ELSE substring(body, 1, 20) END AS thought, CASE WHEN turn % 5 = 0 THEN '' ELSE string_split(substring(body, 21), '<|im_end|>')[1] END AS answer, body FROM t)
SELECT stream, 'thinking' AS kind, thought AS text FROM p WHERE thought <> ''
UNION ALL SELECT stream, 'answer', answer FROM p WHERE answer <> ''
UNION ALL SELECT stream, 'error', 'THINKING_BUDGET_EXHAUSTED' FROM p WHERE answer = '' AND body <> ''"""
