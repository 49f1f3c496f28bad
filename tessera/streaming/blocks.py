"""Event streams of one answer each, turned into frames: text and reasoning blocks that open and close, pings while nothing comes.

An event has its stream's key, a number ``seq``, a kind and a text ``part``. ``thinking`` and ``text``
are pieces of a block. A thinking piece opens a reasoning block and leaves a text block open; a text
piece closes the reasoning block; any other event closes both, then is a frame itself. ``end`` closes
both and is none. Events after the end are dropped.

The state of a stream (which blocks are open, the frames so far) is kept by Spark between
micro-batches; events of one stream have to come in the order of seq from batch to batch, within one
they are sorted. With ``idle_ms``, a timer adds a ``ping`` after so long without events while a stream
is open; a run that ends with what is there (availableNow) has to go without, as timers keep it alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.functions.prompts import server_event
from tessera.session import ship_package
from tessera.streaming.events import bucketed

#: Idle time after which a client is told that its stream lives.
IDLE_MS = 8000


class Machine:
    """Which blocks are open, and how many frames there were."""

    __slots__ = ("ended", "n", "reasoning", "text")

    def __init__(self, text: bool = False, reasoning: bool = False, n: int = 0, ended: bool = False):
        self.text, self.reasoning, self.n, self.ended = text, reasoning, n, ended

    def state(self) -> tuple:
        return self.text, self.reasoning, self.n, self.ended

    def _frame(self, frame: str, part: str | None = None) -> tuple[int, str, str | None]:
        self.n += 1
        return self.n - 1, frame, part

    def event(self, kind: str, part: str | None) -> Iterator[tuple[int, str, str | None]]:
        """The frames that an event makes."""
        if self.ended:
            return
        if kind == "thinking":
            if not self.reasoning:
                self.reasoning = True
                yield self._frame("reasoning-start")
            yield self._frame("reasoning-delta", part)
            return
        if self.reasoning:
            self.reasoning = False
            yield self._frame("reasoning-end")
        if kind == "text":
            if not self.text:
                self.text = True
                yield self._frame("text-start")
            yield self._frame("text-delta", part)
            return
        if self.text:
            self.text = False
            yield self._frame("text-end")
        if kind == "end":
            self.ended = True
        else:
            yield self._frame(kind, part)

    def ping(self) -> tuple[int, str, str | None]:
        return self._frame("ping")


class _Blocks(StatefulProcessor):
    """One Machine for each stream."""

    def __init__(self, key: str, idle_ms: int | None):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("machine", "text boolean, reasoning boolean, n long, ended boolean")

    def _machine(self) -> Machine:
        return Machine(*self.held.get()) if self.held.exists() else Machine()

    def _keep(self, machine: Machine, now: int) -> None:
        self.held.update(machine.state())
        if self.idle_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if not machine.ended:
            self.handle.registerTimer(now + self.idle_ms)

    def _rows(self, key, frames: list) -> pd.DataFrame:
        n, frame, part = zip(*frames)
        return pd.DataFrame({self.key: [key[0]] * len(n), "n": n, "frame": frame, "part": part})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, frames = self._machine(), []
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for kind, part in zip(own["kind"], own["part"]):
            frames += machine.event(kind, part)
        self._keep(machine, timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0)
        if frames:
            yield self._rows(key, frames)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._machine()
        if not machine.ended:
            frame = machine.ping()
            self._keep(machine, timerValues.getCurrentProcessingTimeInMs())
            yield self._rows(key, [frame])


class _Shared(StatefulProcessor):
    """The Machines of a bucket's streams, kept as one value; without timers."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("machines", "machines array<struct<of string, text boolean, reasoning boolean, n long, ended boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machines = {of: Machine(*state) for of, *state in (self.held.get()[0] if self.held.exists() else ())}
        own, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for of, kind, part in zip(own["of"], own["kind"], own["part"]):
            machine = machines.get(of) or machines.setdefault(of, Machine())
            out += [(of, *frame) for frame in machine.event(kind, part)]
        self.held.update(([(of, *machine.state()) for of, machine in machines.items()],))
        if out:
            yield pd.DataFrame(out, columns=["of", "n", "frame", "part"])


def frames(events: DataFrame, key: str, idle_ms: int | None = None) -> DataFrame:
    """(key, n, frame, part) of a stream of (key, seq, kind, part). A micro-batch's events of one stream, or without idle_ms of one bucket of streams, are sorted in memory: bound them by the source's rate."""
    ship_package(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    if idle_ms is None:
        own = bucketed(events, key, "seq", "kind", "part").transformWithStateInPandas(_Shared(), "of string, n long, frame string, part string", "append", "none")
        return own.select(F.col("of").cast(kind).alias(key), "n", "frame", "part")
    return events.groupBy(key).transformWithStateInPandas(_Blocks(key, idle_ms), f"{key} {kind}, n long, frame string, part string", "append", "processingTime")


def _data(kind: str, **fields: Column) -> Column:
    return server_event(F.to_json(F.struct(F.lit(f"data-{kind}").alias("type"), F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in fields.items())).alias("data"))))


def wire(frame: Column, part: Column) -> Column:
    """A frame as server-sent events."""
    block = F.concat(F.substring_index(frame, "-", 1), F.lit("-0"))
    plain = lambda *fields: server_event(F.to_json(F.struct(*fields)))
    step = plain(F.lit("data-finish-step").alias("type"), F.struct(part.alias("finishReason"), F.lit(False).alias("isContinued")).alias("data"))
    return (
        F.when(frame == "ping", F.lit(": ping\n\n"))
        .when(frame.endswith("-delta"), plain(frame.alias("type"), block.alias("id"), part.alias("delta")))
        .when(frame.rlike("^(text|reasoning)-(start|end)$"), plain(frame.alias("type"), block.alias("id")))
        .when(frame == "status", _data("status", status=part))
        .when(frame == "intent", _data("intent", intent=part))
        .when(frame == "error", F.concat(_data("error", error=F.struct(F.lit("INTERNAL").alias("code"), part.alias("message"))), plain(F.lit("error").alias("type"), part.alias("error"))))
        .when(frame == "finish", F.concat(step, plain(F.lit("finish").alias("type"))))
        .otherwise(plain(F.concat(F.lit("data-"), frame).alias("type"), part.alias("data")))
    )


#: Words of a piece of text.
PIECE = 8


def conversation_events(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, part): each conversation as the events of one answer. A user's turn is a status, a system's an intent; of an assistant's text the first eight words are thought and the others said, eight at a time. Then it finishes; without an assistant's turn it ends in an error."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / PIECE).cast("int")), lambda i: F.struct(F.when(i == 0, "thinking").otherwise("text").alias("kind"), F.concat(F.array_join(F.slice(words, i * PIECE + 1, F.lit(PIECE)), " "), F.lit(" ")).alias("part")))
    one = lambda kind, part: F.array(F.struct(F.lit(kind).alias("kind"), part.alias("part")))
    own = F.when(F.col("role") == "assistant", pieces).when(F.col("role") == "system", one("intent", F.lit("SYSTEM"))).otherwise(one("status", F.lit("asked")))
    said = conversations.select("conv_id", "turn", F.posexplode(own).alias("at", "x")).select("conv_id", "turn", "at", "x.kind", "x.part")
    answered = F.max((F.col("role") == "assistant").cast("int")) == 1
    closing = lambda *events: F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(part).cast("string").alias("part")) for kind, part in events))
    last = F.when(answered, closing(("finish", "stop"), ("end", None))).otherwise(closing(("error", "no answer"), ("finish", "error"), ("end", None)))
    ends = conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"), last.alias("last")).select("conv_id", "turn", F.posexplode("last").alias("at", "x")).select("conv_id", "turn", "at", "x.kind", "x.part")
    order = Window.partitionBy("conv_id").orderBy("turn", "at")
    return said.unionAll(ends).select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "kind", "part")


SQL_FRAMES = """
WITH turns AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), ' ') AS words FROM conversations),
said AS (
  SELECT conv_id, turn, i AS place, CASE WHEN role = 'assistant' THEN CASE WHEN i = 0 THEN 'thinking' ELSE 'text' END WHEN role = 'system' THEN 'intent' ELSE 'status' END AS kind,
    CASE WHEN role = 'assistant' THEN array_to_string(words[i * 8 + 1:i * 8 + 8], ' ') || ' ' WHEN role = 'system' THEN 'SYSTEM' ELSE 'asked' END AS part
  FROM (SELECT *, unnest(range(0, CASE WHEN role = 'assistant' THEN (len(words) - 1) // 8 + 1 ELSE 1 END)) AS i FROM turns)),
ends AS (SELECT conv_id, max(turn) + 1 AS turn, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) = 1 AS fine FROM turns GROUP BY conv_id),
all_events AS (
  SELECT * FROM said
  UNION ALL SELECT conv_id, turn, 0, 'error', 'no answer' FROM ends WHERE NOT fine
  UNION ALL SELECT conv_id, turn, 1, 'finish', CASE WHEN fine THEN 'stop' ELSE 'error' END FROM ends
  UNION ALL SELECT conv_id, turn, 2, 'end', NULL FROM ends),
marked AS (
  SELECT *, lag(kind) OVER w AS before, sum(CASE WHEN kind NOT IN ('text', 'thinking') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run,
    row_number() OVER w AS seq
  FROM all_events WINDOW w AS (PARTITION BY conv_id ORDER BY turn, place)),
opened AS (SELECT *, coalesce(max(CASE WHEN kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, coalesce(run, 0) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS in_text, coalesce(before = 'thinking', false) AS in_thought FROM marked),
made AS (
  SELECT conv_id, seq, 0 AS k, 'reasoning-start' AS frame, NULL AS part FROM opened WHERE kind = 'thinking' AND NOT in_thought
  UNION ALL SELECT conv_id, seq, 1, 'reasoning-delta', part FROM opened WHERE kind = 'thinking'
  UNION ALL SELECT conv_id, seq, 0, 'reasoning-end', NULL FROM opened WHERE kind <> 'thinking' AND in_thought
  UNION ALL SELECT conv_id, seq, 1, 'text-start', NULL FROM opened WHERE kind = 'text' AND NOT in_text
  UNION ALL SELECT conv_id, seq, 2, 'text-delta', part FROM opened WHERE kind = 'text'
  UNION ALL SELECT conv_id, seq, 1, 'text-end', NULL FROM opened WHERE kind NOT IN ('text', 'thinking') AND in_text
  UNION ALL SELECT conv_id, seq, 2, kind, part FROM opened WHERE kind NOT IN ('text', 'thinking', 'end')),
frames AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq, k) - 1 AS n, frame, part FROM made)"""

SQL_WIRE = """CASE
  WHEN frame LIKE '%-delta' THEN 'data: ' || to_json({'type': frame, 'id': split_part(frame, '-', 1) || '-0', 'delta': part}) || chr(10) || chr(10)
  WHEN frame LIKE 'text-%' OR frame LIKE 'reasoning-%' THEN 'data: ' || to_json({'type': frame, 'id': split_part(frame, '-', 1) || '-0'}) || chr(10) || chr(10)
  WHEN frame = 'status' THEN 'data: ' || to_json({'type': 'data-status', 'data': {'type': 'status', 'status': part}}) || chr(10) || chr(10)
  WHEN frame = 'intent' THEN 'data: ' || to_json({'type': 'data-intent', 'data': {'type': 'intent', 'intent': part}}) || chr(10) || chr(10)
  WHEN frame = 'error' THEN 'data: ' || to_json({'type': 'data-error', 'data': {'type': 'error', 'error': {'code': 'INTERNAL', 'message': part}}}) || chr(10) || chr(10) || 'data: ' || to_json({'type': 'error', 'error': part}) || chr(10) || chr(10)
  ELSE 'data: ' || to_json({'type': 'data-finish-step', 'data': {'finishReason': part, 'isContinued': false}}) || chr(10) || chr(10) || 'data: ' || to_json({'type': 'finish'}) || chr(10) || chr(10) END"""
