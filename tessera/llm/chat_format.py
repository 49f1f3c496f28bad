r"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A ``Template`` declares the marker of each turn, which roles bear loss, and the escape sign. Every
text is escaped so that no control string can arise in it, and ``read_back`` undoes that exactly.

Turn order is judged by a finite-state machine whose transitions the template lists. The rows are
range-partitioned by (conversation, turn), so one conversation may lie on many partitions; each
partition formats its runs and gives, for every state in which a run may be entered, the state in
which it ends. The runs of a conversation are then joined in order, by a stream that holds one run
at a time: no task ever holds a whole conversation.

Defined cases: null text is empty, null role is the empty role; roles that the template does not
know are formatted under their own (escaped) name, and make the conversation invalid; turns are
ordered by (turn, role, text), null turns first, so ties and repeated rows have a fixed order and
each is a turn; rows of a null conv_id form one conversation; an empty table gives no rows; columns
other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package

#: Characters of formatted text in one row that travels between tasks.
PART_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """marker: opens a turn, ``{role}`` filled in; end: closes it; labels: names of known roles; loss: roles whose text bears loss; moves: state -> roles that may follow."""

    marker: str = "### {role}: "
    end: str = "</turn>\n"
    escape: str = "\\"
    labels: tuple = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    loss: tuple = ("assistant",)
    start: str = "start"
    moves: tuple = (("start", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    final: tuple = ("user", "assistant")
    _lead: str = field(default="", compare=False)

    def __post_init__(self):
        opens, role, closes = self.marker.partition("{role}")
        if not (opens and role and closes and self.end and len(self.escape) == 1):
            raise ValueError("a marker needs signs before and after {role}, a turn an end, and the escape is one sign")

    def controls(self) -> str:
        """The first signs of all control strings, and the escape sign: these are escaped in texts."""
        opens, closes = self.marker.split("{role}")
        return "".join(dict.fromkeys([self.escape, opens[0], closes[0], self.end[0]]))

    def escaped(self, text: str) -> str:
        return re.sub("[" + re.escape(self.controls()) + "]", lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as (segment, bears loss): the marker, the text, the end."""
        label = dict(self.labels).get(role)
        name = "?" + self.escaped(role) if label is None else label
        return [(self.marker.format(role=name), False), (self.escaped(text), role in self.loss), (self.end, False)]

    def step(self, state: str | None, role: str) -> str | None:
        """The next state, or None: once out of order, a conversation stays so."""
        return role if state is not None and role in dict(self.moves).get(state, ()) else None

    def states(self) -> list[str]:
        return [self.start, *(role for role, _ in self.labels)]

    def read_back(self, formatted: str) -> list[tuple[str, str, bool]]:
        """(role, text, bears loss) of each turn of a formatted text; raises if it is not one."""
        opens, closes = self.marker.split("{role}")
        sign = re.escape(self.escape)
        body = f"((?:{sign}.|[^{re.escape(self.controls())}])*)"
        turn = re.compile(re.escape(opens) + r"(\??)" + body + re.escape(closes) + body + re.escape(self.end), re.S)
        roles = {label: role for role, label in self.labels}
        out, at = [], 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            role = self.unescaped(m[2]) if m[1] else roles[m[2]]
            out.append((role, self.unescaped(m[3]), role in self.loss))
            at = m.end()
        return out


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Runs of formatted turns: conv_id, part, run (their order), formatted, segment_chars and segment_loss (by segment), n_turns, moves (state entered -> state left, null: out of order)."""
    ship_package(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    named = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # range partitions, sorted: a long conversation spreads over many tasks, in order
    # (of a text only its beginning is a key: the driver sees a sample of the keys, and equal ones share a partition)
    dealt = named.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    states = template.states()

    def formatted(batches):
        key, pieces, run, out, chars, held, schema = None, [], 0, [], 0, 0, None

        def flush():
            moves = []
            for state in states:
                for role, _ in pieces:
                    state = template.step(state, role)
                moves.append(state)
            parts = [x for role, text in pieces for x in template.segments(role, text)]
            return {"conv_id": key[0], "part": key[1], "run": run, "formatted": "".join(t for t, _ in parts), "segment_chars": [len(t) for t, _ in parts], "segment_loss": [f for _, f in parts], "n_turns": len(pieces), "moves": moves}

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("run", pa.int32()), ("formatted", pa.string()), ("segment_chars", pa.list_(pa.int32())), ("segment_loss", pa.list_(pa.bool_())), ("n_turns", pa.int64()), ("moves", pa.list_(pa.string()))])
            for conv, role, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                if pieces and (key[0] != conv or chars > PART_CHARS):
                    out.append(flush())
                    held += chars
                    run, pieces, chars = run + 1, [], 0
                    if len(out) >= 2000 or held > PART_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                key = (conv, part)
                pieces.append((role, text))
                chars += len(text)
        if pieces:
            yield pa.RecordBatch.from_pylist([*out, flush()], schema)

    return dealt.select("conv_id", "role", "text", "part").mapInArrow(formatted, f"conv_id {kind}, part int, run int, formatted string, segment_chars array<int>, segment_loss array<boolean>, n_turns long, moves array<string>")


def digest_conversations(runs: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from its formatted runs read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    A digest of a whole text is sequential by its nature; this streams the runs of a conversation in
    order and holds only the hash state, so memory does not grow with a conversation."""
    kind = runs.schema["conv_id"].dataType.simpleString()
    states = template.states()
    dealt = runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run")

    def digested(batches):
        turns, loss, row, state, schema, out = None, None, None, None, None, []

        def closed():
            return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest(), "valid": state in template.final}

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
            for conv, formatted, chars, flags, moves in zip(*(c.to_pylist() for c in batch.columns)):
                if row is None or row["conv_id"] != conv:
                    if row is not None:
                        out.append(closed())
                        if len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    state, turns, loss = template.start, hashlib.sha256(), hashlib.sha256()
                    row = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                state = moves[states.index(state)] if state is not None else None
                row["formatted_chars"] += len(formatted)
                back = template.read_back(formatted)
                row["n_turns"] += len(back)
                for role, text, _ in back:
                    turns.update(f"{role}\n{text}\n".encode())
                at = 0
                for n, under_loss in zip(chars, flags):
                    if under_loss:
                        text = template.unescaped(formatted[at : at + n])
                        row["loss_chars"] += len(text)
                        loss.update(text.encode())
                    at += n
        if row is not None:
            yield pa.RecordBatch.from_pylist([*out, closed()], schema)

    return dealt.select("conv_id", "formatted", "segment_chars", "segment_loss", "moves").mapInArrow(digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
