"""Streaming queries, run to the end of what is there and compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.text_index import TextIndex
from tessera.plans.retrieval_queries import DOC_BM25, bench
from tessera.registry import query
from tessera.session import fresh_folder, table
from tessera.streaming import blocks as B
from tessera.streaming import events as E
from tessera.streaming import tokens as K


@query("sm08_daily_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def sm08(spark, d):
    return E.drain(E.daily(E.event_stream(spark, f"{d}/events.parquet")), "daily")


# --- the stored text index ----------------------------------------------------


def _filled(spark, d, policy: str, batch: int = 32) -> TextIndex:
    """An index that documents were streamed into, in four micro-batches by their number."""
    index = TextIndex(spark, fresh_folder(spark, "index"), policy=policy, batch=batch, key="doc_id", also=("source",))
    rows = table(spark, d, "documents").select("doc_id", "text", "source")
    index.sink(E.sliced(rows, F.pmod("doc_id", F.lit(4)), 4, "doc_id"), f"{index.root}/checkpoint").awaitTermination()
    return index


@query("sk15_index_stream", "SELECT doc_id AS key, len(own) AS size, term, count(*) AS tf FROM (SELECT doc_id, own, unnest(own) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS own FROM documents)) GROUP BY doc_id, size, term")
def sk15(spark, d):
    """Postings of an index that grew by micro-batches, each refreshed at once: those of one batch."""
    return _filled(spark, d, "immediate").postings().select("key", "size", "term", F.col("tf").cast("long").alias("tf"))


@query("rk24_search_after_refresh", f"WITH {DOC_BM25} SELECT item_id, doc_id, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM bm) WHERE k <= 10")
def rk24(spark, d):
    """A deferred index is dirty until a search refreshes it."""
    return _filled(spark, d, "deferred").search(bench(spark, d), "item_id", 10)


# --- event streams of conversations ---------------------------------------------


@query("sm03_blocks", B.SQL_FRAMES + " SELECT conv_id, n, frame, part FROM frames")
def sm03(spark, d):
    """The frames of event streams that come in several micro-batches, blocks left open between them."""
    events = B.conversation_events(table(spark, d, "conversations"))
    return E.drain(B.frames(E.sliced(events, F.least(F.floor(F.col("seq") / 9), F.lit(3)), 4, "conv_id"), "conv_id"), "frames", "append")


@query("sm04_wire", B.SQL_FRAMES + " SELECT conv_id, n, " + B.SQL_WIRE + " AS wire FROM frames")
def sm04(spark, d):
    """The same frames as lines of the wire."""
    events = B.conversation_events(table(spark, d, "conversations"))
    found = E.drain(B.frames(E.sliced(events, F.least(F.floor(F.col("seq") / 20), F.lit(1)), 2, "conv_id"), "conv_id"), "frames", "append")
    return found.select("conv_id", "n", B.wire(F.col("frame"), F.col("part")).alias("wire"))


# --- token streams ----------------------------------------------------------------


@query("sm05_visible_text", K.SQL_VISIBLE)
def sm05(spark, d):
    """What is seen of token streams with thinking blocks and stop tokens, cut anywhere and spread over micro-batches."""
    cut = K.conversation_chunks(table(spark, d, "conversations"))
    parts = E.drain(K.visible(E.sliced(cut, F.least(F.floor(F.col("seq") / 12), F.lit(3)), 4, "stream"), "stream"), "tokens", "append")
    return K.joined(parts, "stream")


@query("sm11_thinking_parts", K.SQL_THINKING)
def sm11(spark, d):
    """Typed parts of token streams that begin inside a thinking block."""
    cut = K.conversation_chunks(table(spark, d, "conversations"), thinking=True)
    parts = E.drain(K.visible(E.sliced(cut, F.least(F.floor(F.col("seq") / 12), F.lit(3)), 4, "stream"), "stream", thinking=True), "tokens", "append")
    return K.joined(parts, "stream", "kind")
