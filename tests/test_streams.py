"""Search, the stored index, and streams with state."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.text_index import TextIndex
from tessera.plans import retrieval_queries as Q
from tessera.session import fresh_folder, table
from tessera.streaming import blocks as B
from tessera.streaming import events as E
from tessera.streaming import tokens as K

SF = "/root/testdata/sf0.01"


# --- search -------------------------------------------------------------------


def test_inverted_file_finds_nine_of_ten(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        exact = {(r["item_id"], r["doc_id"]) for r in Q.dense(spark, sf, 10).collect()}
        probed = {(r["item_id"], r["doc_id"]) for r in Q.probed(spark, sf, 10).collect()}
        print(sf, len(exact & probed) / len(exact))
        assert len(exact) >= 400 and len(exact & probed) >= 0.9 * len(exact)


def test_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, None, "a"), (4, [1.0], "a"), (5, [1.0, 0.0], None), (None, [1.0, 0.0], "a"), (6, [float("nan"), 0.0], "a"), (1, [1.0, 0.0], "a")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, source string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], "b"), (3, None, None), (4, [2.0, 0.0], "z")], "query_id long, query_vector array<double>, only string")
    got = [tuple(r) for r in S.vector_topk(vectors, asked, 3, only=("source", "only")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 1, 1.0, 2), (1, 5, 1.0, 3), (2, 2, round(1 / (1 + 2**0.5), 6), 1)]
    assert S.vector_topk(vectors.limit(0), asked, 3).count() == 0 and S.vector_topk(vectors, asked.limit(0), 3).count() == 0
    cells = S.Cells.fit(vectors.where("false"))
    assert cells.assign(vectors).where("cell is null").count() == 8


def test_queries_in_blocks_and_groups(spark, monkeypatch):
    docs, items = Q.docs(spark, SF), Q.bench(spark, SF)
    want = S.bm25_topk(docs, items, "doc_id", "item_id", 7).orderBy("item_id", "rank").collect()
    monkeypatch.setattr(S, "MAX_QUERIES", 15)
    monkeypatch.setattr(S, "TOGETHER", 4)
    monkeypatch.setattr(S, "ROWS", 100)
    assert S.bm25_topk(docs, items, "doc_id", "item_id", 7).orderBy("item_id", "rank").collect() == want


def test_words_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One one TWO, two;two"), (None, "one"), (4, "é K"), (5, "x" * 100_000 + " one")], "doc_id long, text string")
    lists = {r["key"]: (r["size"], dict(zip(r["terms"], r["counts"]))) for r in S.term_lists(docs, "doc_id").collect()}
    assert lists[1] == lists[2] == (0, {}) and lists[3] == (5, {"one": 2, "two": 3}) and lists[4] == (1, {"k": 1})
    got = S.bm25_topk(docs, spark.createDataFrame([(1, "one nothing"), (2, None)], "q long, text string"), "doc_id", "q", 5).collect()
    # by hand: n = 6 with the one without a key, sizes 5 and 2
    assert [(r["doc_id"], r["rank"]) for r in got] == [(5, 1), (3, 2)]


def test_texts_are_scored_by_one_worker_a_task(spark, capsys):
    docs, items = Q.docs(spark, SF), Q.bench(spark, SF)
    found = S.bm25_topk(docs, items, "doc_id", "item_id", 7)
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    stored = S.bm25_lists(S.term_lists(docs, "doc_id"), items, "doc_id", "item_id", 7)
    assert found.orderBy("item_id", "rank").collect() == stored.orderBy("item_id", "rank").collect()


def test_scaled_scores_and_weights(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2), (2, 10, 0.3, 1)], "q long, id long, score double, rank int")
    lexical = spark.createDataFrame([(1, 11, 7.0, 1), (1, 12, 3.0, 2)], "q long, id long, score double, rank int")
    got = {(r["q"], r["id"]): r["score"] for r in S.hybrid(dense, lexical, "q", "id", 5, 0.25).collect()}
    assert got == {(1, 10): 0.75, (1, 11): 0.25, (1, 12): 0.0, (2, 10): 0.75}
    with pytest.raises(ValueError):
        S.search(dense, "q", "id", 3)


# --- the stored index -----------------------------------------------------------


def postings(index):
    return sorted(map(tuple, index.postings().collect()))


def test_policies_of_the_index(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, text string")
    index = {p: TextIndex(spark, fresh_folder(spark, "t"), policy=p, batch=3) for p in ("immediate", "batch", "deferred")}
    seen = []
    for i in range(3):
        for p, own in index.items():
            own.append(rows((2 * i, f"word w{i}"), (2 * i + 1, "other")))
            s = own.status()
            seen.append((p, s["dirty"], s["pending_rows"], s["version"]))
    assert seen == [
        ("immediate", False, 0, 0), ("batch", True, 2, -1), ("deferred", True, 2, -1), ("immediate", False, 0, 1), ("batch", False, 0, 1), ("deferred", True, 4, -1),
        ("immediate", False, 0, 2), ("batch", True, 2, 1), ("deferred", True, 6, -1),
    ]
    asked = spark.createDataFrame([(1, "w2 word")], "q long, text string")
    found = {p: [tuple(r) for r in own.search(asked, "q", 2).orderBy("rank").collect()] for p, own in index.items()}
    assert found["immediate"] == found["batch"] == found["deferred"] and found["deferred"][0][1] == 4
    assert not any(own.status()["dirty"] for own in index.values())
    with pytest.raises(ValueError):
        TextIndex(spark, "x", policy="never")


def test_index_takes_the_latest_and_repeats_appends(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, text string")
    index = TextIndex(spark, fresh_folder(spark, "t"))
    assert index.status() == {"policy": "immediate", "dirty": False, "pending_rows": 0, "version": -1} and index.postings().count() == 0
    index.append(rows((1, "a b"), (2, "c"), (None, "d"), (3, None)), 0)
    index.append(rows((1, "z")), 1)
    index.append(rows((1, "z")), 1)
    assert postings(index) == [(1, 1, "z", 1), (2, 1, "c", 1)]
    index.remove(rows((2, "")))
    index.remove(rows((1, "")))
    assert postings(index) == []
    index.append(rows((2, "again")))
    assert postings(index) == [(2, 1, "again", 1)]


def test_index_is_rebuilt_where_lists_cannot_be_read(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.append(spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string"))
    for f in (tmp_path / "index/lists/append=0").glob("*.parquet"):
        f.write_bytes(b"broken")
    got = index.search(spark.createDataFrame([(1, "c")], "q long, text string"), "q", 3).collect()
    assert [r["id"] for r in got] == [2]


# --- blocks ---------------------------------------------------------------------


def test_blocks_open_and_close():
    machine = B.Machine()
    events = [("status", "s"), ("thinking", "a"), ("thinking", "b"), ("text", "c"), ("thinking", "d"), ("text", "e"), ("intent", "i"), ("text", "f"), ("thinking", "g"), ("end", None), ("text", "late")]
    got = [(frame, part) for kind, part in events for _, frame, part in machine.event(kind, part)]
    assert got == [
        ("status", "s"), ("reasoning-start", None), ("reasoning-delta", "a"), ("reasoning-delta", "b"), ("reasoning-end", None), ("text-start", None), ("text-delta", "c"), ("reasoning-start", None), ("reasoning-delta", "d"),
        ("reasoning-end", None), ("text-delta", "e"), ("text-end", None), ("intent", "i"), ("text-start", None), ("text-delta", "f"), ("reasoning-start", None), ("reasoning-delta", "g"), ("reasoning-end", None), ("text-end", None),
    ]
    assert machine.ended and machine.n == len(got)


def test_blocks_stay_open_between_micro_batches(spark):
    events = B.conversation_events(table(spark, SF, "conversations").where("conv_id < 30"))
    want = []
    for conv in {r["conv_id"] for r in events.collect()}:
        machine = B.Machine()
        want += [(conv, *f) for r in events.where(F.col("conv_id") == conv).orderBy("seq").collect() for f in machine.event(r["kind"], r["part"])]
    got = E.drain(B.frames(E.sliced(events, F.least(F.floor(F.col("seq") / 4), F.lit(4)), 5, "conv_id"), "conv_id"), "t", "append")
    assert sorted(map(tuple, got.collect())) == sorted(want)


class _Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.timers, self.held = [], _Held()

    def getValueState(self, name, schema):
        return self.held

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at


def test_idle_streams_ping():
    import pandas as pd

    blocks, handle = B._Blocks("id", B.IDLE_MS), _Handle()
    blocks.init(handle)
    rows = pd.DataFrame({"seq": [1, 0], "kind": ["text", "status"], "part": ["a", "s"]})
    assert pd.concat(blocks.handleInputRows((7,), iter([rows]), _Now(1000)))["frame"].tolist() == ["status", "text-start", "text-delta"]
    assert handle.timers == [9000]
    assert pd.concat(blocks.handleExpiredTimer((7,), _Now(9000), None))[["n", "frame"]].to_numpy().tolist() == [[3, "ping"]]
    assert handle.timers == [17000]
    list(blocks.handleInputRows((7,), iter([pd.DataFrame({"seq": [2], "kind": ["end"], "part": [None]})]), _Now(9500)))
    assert handle.timers == [] and list(blocks.handleExpiredTimer((7,), _Now(17000), None)) == []


# --- tokens ---------------------------------------------------------------------


def whole(text, thinking):
    """What is seen of a text that comes as one."""
    f = K.Filter(thinking)
    return _texts([*f.chunk(text), *f.end()])


def _texts(parts):
    out = {}
    for kind, text in parts:
        out[kind] = out.get(kind, "") + text
    return out


MARKS = st.lists(st.sampled_from([K.OPEN, K.CLOSE, *K.STOPS, "<", "<think", "|im_end|>", "<|im", "a", "é b", "</", ">"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None, derandomize=True, database=None)
@given(MARKS, st.lists(st.integers(1, 6), max_size=40), st.booleans())
def test_cuts_do_not_matter(text, sizes, thinking):
    f, parts, at = K.Filter(thinking), [], 0
    for n in [*sizes, len(text)]:
        parts += f.chunk(text[at : at + n])
        at += n
        f = K.Filter(thinking, K.STOPS, *f.state())
    assert _texts([*parts, *f.end()]) == whole(text, thinking)


def test_filter_on_known_texts():
    assert whole("a<think>b</think>c<|im_end|>d", False) == {"answer": "ac"}
    assert whole("a<think>b<|im_end|>c", False) == {"answer": "a"} and whole("a<thin", False) == {"answer": "a<thin"}
    assert whole("b</think>c<think>d", True) == {"thinking": "b", "answer": "c<think>d"}
    assert whole("b<|im_end|>", True) == {"thinking": "b<|im_end|>", "error": K.EXHAUSTED} and whole("", True) == {}


def test_held_text_is_no_longer_than_a_mark():
    rng, f = np.random.default_rng(1), K.Filter()
    for _ in range(500):
        list(f.chunk("".join(rng.choice(list("<thinkim_|/>"), 5))))
        assert len(f.held) < max(map(len, (K.OPEN, *K.STOPS)))


def test_streams_of_a_bucket_share_a_call_and_a_state(spark):
    import pandas as pd

    tokens, handle = K._Tokens(False, K.STOPS), _Handle()
    tokens.init(handle)
    first = pd.DataFrame({"of": ["a", "b", None, "a"], "seq": [1, 0, 0, 0], "chunk": ["y<th", "p", "n", "x"], "last": [False, False, True, False]})
    assert sorted(pd.concat(tokens.handleInputRows((0,), iter([first]), None))["part"]) == ["n", "p", "x", "y"]
    then = pd.DataFrame({"of": ["a", None, "b"], "seq": [2, 1, 1], "chunk": ["ink>no", "late", "<|im_end|>no"], "last": [True, True, True]})
    assert list(tokens.handleInputRows((0,), iter([then]), None)) == []
    blocks, handle = B._Shared(), _Handle()
    blocks.init(handle)
    for seq, want in ((0, [0, 1] * 2), (1, [2, 2])):
        rows = pd.DataFrame({"of": ["a", "b"], "seq": [seq, seq], "kind": ["text", "text"], "part": ["s", "t"]})
        assert sorted(pd.concat(blocks.handleInputRows((0,), iter([rows]), None))["n"]) == sorted(want)
    assert len(handle.held.value[0]) == 2
