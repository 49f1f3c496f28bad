"""Clauses, signals, cuts and settings against plain versions; nulls and blanks."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.functions import output as O
from tessera.functions import settings as S
from tessera.functions import signal as A


def plain_clauses(text, most):
    words = text.split()
    if len(words) <= most:
        return [text]
    ends = [m.start() for m in re.finditer(r"(?i);\s+|,\s+(?:and|but|which|or)\s+", text)]
    if ends:
        middle = len(text) / 2
        at = sorted(ends, key=lambda e: (abs(e - middle), e))[0] + 1
    elif len(words) > int(most * 1.2):
        at = len(" ".join(words[: len(words) // 2]))
    else:
        return [text]
    left, right = text[:at].strip(), text[at:].strip()
    return plain_clauses(left, most) + plain_clauses(right, most) if left and right else [text]


def test_clauses_agree_with_recursion():
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "word", "x;", "y,", "and", "Which", "z, or", "long-word"]) for _ in range(rng.randint(1, 80)))
        assert A.clauses(text, 10) == plain_clauses(text, 10)
    assert len(A.clauses("w " * 200_000, 200)) >= 1000


def test_signals():
    tone = [0.2 if (i // 20) % 2 else -0.2 for i in range(4800)]
    assert A.is_voiced(tone) and not A.is_voiced(tone[:960]) and not A.is_voiced([0.0] * 4800) and not A.is_voiced(None) and not A.is_voiced([])
    assert list(A.without_silence(None)) == [] and len(A.without_silence([0.0] * 9)) == 0 and len(A.without_silence([0.0] * 9000 + [1.0])) == 1921


def test_numbers_of_the_environment():
    assert S.number_from(None, 2.0) == 2.0 and S.number_from("x", 2.0) == 2.0 and S.number_from("nan", 2.0) == 2.0
    assert S.number_from("9", 2.0, high=5) == 5 and S.number_from("-1", 2.0, low=0) == 0 and S.number_from("3.5", 2.0) == 3.5


def test_cuts_blocks_and_spans(spark):
    text = "One two. " * 60
    row = spark.createDataFrame([(text, None)], "t string, n string").select(
        O.cut_to_tokens(F.col("t"), 50).alias("a"), O.cut_to_tokens(F.col("t"), 500).alias("b"), O.cut_to_tokens(F.col("t"), 0).alias("c"), O.cut_to_tokens(F.lit("x" * 900), 50).alias("d"),
        F.size(O.passage_blocks(F.lit("none"))).alias("e"), F.size(E.places_in(F.col("n"))).alias("f"), E.person_like(F.col("n"), F.lit(False)).alias("g"), E.token_spans(F.lit(" ab  c ")).alias("h"), O.page_label(F.col("n"), F.col("n").cast("int")).alias("i"),
    ).first()
    assert row["a"] == ("One two. " * 22).rstrip() and row["b"] == text and row["c"] is None and row["d"] == "x" * 200
    assert row["e"] == 0 and row["f"] == 0 and not row["g"] and [tuple(s) for s in row["h"]] == [(1, 3), (5, 6)] and row["i"] == "Unknown page"


def test_equal_values_are_worked_out_once(spark):
    from tessera.operators.tables import of_each

    seen = spark.sparkContext.accumulator(0)

    def longer(x):
        seen.add(1)
        return None if x is None else x + 1

    rows = spark.createDataFrame([(i, None if i % 4 == 3 else i % 4) for i in range(400)], "id int, kind int")
    got = of_each(rows, ["kind"], lambda kinds: kinds.withColumn("n", F.udf(longer, "int")("kind"))).collect()
    assert len(got) == 400 and all(r["n"] == (None if r["kind"] is None else r["kind"] + 1) for r in got)
    assert seen.value == 4


def test_spans_leave_in_pieces_of_a_batch():
    import pyarrow as pa

    from tessera.functions import entities as E

    long = "ab  c " * 100_000
    out = list(E._spans.func(iter([pa.array([long, long, long, None, "", " x"], pa.string())])))
    assert len(out) == 3 and [len(s) for piece in out for s in piece.to_pylist()] == [200_000] * 3 + [0, 0, 1]
    assert out[0].to_pylist()[0][:2] == [{"start": 0, "end": 2}, {"start": 4, "end": 5}] and out[-1].to_pylist()[-1] == [{"start": 1, "end": 2}]


def test_trigrams_shuffle_no_texts(spark, capsys, monkeypatch):
    from tessera.operators import rollups as A

    rows = [(1, "a b c a b c a b c"), (2, "a b c a b c"), (2, "A b c"), (None, "x y z"), (None, "x y z x y z"), (3, None)]
    docs = spark.createDataFrame(rows, "k long, text string")
    want = [(1, "a b c", 3), (2, "a b c", 3), (None, "x y z", 3)]
    sort = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = A.repeated_trigrams(docs, "k", 3)
    found.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out and sort(found) == sorted(want, key=str)
    A.repeated_trigrams(docs.where("k = 1"), "k", 3).explain()
    assert "Join" not in capsys.readouterr().out
    monkeypatch.setattr(A, "MAX_SENT", 1)
    assert sort(A.repeated_trigrams(docs, "k", 3)) == sorted(want, key=str)


def test_names_of_texts_without_words_are_those_of_the_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__

    texts = ["", " ", "...", " . , ", "\n", None, "\x0b", "\x0bAbcd efgh", "Abcd\u2028 Efgh", "Abcd\x85", "One. Two, Table"]
    # each text alone in a file, so that every one is the first that a task sees
    for i, text in enumerate(texts):
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        pq.write_table(pa.table({"doc_id": pa.array([i], pa.int64()), "text": pa.array([text], pa.string()), "lang": ["de"]}), tmp_path / "documents.parquet" / f"{i}.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        for name in ("pf12_person_like", "pf14_place_candidates", "pf15_person_candidates", "ct02_joint_candidates"):
            want = sorted(c.execute(__spark_entry__.oracle_sql()[name]).fetchall())
            assert sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == want
