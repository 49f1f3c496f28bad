"""The engine's operators, held against plain Python on small tables, and its queries against DuckDB."""

import decimal
import math
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import geo, intent, names
from tessera.functions import text as T
from tessera.operators import mentions, retrieval, rollups, spatial, tables
from tessera.sources import files, markdown

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def windows(n, size, overlap):
    out, at = [], 0
    while n:
        out.append(at)
        if at + size >= n:
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 9, 10, 11])
def test_windows_reach_the_end(spark, n):
    text = " ".join(map(str, range(n)))
    got = one(spark, text, lambda c: T.token_windows(c, 5, 2))
    assert got == [" ".join(map(str, range(s, min(s + 5, n)))) for s in windows(n, 5, 2)]
    with pytest.raises(ValueError):
        T.token_windows(F.col("text"), 3, 3)


def test_parent_windows_join_a_short_tail(spark):
    text = " ".join(map(str, range(26)))
    got = one(spark, text, lambda c: T.parent_windows(c, whole=15, size=12, overlap=2, least=10))
    own = text.split()
    assert got == [" ".join(own[:12]), " ".join(own[10:22] + own[20:])]
    assert one(spark, "a b", T.parent_windows) == ["a b"] and one(spark, "", T.parent_windows) == []


def test_child_packing_is_that_of_a_loop(spark):
    units = [" ".join(["w"] * k) for k in (5, 3, 4, 6, 2, 9, 1, 1)]

    def loop(most, carry, least):
        done, now = [], []
        for u in units:
            if now and len(" ".join([*now, u]).split()) > most:
                done.append(" ".join(now))
                now = now[-carry:]
            now.append(u)
        done += [" ".join(now)] if now else []
        out = []
        for c in done:
            if out and len(c.split()) < least:
                out[-1] += " " + c
            else:
                out.append(c)
        return out

    df = spark.createDataFrame([(units,)], "u array<string>")
    for most, carry, least in ((10, 2, 1), (12, 2, 8), (8, 1, 4), (100, 2, 5)):
        assert df.select(T.pack_units(F.col("u"), most, carry, least).alias("x")).first()["x"] == loop(most, carry, least)


def test_small_text_functions(spark):
    assert one(spark, "one. Two!  three?\nfour", T.sentences) == ["one.", "Two!", "three?", "four"]
    assert one(spark, "exam-\n ple a-b", T.clean_ocr) == "example a-b"
    assert one(spark, "x [Page 5] [page  0] [PAGE 3]", T.page_markers) == [5, 3]
    assert one(spark, "none", lambda c: T.marker_range(c)[0]) is None
    assert one(spark, "a/b/x (1).final.pdf", T.source_id) == "x_1_final" and one(spark, "??.txt", T.source_id) == "uploaded_doc"
    assert one(spark, "see [3] and [4, p. 7] [x]", T.citation_marks) == [3, 4]
    assert one(spark, "a/b c", T.safe_file_name) != "a/b c" and one(spark, "ok-1.txt", T.safe_file_name) == "ok-1.txt"


def test_markdown_paths(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# A\nx\n## B\ny\n### C\nz\n## D\n# E\n")
    got = {r["section"]: (r["path"], r["body"]) for r in markdown.read(spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(6)] == ["Document", "A", "A > B", "A > B > C", "A > D", "E"]
    assert got[2][1] == "## B\ny"


def test_certain_acts_have_ascii_word_ends(spark):
    texts = ["list all of Von der. En\u00e4 die\u00dfbe der", "list all of Von der. En\u00e4 edie\u00dfbe der", "why\u000bdid Romeo kill", "why did Romeo kill", "why did Romeo \u00e4kill\u00e4 him", "Why did romeo kill him"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, asked string")
    assert [r["x"] for r in df.orderBy("i").select(intent.is_certain_act(F.col("asked")).alias("x")).collect()] == [True, False, False, True, True, False]


def test_most_shared_is_that_of_all_pairs(spark):
    own = lambda n, step: [(i, sorted({str((i * step + j * j) % (7 + j)) + "abc"[j % 3] for j in range(i % 9)})) for i in range(n)]
    asked, rows = own(40, 7) + [(3, ["1b", "x"])], own(150, 11) + [(5, ["0a"]), (149, ["0a", "1b"]), (200, ["none"])]
    q, r = spark.createDataFrame(asked, "q int, own array<string>"), spark.createDataFrame(rows, "k int, own array<string>")
    shared = {}
    for a, x in asked:
        for b, y in rows:
            shared[a, b] = shared.get((a, b), 0) + len(set(x) & set(y))
    want = {(a, b, n) for a in {a for a, _ in asked} for n, b in sorted(((n, b) for (c, b), n in shared.items() if c == a and n), key=lambda x: (-x[0], x[1]))[:6]}
    want = {(a, b, shared[a, b]) for a, b, _ in want}
    assert {(x["q"], x["k"], x["shared"]) for x in retrieval.most_shared(q, "q", r, "k", 6).collect()} == want


def test_most_shared_sends_no_exploded_rows_through_the_driver(spark):
    rng = random.Random(4)
    own = lambda n, keys: [(key, rng.sample("abcdefghij", rng.randint(0, 6))) for key in keys(n)]
    asked, rows = own(30, range) + [(None, ["a", "b"])], own(400, lambda n: range(0, 3 * n, 3)) + [(-1, None), (3, ["a"]), (None, ["c"])]
    got = retrieval.most_shared(spark.createDataFrame(asked, "q long, own array<string>"), "q", spark.createDataFrame(rows, "k long, own array<string>"), "k", 5)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    shared = {}
    for a, x in asked:
        for b, y in rows:
            shared[a, b] = shared.get((a, b), 0) + len(set(x) & set(y or ()))
    want = {(a, b, shared[a, b]) for a, _ in asked for b in sorted({b for b, _ in rows if shared[a, b]}, key=lambda b: (-shared[a, b], b is not None, b))[:5]}
    assert {(x["q"], x["k"], x["shared"]) for x in got.collect()} == want


def test_shared_members_of_small_parts_are_those_of_all(monkeypatch):
    import pyarrow as pa

    from tessera.operators import shared_members

    monkeypatch.setattr(shared_members, "ROWS", 64)
    rng = random.Random(1)
    own = lambda: [str(x) for x in rng.sample(range(40), rng.randint(0, 9))]
    asked, rows = [(i, own()) for i in range(50)], [(i * 3, own()) for i in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 37]], pa.int64()), pa.array([x for _, x in rows[i : i + 37]], pa.list_(pa.string()))], names=["k", "own"]) for i in range(0, 500, 37)]
    got = [r for block in shared_members.blocks(iter(asked), 17) for b in shared_members.best(iter(batches), block, 4, ["q", "k", "n"]) for r in b.to_pylist()]
    want = [(q, k, n) for q, x in asked for n, k in sorted(((len({*x} & {*y}), k) for k, y in rows), key=lambda x: (-x[0], x[1]))[:4] if n]
    assert sorted((r["q"], r["k"], r["n"]) for r in got) == sorted(want)


def test_islands_do_not_depend_on_the_order_of_equal_spans(spark):
    spans = [(u, lo, lo + 15) for u in range(3) for lo in (0, 0, 0, 15, 31, 31, 47, 47, 47, 62)]
    df = spark.createDataFrame(spans[::2] + spans[1::2], "u int, lo int, hi int").repartition(3)
    got = sorted((r["u"], r["lo"], r["hi"], r["spans"]) for r in rollups.islands(df, ["u"], "lo", "hi").collect())
    assert got == [x for u in range(3) for x in ((u, 0, 30, 4), (u, 31, 46, 2), (u, 47, 77, 4))]


def test_spans_without_bounds_come_last(spark):
    df = spark.createDataFrame([(1, None, None), (1, 0, 15), (1, 40, 55), (1, None, None), (2, None, None), (2, None, None), (None, 3, 18)], "u int, lo int, hi int").repartition(3)
    got = sorted(((r["u"], r["lo"], r["hi"], r["spans"]) for r in rollups.islands(df, ["u"], "lo", "hi").collect()), key=str)
    assert got == sorted([(1, 0, 15, 1), (1, 40, 55, 3), (2, None, None, 1), (2, None, None, 1), (None, 3, 18, 1)], key=str)


def test_threshold_keeps_a_safety_net(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.6, 0.2, 0.1), 1)] + [(2, 1, 0.9), (2, 2, 0.8), (2, 3, 0.7), (2, 4, 0.6)], "q int, rank int, score double")
    got = {(r["q"], r["rank"]): r["below_threshold"] for r in retrieval.threshold(df, "q", 0.5, 3).collect()}
    assert got == {(1, 1): False, (1, 2): False, (1, 3): True, (2, 1): False, (2, 2): False, (2, 3): False, (2, 4): False}


def test_greedy_packing_is_that_of_a_loop(spark):
    sizes = [60, 50, 10, 300, 5, 40]

    def loop(budget):
        used = skipped = 0
        out = []
        for i, n in enumerate(sizes):
            left = budget - used
            take = n if n <= left else math.floor(left * 0.8) if left >= 50 else 0
            if take:
                out.append((i, take, n > left))
                used += take
                continue
            skipped += 1
            if left < 50 or skipped > len(sizes) // 2:
                break
        return out

    df = spark.createDataFrame([(1, i + 1, i, n) for i, n in enumerate(sizes)], "q int, rank int, k int, n int")
    for budget in (10, 100, 170, 200, 1000):
        rows = retrieval.pack_greedy(df, "q", "k", F.col("n"), budget).orderBy("place").collect()
        assert [(r["k"], r["tokens"], r["cut"]) for r in rows] == loop(budget)


def test_top_per_parent_keeps_rows_without_one(spark):
    df = spark.createDataFrame([("a", 3), ("a", 2), ("a", 1), (None, 0), (None, 9), ("b", 5)], "parent string, s int")
    got = retrieval.top_per_parent(df, "parent", 2, [F.desc("s")]).select("parent", "s").collect()
    assert sorted((r["parent"] or "", r["s"]) for r in got) == [("", 0), ("", 9), ("a", 2), ("a", 3), ("b", 5)]


def test_tables_change_by_version(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"]).collect() if r["n"] is not None or r["k"] > 1) == [(1, "a", 1), (2, "B", None), (3, "C", None)]
    assert sorted(tuple(r) for r in tables.patch(old, spark.createDataFrame([(1, ""), (9, "z")], "k int, v string"), ["k"]).collect() if r["k"] != 9) == [(1, "", 1), (2, "b", 2)]
    path = str(tmp_path / "t")
    tables.publish(spark, old, path, 1)
    tables.publish(spark, tables.delete(tables.current(spark, path), F.col("k") == 1), path, 2)
    assert [r["k"] for r in tables.current(spark, path).collect()] == [2]
    with pytest.raises(ValueError):
        tables.mentions(old, min_confidence=2)
    assert old.where(tables.any_of(F.col("k"), [])).count() == 0


def test_nearest_is_that_of_all_pairs(spark):
    a = [(i, (i * 37 % 18) * 10 - 90.0, (i * 73 % 36) * 10 - 180.0) for i in range(80)] + [(80, None, 3.0), (81, 89.9, 179.9)]
    b = [(i, (i * 11 % 5) - 2.0, (i * 29 % 7) + 170.0) for i in range(70)] + [(70, -89.0, 0.0), (71, None, None)]
    points, places = (spark.createDataFrame(x, "id int, lat double, lon double") for x in (a, b))
    sink = lambda x, y: math.sqrt(min(1.0, math.sin(math.radians(y[1] - x[1]) / 2) ** 2 + math.cos(math.radians(x[1])) * math.cos(math.radians(y[1])) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2))
    far = lambda x, y: math.inf if x[1] is None or y[1] is None else round(2 * 6371.0 * math.asin(sink(x, y)), 6)
    want = {(p[0], r): q[0] for p in a for r, q in enumerate(sorted(b, key=lambda q: (far(p, q), q[0]))[:3], 1)}
    assert {(r["id"], r["rank"]): r["p_id"] for r in spatial.nearest(points, places, "id", "id", 3).collect()} == want
    few = spatial.nearest(points, places.where("id > 69"), "id", "id", 3)
    assert few.count() == 2 * len(a) and few.where("id = 3 AND p_id = 71").first()["rank"] == 2
    # each row of a spot meets what the spot meets
    assert spatial.radius_join(places.withColumn("n", F.lit(1)), places, 500.0).where("id % 35 = p_id % 35").count() == 70 * 2 + 1


def test_radius_join_finds_all_pairs(spark):
    a = [(i, (i * 37 % 180) - 90.0, (i * 73 % 360) - 180.0) for i in range(60)]
    b = [(i, (i * 11 % 180) - 90.0, (i * 29 % 360) - 180.0) for i in range(60)]

    def km(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * geo.RADIUS_KM * math.asin(min(1, math.sqrt(x)))

    for r in (300.0, 2500.0):
        df = [spark.createDataFrame(x, "id int, lat double, lon double") for x in (a, b)]
        assert {(x["id"], x["p_id"]) for x in spatial.radius_join(*df, r).collect()} == {(p[0], q[0]) for p in a for q in b if km(p, q) <= r}


def test_rollups(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 9, 12), (2, 0, 1)], "k int, lo int, hi int")
    assert sorted(tuple(r) for r in rollups.islands(df, ["k"], "lo", "hi").collect()) == [(1, 0, 8, 2), (1, 9, 12, 1), (2, 0, 1, 1)]
    text = spark.createDataFrame([(1, "a b c a b c A B c"), (2, "a b c d"), (3, None)], "k int, text string")
    assert {r["k"]: r["repeats"] for r in rollups.repeating(text, "k", 3, 3).collect()} == {1: True, 2: False, 3: False}


QUESTIONS = (
    ("What is this text about?", "OVERVIEW"), ("Summarise the main findings", "SUMMARIZE"), ("Explain it in plain words", "EXPLAIN"), ("Contrast the two theories", "COMPARE"),
    ("TL;DR", "SUMMARIZE"), ("How does reinforcement shape habits?", "ANALYZE"), ("Who wrote the preface?", "FACTUAL"), ("How many chapters are there?", "FACTUAL"),
    ("What is phonology?", "FACTUAL"), ("Extract all dates and names", "EXTRACT"), ("Create a timeline of the war", "TIMELINE"), ("How to bake bread step by step", "HOW_TO"),
    ("Quote the passage verbatim", "QUOTE_EVIDENCE"), ("Which of these files is a review of Hamlet?", "COLLECTION"), ("Summarize all documents", "COLLECTION"), ("whic documnt is abuot bees", "COLLECTION"),
    ("Why does Juliet drink the poison?", "FACTUAL"), ("why is the theory hard", "ANALYZE"), ("Critique of Jones in light of new data", "COMPARE"), ("Smith's critique of Jones", "ANALYZE"), ("hmm", "OVERVIEW"), ("", "OVERVIEW"), (None, "OVERVIEW"),
)


def test_intents(spark):
    df = spark.createDataFrame([(i, q, w) for i, (q, w) in enumerate(QUESTIONS)], "i int, asked string, want string").withColumn("q", intent.correct_typos("asked"))
    rows = intent.classify(df, "q", original="asked", floor=None).orderBy("i").collect()
    assert [(r["asked"], r["intent"]) for r in rows] == list(QUESTIONS)
    assert all(0 <= r["confidence"] <= 1 for r in rows) and rows[-1]["method"] == "fallback"
    gated = intent.classify(df, "q", original="asked").orderBy("i").collect()
    assert all(r["intent"] == "OVERVIEW" and r["method"].endswith("overview_fallback") for r in gated if r["confidence"] < 0.6)
    manual = intent.override(intent.classify(df, "q"), F.lit("summarise")).collect()
    assert {(r["intent"], r["confidence"], r["method"]) for r in manual} == {("SUMMARIZE", 1.0, "manual")}
    low = [("la la la", True), ("foo bar", True), ("", True), (None, True), ("what is this text", False), ("Summarise the findings", False), ("ELI5", False)]
    picks = [("Which of thse docs covers bees", True), ("What source discusses risks?", True), ("Summarise this paper", False), ("", False)]
    assert [one(spark, q, intent.is_low_information) for q, _ in low] == [w for _, w in low]
    assert [one(spark, q, lambda c: intent.is_source_selection(intent.correct_typos(c))) for q, _ in picks] == [w for _, w in picks]


def test_names(spark):
    cases = [(" Dr.  Prof. Ada   Byron, ", "ada byron"), ("Rev.", ""), ("", ""), (None, ""), ("Sirius Black", "sirius black"), ("(Lady) Anne", "anne")]
    assert [one(spark, raw, names.normalize_name) for raw, _ in cases] == [w for _, w in cases]
    assert one(spark, "Rev.", names.display_form) == "Rev."


def test_mentions_and_sources(spark):
    rows = [(1, "s", "Ada", "Ada B."), (2, "s", "Ada Byron", "Ada B."), (3, "t", "Ada", "Ada B."), (4, "t", " ", "Ada B."), (5, None, "Bob", None)]
    df = spark.createDataFrame(rows, "id int, source_id string, raw_name string, canonical_name string")
    got = mentions.registry(df).collect()
    assert [(r["canonical_name"], r["mention_count"], list(r["sources"]), r["display"]) for r in got] == [("Ada B.", 3, ["s", "t"], "Ada Byron")]
    assert mentions.merge_canonical(df, "Ada B.", "A").where("rewritten").count() == 4 and mentions.merge_canonical(df, "x", " ").where("rewritten").count() == 0
    kept, errors = mentions.cascade_delete({"a": (df, "source_id"), "b": (df, "nothing")}, "s")
    assert kept["a"].count() == 3 and list(errors) == ["b"]
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.1])], "id int, v array<double>")
    assert mentions.append_children(df, df.where("id < 3"), vectors, "id").count() == 7
    with pytest.raises(ValueError):
        mentions.append_children(df, df, vectors, "id")
    assert mentions.registry(df.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, 0, 5, 0.5), (1, 4, 9, 0.9), (1, 9, 12, 0.1), (2, 0, 1, 0.3)], "k int, lo int, hi int, score double")
    assert sorted(tuple(r)[:3] for r in mentions.best_of_overlaps(spans, ["k"], "lo", "hi", "score").collect()) == [(1, 4, 9), (1, 9, 12), (2, 0, 1)]


def test_backfill_takes_sources_that_were_hit(spark):
    rows = [("q", 1, "a", 10), ("q", 2, "b", 10), ("q", 3, "a", 10), ("q", 4, "a", 500), ("q", 5, "a", 1), ("r", 1, "x", 10), ("r", 2, "y", 10), ("s", 1, "x", 900), ("s", 2, "x", 1)]
    df = spark.createDataFrame(rows, "q string, rank int, source string, n int")
    above = ((F.col("q") == "q") & (F.col("rank") == 1)) | ((F.col("q") == "s") & (F.col("rank") == 1))
    got = mentions.backfill(df, "q", "source", above, F.col("n"), 1000, 0.1, 0.2, 5).collect()
    assert sorted((r["q"], r["rank"], r["below_threshold"]) for r in got) == [("q", 1, False), ("q", 3, True), ("r", 1, True), ("r", 2, True), ("s", 1, False)]


def test_pages_of_binary_files_take_the_first_extractor_that_works(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\x0c\x0ctwo")

    def bad(content):
        raise ValueError("not mine")

    def pages(content):
        return iter(content.decode().split("\x0c"))

    got = files.read_pages(spark, str(tmp_path), [bad, pages]).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in got] == [(1, "one"), (3, "two")]


def test_oracles_agree(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    as_text = lambda x: f"{float(x):.9g}" if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else str(x)
    key = lambda rows: sorted(repr([as_text(x) for x in row]) for row in rows)
    wrong = []
    for name in catalog.oracle_sql():
        df = catalog.queries()[name](spark, SF)
        names = sorted(df.columns)
        want = con.execute(f"select {', '.join(names)} from ({catalog.oracle_sql()[name]})").fetchall()
        got, want = key(df.select(*names).collect()), key(want)
        if got != want:
            wrong.append((name, len(got), len(want), sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]))
    assert not wrong


def test_the_rest_works_without_the_optional_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    copy.mkdir()
    for path in [*root.glob("*.py"), *root.glob("tessera/**/*.py")]:
        relative = path.relative_to(root)
        if "llm" in relative.parts or relative.name == "corpus_pipeline.py":
            continue
        target = copy / relative
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(path.read_text())
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); assert 'rk14_search' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
