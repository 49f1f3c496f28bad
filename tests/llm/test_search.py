"""License scans, lexical search and hard negatives, against plain versions."""

import collections
import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, lexical_search, licenses, queries
from tessera.llm.license_rules import BASE, Rule, read_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, rank string, words string"

# --- licenses ---------------------------------------------------------------


def plain_licenses(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    joined, spans = " ".join(words), []
    for n, rule in enumerate(rules):
        for m in re.finditer(licenses.whole(rule.pattern), joined):
            start = joined[: m.start()].count(" ")
            spans.append((start, start + m[0].count(" ") + 1, rule.level, n))
    within = lambda a, b: b[0] <= a[0] and b[1] >= a[1]
    beats = lambda b, a: (b[2], a[1] - a[0] - b[1] + b[0], b[3]) < (a[2], 0, a[3])
    kept = sorted((a for a in spans if not any(within(a, b) and beats(b, a) for b in spans)), key=lambda s: (s[0], -s[1], s[2], s[3]))
    base = [s for s in spans if BASE.get(rules[s[3]].pattern) == rules[s[3]].label]
    starts, names = [s[0] for s in base], lambda x: {rules[s[3]].label for s in x}
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names(base))), ",".join(sorted(names(base) | names(kept))),
        max((licenses.WEIGHTS[s[2] - 1] for s in kept), default=0.0), ",".join(f"{rules[s[3]].label}:{s[0]}:{s[1]}" for s in kept),
    )


LICENSED = [
    None, "", "no license here?", "Released under the MIT License.", "MIT  LICENSE\tmit-license, mit license", "summit license; mit licenses; mit\nlicense",
    "GNU Lesser General Public License, version 2.1, GNU General Public License", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Foo-1.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0",
    "under CC BY-NC 4.0 and Creative Commons Attribution-ShareAlike 4.0 International. All rights reserved.", "MİT license ÅPACHE LICENSE apache license é", "BSD-3-Clause license or the new BSD license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit license " * 3000, "word " * 50_000 + "general public license", "x" * 200_000 + " mit license",
]


def test_licenses_agree_with_a_plain_scan(spark):
    rules = read_rules()
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(LICENSED)] + [(None, "mit license", None, None, None), (3, LICENSED[3], "x", "y", "z")]
    got = licenses.find_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(r[0], *plain_licenses(r[1], rules)) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert licenses.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_spans_within_stronger_ones_go(spark):
    rng = np.random.default_rng(5)
    rules = [Rule("a", int(rng.integers(1, 5)), f"l{i % 7}", " ".join("abc"[rng.integers(3)] for _ in range(rng.integers(1, 5))).replace("b", "a")) for i in range(25)]
    rules = list({r.pattern: r for r in rules}.values()) + [Rule("mit", 4, "mit", "mit license"), Rule("apache", 4, "apache", "apache license"), Rule("general", 4, "gpl", "general public license")]
    texts = [" ".join("aac"[rng.integers(3)] for _ in range(n)) for n in (0, 1, 5, 40, 300, 700)]
    got = licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    assert sorted(map(tuple, got)) == [(i, *plain_licenses(t, rules)) for i, t in enumerate(texts)]


def test_hundreds_of_rules_each_with_its_keyword():
    rules = read_rules()
    assert len(rules) > 200 and {r.pattern: r.label for r in rules if r.pattern in BASE} == BASE

    @settings(max_examples=3, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck), database=None)
    @given(st.data())
    def holds(data):
        for rule in rules:
            assert rule.keyword in data.draw(st.from_regex(rule.pattern.replace("[^ ]", "[a-z]"), fullmatch=True)), rule

    holds()
    with pytest.raises(ValueError):
        read_rules("[a]\n9 x a")


# --- lexical search -----------------------------------------------------------


def plain_search(docs, items, k=10):
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
    counts = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), collections.Counter(t for c in counts for t in c)
    out = []
    for key, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            m = 25 + (75 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(key, rank + 1, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scored)[:k])]
    return out


def searched(spark, docs, items, k=10):
    got = lexical_search.search(spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def texts_and_items(n=400, seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 300)}"
    return [(int(i), " ".join(word() for _ in range(rng.integers(0, 60)))) for i in rng.permutation(n)], [(i, " ".join(word() for _ in range(rng.integers(0, 25)))) for i in range(40)]


def test_search_agrees_with_all_scores(spark):
    docs, items = texts_and_items()
    docs += [(None, "w1 w2 w2"), (1000, None), (1001, ""), (1002, "É-Ünï, İ w2"), (1003, "w1 " * 20_000), (1004, docs[0][1]), (1004, docs[0][1]), (1005, "y" * 100_000)]
    items += [(50, None), (51, "é ünï ünï İ"), (52, "none of these"), (53, "W1 w1 w1"), (53, "W1 w1 w1"), (None, "w2 w3"), (54, "w1 " * 700)]
    assert searched(spark, docs, items) == sorted(plain_search(docs, items), key=repr)
    assert searched(spark, docs, items, 3) == sorted(plain_search(docs, items, 3), key=repr)


def test_search_in_small_blocks_pieces_and_sets(spark, monkeypatch):
    docs, items = texts_and_items(150, 2)
    want = sorted(plain_search(docs, items), key=repr)
    own = lexical_search.count_terms
    data, offsets = lexical_search.buffers(pa.array([t for _, t in docs]))
    asked = lexical_search.Items([0], [" ".join(t for _, t in docs)]).hash
    whole = own(data, offsets, asked)
    monkeypatch.setattr(lexical_search, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, own(data, offsets, asked)))
    monkeypatch.setattr(lexical_search, "SET_TERMS", 300)
    assert searched(spark, docs, items) == want


def test_blocks_that_are_halved_find_the_same():
    docs, items = texts_and_items(700, 3)
    own = lexical_search.Items([k for k, _ in items], [t for _, t in items])
    data, offsets = lexical_search.buffers(pa.array([t for _, t in docs]))
    n, doc, term, tf = lexical_search.count_terms(data, offsets, own.hash)
    by, found = np.lexsort((doc, term)), []
    for most in (96 << 20, 200_000):
        lexical_search.BLOCK_BYTES, before = most, lexical_search.BLOCK_BYTES
        searcher = lexical_search.Searcher(own, np.full(len(own.hash), 7), 700, int(n.sum()), 10)
        searcher.block(np.arange(700), np.zeros(700, bool), n, doc[by], term[by], tf[by])
        lexical_search.BLOCK_BYTES = before
        found.append([tuple(x.tolist() for x in best) for best in searcher.best])
    assert found[0] == found[1]


@pytest.mark.parametrize("seed", range(4))
def test_first_k_of_slices(seed):
    rng = np.random.default_rng(seed)
    value = rng.integers(0, (1, 3, 50, 1 << 40)[seed], (5, 200)) * (rng.random((5, 200)) < 0.6)
    sums = np.zeros((41, 5, 4), np.uint64)
    for b in range(41):
        bits = np.zeros((5, 256), np.uint8)
        bits[:, :200] = (value >> b) & 1
        sums[b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    got = {i: sorted(zip((-s).tolist(), p.tolist())) for i, p, s in lexical_search.first_k(sums, 10)}
    for i in range(5):
        assert got.get(i, []) == sorted((-int(v), p) for p, v in enumerate(value[i]) if v > 0)[:10]


def test_search_of_empty_tables(spark):
    docs, items = texts_and_items(5)
    assert searched(spark, [(1, None)], items) == [] and searched(spark, [(1, "w1")], [(1, "")]) == []
    assert lexical_search.search(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- hard negatives -----------------------------------------------------------

ROWS = "vec_id long, embedding array<float>, label int, pivot string, key string"


def plain_negatives(rows, every, share=80):
    used = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score, out = lambda a, b: sum(x * y for x, y in zip(a, b)), []
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, label, v in dict.fromkeys((i, label, tuple(v)) for i, label, v in used if i is not None and i % every == 0):
        ranked = sorted(((score(v, w), i, own == label) for i, own, w in used), key=place)
        for p, i, _ in [x for x in ranked if x[2] and x[1] != a][:5]:
            fits = [x for x in ranked if not x[2] and share * p <= 100 * x[0] <= 100 * p][:5]
            out += [(a, i, rank + 1, j, p, s) for rank, (s, j, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, rows, every):
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], ROWS).repartition(4)
    return sorted(map(tuple, hard_negatives.mine(df, every=every).collect()), key=repr)


def vectors(n, seed, width=12, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    own = rng.integers(0, groups, n)
    return [(i, (centres[g] + rng.normal(size=width) * 0.5).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i, g in enumerate(own)]


def test_negatives_agree_with_all_scores(spark):
    rows = vectors(600, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [nan] * 12, 1), (1003, [-inf] * 12, 1), (1004, rows[0][1], None), (None, rows[0][1], 1), (None, rows[5][1], 2), (1010, [0.5, 0.25], 0), (1020, [], 1), (40, rows[40][1], rows[40][2]), (40, rows[3][1], 2)]
    rows += [(2000 + i, rows[7][1], i % 3) for i in range(60)]
    assert mined(spark, rows, 20) == plain_negatives(rows, 20)


def test_negatives_beyond_the_sample_and_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "RUN", 16)
    rows = vectors(500, 2)
    assert mined(spark, rows, 25) == plain_negatives(rows, 25)


def test_negatives_of_small_tables(spark):
    assert mined(spark, [(0, [1.0, 0.0], 1)], 10) == []
    assert mined(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], 10) == []
    assert mined(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 10) == []  # a positive below 0 has no band
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 10) == [(0, 1, 1, 2, 256 * 256, 256 * 230)]
    df = spark.createDataFrame([], ROWS)
    assert hard_negatives.mine(df).count() == 0 and hard_negatives.mine(df.where(F.lit(True)), every=3).columns[0] == "anchor_id"
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e20], 1, "", "")], ROWS)).count()


def test_scores_are_exact_whole_numbers():
    big = np.full((3, 4), (1 << 29) + 1, np.int64)
    space = hard_negatives.Space(4, 4 * ((1 << 29) + 1) ** 2, big)
    assert space.scores(big, big)[0, 0] == 4 * ((1 << 29) + 1) ** 2


# --- SQL ------------------------------------------------------------------------


def test_queries_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.01")
    if not folder.is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, str(folder))
        names = ", ".join(sorted(df.columns))
        assert sorted(map(repr, map(tuple, df.selectExpr(*names.split(", ")).collect()))) == sorted(map(repr, con.execute(f"select {names} from ({sql})").fetchall())), name
