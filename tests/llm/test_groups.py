"""Operators that bring rows together: chat formatting, near duplicates, substring dedup, packing, and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, near_dup, packing, secrets, substring_dedup, toxicity
from tessera.llm.shared import Scratch, Words, buffers, shingles

UPPER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{i}" for i in range(30_000))
EDGE = [
    (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one", None), (5, "One", "x"), (6, "same five words and more text", "x"), (7, "same five words and more text", "x"),
    (7, "same five words and more text", "x"), (8, LONG, "x"), (9, LONG + " tail", "x"), (10, "y" * 200_000, "x"), (11, "é 日本 \U0001f600 a b c", "x"),
]
SCHEMA = "doc_id long, text string, component_id string"


def word_sets(texts):
    out = {}
    for key, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        out[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def groups(sets):
    """Components by comparing all pairs."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def variants(rng, n_groups, size, words=60, vocabulary=500, spread=5):
    texts = []
    for _ in range(n_groups):
        base = [f"v{x}" for x in rng.integers(0, vocabulary, words)]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, spread)):
                own[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    return list(enumerate(texts))


# --- chat ---------------------------------------------------------------------

def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_texts_come_back_whole(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### User: hi", "\\\\", "#", "<", ":", "", "é\U0001f600", "a\nb\\", "?x", "x" * 50_000]
    rows = [(i, t, r, x) for i, x in enumerate(hard) for t, r in enumerate(("user", "assistant"))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 20) for t in range(3000)]
    rows += [(200, 0, None, None), (201, 0, "tool: \\", "x"), (202, 1, "user", "b"), (202, 1, "assistant", "a"), (202, None, "system", "first"), (203, 0, "user", "x"), (203, 0, "user", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.digest_conversations(chat_format.format_turns(df)).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(own)
    for conv, turns in own.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest([(a, b) for _, a, b in sorted(turns)]), conv
    assert got[100]["valid"] and got[0]["valid"] and not got[203]["valid"] and not got[201]["valid"] and not got[202]["valid"]
    assert chat_format.digest_conversations(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_template_reads_back_what_it_writes():
    t, rng = chat_format.Template(), np.random.default_rng(0)
    signs = ["\\", "#", "<", ":", "?", "/", "turn>", "\n", " ", "### User: ", "</turn>\n", "é"]
    for _ in range(500):
        turns = [(["user", "assistant", "system", "odd?role", ""][rng.integers(5)], "".join(rng.choice(signs, rng.integers(0, 8)))) for _ in range(rng.integers(1, 5))]
        text = "".join(x for r, s in turns for x, _ in t.segments(r, s))
        assert [(r, s) for r, s, _ in t.read_back(text)] == turns
    with pytest.raises(ValueError):
        t.read_back("### User: no end")


# --- near duplicates ------------------------------------------------------------

def test_superminhash_estimates_similarity_and_does_not_depend_on_order():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = values[:3000], values[1000:]
    both = near_dup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 3000), 2, 128)
    assert abs((both[0] == both[1]).mean() - 0.5) < 0.15
    assert np.array_equal(near_dup.superminhash(a[::-1].copy(), np.zeros(3000, np.int64), 1, 128)[0], both[0])
    one = near_dup.superminhash(a[:1], np.zeros(1, np.int64), 1, 128)[0]
    assert sorted(np.floor(one)) == list(range(128))


def test_near_duplicates_agree_with_all_pairs(spark):
    rng = np.random.default_rng(9)
    texts = variants(rng, 25, 12) + [(1000 + k, t) for k, t in EDGE_UNIQUE]
    sets = word_sets(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df).collect()}
    want = groups(sets)
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == want[k]) for k, r in got.items())


EDGE_UNIQUE = list({k: (k, t) for k, t, _ in EDGE}.values())


def test_near_duplicates_chain_through_unlike_documents(spark):
    """Each text is like the next, but not like its bucket's first: only the exact second step can join them."""
    base = [f"c{i}" for i in range(120)]
    texts = [(i, " ".join(base[i * 6 : i * 6 + 80])) for i in range(7)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == groups(word_sets(texts))


def test_near_duplicates_in_one_loose_group(spark):
    """Many copies of one text, about half of them too far from it: buckets that hold several components, blocks and salts of a few rows."""
    rng = np.random.default_rng(12)
    texts = variants(rng, 1, 150, words=90, spread=8) + [(500 + k, t) for k, t in variants(rng, 30, 2, words=40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    block, star = near_dup.BLOCK, near_dup.STAR
    near_dup.BLOCK, near_dup.STAR = 8, 16
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    finally:
        near_dup.BLOCK, near_dup.STAR = block, star
    want = groups(word_sets(texts))
    assert got == want and 5 < len(set(want.values())) < 190


def test_near_duplicates_of_one_id_with_several_texts(spark):
    base = [f"c{i}" for i in range(100)]
    a, b = " ".join(base[:40]), " ".join(base[50:])
    rows = [(5, a), (5, b), (7, a), (3, b), (9, "x " + a), (9, "x " + a), (11, "alone")]
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (7, 3), (3, 3), (9, 3), (11, 11)}


def test_near_duplicates_on_odd_rows(spark):
    df = spark.createDataFrame([*EDGE, (None, "no id at all in here", "x")], SCHEMA)
    rows = near_dup.near_duplicates(df).collect()
    assert len(rows) == len(EDGE) + 1
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[1] == 1 and got[2] == 2 and got[3] == 3 and got[5] == 4 and got[7] == 6 and got[9] == 8 and got[None] is None
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 10, 11]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 5000), (5000, 3000), (7, 7)]
    rows = near_dup.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "cc").collect()
    assert {r["node"]: r["component"] for r in rows} == {**dict.fromkeys(range(201), 0), **dict.fromkeys((1000, 3000, 5000), 1000)} and len(rows) == 204


def test_shingles_are_those_of_each_row():
    import pyarrow as pa

    texts = [t for _, t, _ in EDGE] + ["a b c d e a b c d e a b", "a b"]
    data, offsets = buffers(pa.array(texts))
    value, bound = shingles(Words(data, offsets), len(texts))
    sets = word_sets(list(enumerate(texts)))
    assert np.diff(bound).tolist() == [len(sets[i]) for i in range(len(texts))]


# --- substring dedup --------------------------------------------------------------

def words_of(rng, n):
    return [f"r{x}" for x in rng.integers(0, 5000, n)]


def test_repeated_passages_exact_and_fuzzy(spark):
    rng = np.random.default_rng(12)
    passage, fuzzy, short = words_of(rng, 60), words_of(rng, 90), words_of(rng, 30)
    docs = [words_of(rng, 200) for _ in range(30)]
    for i in (3, 8, 21):
        docs[i][50:50] = passage
    changed = list(fuzzy)
    for at in (20, 41, 62):
        changed[at] = "zz"
    del changed[70]
    docs[5][10:10], docs[6][100:100] = fuzzy, changed
    docs[10][5:5], docs[11][5:5] = short, short
    docs += [docs[0], docs[0]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(100, None), (101, ""), (102, "a b"), (103, " ".join(docs[1])), (103, " ".join(docs[1])), (None, " ".join(docs[2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seed", F.lit("clash"))
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {3, 8, 21, 5, 6, 0, 30, 31, 1, 103}
    assert {got[i]["class_id"] for i in (3, 8, 21)} == {3} and {got[i]["class_id"] for i in (5, 6)} == {5} and got[31]["class_id"] == 0
    for i in (3, 8, 21):
        lo, hi = map(int, got[i]["spans"].split(":"))
        assert 48 <= lo <= 50 and 110 <= hi <= 112
    assert got[6]["least_share"] < 1 and got[0]["spans"] == "0:200"
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_salted_seeds_give_the_same_documents(spark):
    rng = np.random.default_rng(3)
    passage = words_of(rng, 60)
    rows = [(i, " ".join(words_of(rng, 40) + passage + words_of(rng, 20))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.repeated_passages(df, substring_dedup.Settings(sample=2, hot=5, salts=4)).collect()
    assert len(got) == 120 and {r["class_id"] for r in got} == {0}


def test_passages_whose_seeds_have_several_leaders(spark):
    rng = np.random.default_rng(21)
    one, two, three = (words_of(rng, 20) for _ in range(3))
    own = [words_of(rng, 40) for _ in range(4)]
    docs = [own[0] + one + two, two + three + own[1], own[2] + one + two + three, one + two + three + own[3]]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {2, 3} and {r["class_id"] for r in got.values()} == {2}
    assert got[2]["spans"] == "40:100" and got[3]["spans"] == "0:60"
    # a part of the passage is known from a leader, the other part has another
    four = words_of(rng, 20)
    docs = [own[0] + one + two + three, four + own[1], own[2] + one + two + three + four, one + two + three + four + own[3]]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(df).collect()}
    assert set(got) == {0, 2, 3} and got[2]["spans"] == "40:120" and got[3]["spans"] == "0:80"


def test_no_link_is_lost_to_repeats_gaps_or_other_documents(spark):
    rng = np.random.default_rng(31)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    # every part of the passage stands many times in the second text before it stands there whole
    whole = fresh(64)
    parts = [whole[i : i + 16] for i in range(0, 64, 8)]
    docs = [fresh(30) + whole, [w for _ in range(20) for part in parts for w in part + fresh(30)] + whole + fresh(20)]
    # two passages far apart
    one, two = fresh(60), fresh(60)
    docs += [one + fresh(300) + two, one + fresh(300) + two]
    # what the last two share is known of each from another document
    left, right, middle = fresh(55), fresh(55), fresh(64)
    docs += [left + middle[:44] + fresh(40), fresh(40) + middle[20:] + right, left + middle + fresh(30), fresh(30) + middle + right]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["spans"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert got.get(0) == (0, "30:94") and got[1][0] == 0
    assert got.get(2) == got.get(3) == (2, "0:60,360:420")
    assert [got[i][0] for i in range(4, 8)] == [4] * 4


def test_chain_is_the_best_of_all_chains():
    rng, s = np.random.default_rng(8), substring_dedup.Settings()
    for _ in range(100):
        found = sorted({(int(x), int(y), 5) for x, y in rng.integers(0, 60, (rng.integers(1, 12), 2))})
        best = [0.0] * len(found)
        for i, (x, y, m) in enumerate(found):
            before = [best[j] - s.gap_cost * (x + y - found[j][0] - found[j][1] - 10) for j in range(i) if found[j][0] < x and found[j][1] < y]
            best[i] = m + max([0.0, *before])
        i = max(range(len(found)), key=lambda i: best[i])
        x0, x1, y0, y1 = substring_dedup.chain(found, s)[0]
        assert (x1, y1) >= (found[i][0] + 5, 0) and (x0, y0) <= (found[i][0], found[i][1])


def test_fuzzy_passages_are_found(spark):
    """Passages of 100 words inside unlike texts, by the share of changed words: nine in ten of those that the rule accepts."""
    rng = np.random.default_rng(21)
    fill = lambda: [f"f{x}" for x in rng.integers(0, 5000, 200)]
    rows, want = [], {}
    for rate in (0.08, 0.15, 0.2):
        for _ in range(40):
            base = [f"p{x}" for x in rng.integers(0, 5000, 100)]
            other = [f"n{rng.integers(10**7)}" if rng.random() < rate else w for w in base]
            if sum(a == b for a, b in zip(base, other)) >= 77:
                want[len(rows)] = rate
            rows += [(len(rows) + i, " ".join(fill() + x + fill())) for i, x in enumerate((base, other))]
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for rate in (0.08, 0.15, 0.2):
        own = [d for d, r in want.items() if r == rate]
        assert sum(d in got for d in own) >= 0.9 * len(own), rate


# --- packing ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))


def check_pieces(rows, texts, tokenizer, capacity=4096):
    """Every id lies in one piece, sequences are gapless and not too long. Returns padding / tokens."""
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts}
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(own) == set(ids)
    for k, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[k][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[k])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, ids.values()))


def test_packing_keeps_every_token(spark, tokenizer):
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"{'abcdefgh'[x % 8]}{x}" + ("." if x % 9 == 0 else "") for x in rng.integers(0, 900, rng.integers(1, 900)))) for i in range(150)]
    odd = [None, "", " ", "It's <|endoftext|> <|ENDOFTEXT|> a|b 'S x.'s", "é… naïve!? 日本。 x　y 12a3b", "word " * 30_000, "z" * 20_000, "no-end,of;sentence:here " * 3000, "A.B.C 'tis 'twas I'll we've 'd"]
    texts += [(1000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("start", F.lit("clash"))
    share = check_pieces(packing.pack(df.coalesce(1)).collect(), texts, tokenizer)
    assert share < 0.02
    check_pieces(packing.pack(df.repartition(3), packing.Settings(segment=9000)).collect(), texts, tokenizer)
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(df.where("doc_id = 3").unionAll(df.where("doc_id = 3"))).agg(F.sum("length")).first()[0]
    assert twice == 2 * packing.pack(df.where("doc_id = 3")).agg(F.sum("length")).first()[0]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    s = packing.Settings(capacity=16, sequence_cost=2)
    for _ in range(200):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 9, rng.integers(1, 12)))])
        penalty = rng.integers(0, 6, len(bounds))
        cost = lambda a, b: 0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)
        f = [0.0] + [1e9] * (len(bounds) - 1)
        for j in range(1, len(bounds)):
            f[j] = min(f[i] + cost(bounds[i], bounds[j]) for i in range(j) if bounds[j] - bounds[i] <= 16) + penalty[j] + 2
        cuts = packing.best_cuts(bounds, penalty, s)
        total = sum(cost(bounds[a], bounds[b]) + penalty[b] + 2 for a, b in zip(cuts, cuts[1:]))
        assert total == f[-1] and cuts[0] == 0 and cuts[-1] == len(bounds) - 1


# --- pipeline ------------------------------------------------------------------------

def test_pipeline_agrees_with_plain_versions_of_its_stages(spark, tokenizer, tmp_path):
    rng = np.random.default_rng(20)
    vocabulary = [f"{a}{b}" for a in ("lor", "ip", "dol", "am", "con", "sec") for b in ("em", "um", "or", "et", "ur", "te", "ad", "is", "it", "li")]
    text = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    items = [text(30) for _ in range(5)]
    docs = [(i, text(80)) for i in range(900)]
    docs = [(i, t + (" you vile scum, vile scum" if i % 8 == 1 else "")) for i, t in docs]
    docs += [(1000, docs[0][1]), (1001, docs[2][1] + " and"), (1002, text(50) + " " + items[0] + " " + text(9)), (1003, "password=abcdef123456 " + text(60)), (1004, None), (1005, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 1)) for i in range(900)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, t) for i, t in docs if "vile scum" not in (t or "")]
    same = groups(word_sets(left))
    left = [(i, t) for i, t in left if same[i] == i and items[0] not in (t or "")]
    left = [(i, (t or "").replace("password=abcdef123456", "[SECRET]")) for i, t in left]
    assert {1000, 1001, 1002} & {i for i, _ in left} == set() and 1003 in dict(left)
    check_pieces(rows, left, tokenizer)
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_now, str(tmp_path)).columns == docs_now.columns
    empty = stage_input = docs_now.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stage_input, str(tmp_path)).count() == 0 and empty is stage_input
