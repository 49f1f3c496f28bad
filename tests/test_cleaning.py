"""Clean-up of answers, places in raw texts, windows: against plain loops over the same tables."""

import difflib
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import cleaning as C
from tessera.plans import cleaning_queries as Q
from tessera.session import table

SF = "/root/testdata/sf0.01"


def plain_clean(text):
    if not text:
        return text
    for leaked in C.LEAKED:
        text = re.sub(rf"^\s*{leaked}.*$", "", text, flags=re.I | re.M)
    if len(text) > 200:
        text = re.sub(C.DENIAL, "", text).rstrip()
    for phrase in C.CHATTER:
        at = text.lower().rfind(phrase)
        if at != -1 and at > len(text) * 0.8:
            text = text[:at].rstrip()
    half = len(text) // 2
    a, b = text[:half].strip(), text[half:].strip()
    flat = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    if len(text) >= 200 and a and b and difflib.SequenceMatcher(None, flat(a), flat(b)).ratio() >= 0.85:
        text = a
    text = re.sub(C.REPEATED, r"\1", text)
    last = text.rstrip().split("\n")[-1]
    if re.search(C.INCOMPLETE, last) or (last and last[-1] not in ".!?:"):
        for mark in (". ", ".\n", "! ", "!\n", "? ", "?\n"):
            if text.rfind(mark) > len(text) * 0.5:
                text = text[: text.rfind(mark) + 1]
                break
    return text.strip()


ODD = [
    None, "", "   ", "Fine.", "tone: dry\nThe answer. And so", "A" * 90 + ". It ends. " + "b" * 30 + " let me know if. I hope this helps", "1. First item is here. 1. First item is here. 1. First item is here.",
    ("The cat sat on the mat and looked. " * 5) * 2, "Some words. " * 20 + "\n\nThe provided context does not contain sufficient information, sorry", "x" * 300, "Is it? No! Well the", "What a thing\nTask: x\nhere is more: ", "I hope this helps " * 3,
]


def test_answers_are_cleaned_as_by_a_plain_loop(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "turn int, answer string").unionByName(Q.answers(spark, SF).select((F.col("conv_id") * 100 + F.col("turn") + 1000).cast("int").alias("turn"), "answer"))
    rows = df.select("answer", C.sanitize(F.col("answer")).alias("clean")).collect()
    assert len(rows) > 500
    for r in rows:
        assert r["clean"] == plain_clean(r["answer"]), r["answer"]


def test_found_places_normalise_to_the_needle(spark):
    flat = lambda s: C.normal_with_places(s)[0]
    cases = [("  a  B\n\tc d ", "b c"), ("x", ""), (None, "a"), ("a", None), ("ab", "c"), ("İx  Y z", "x y"), ("a   b", "A B"), (" \n ", "a"), ("end \t", "END")]
    df = spark.createDataFrame(cases, "raw string, needle string")
    for r in df.select("raw", "needle", C.place_in_raw(F.col("raw"), F.col("needle")).alias("p")).collect():
        if r["p"]["start"] is None:
            assert not flat(r["needle"] or "") or flat(r["needle"]) not in flat(r["raw"] or "")
        else:
            cut = r["raw"][r["p"]["start"] : r["p"]["start"] + r["p"]["length"]]
            assert flat(cut) == flat(r["needle"]) and cut.strip() == cut
    found = table(spark, SF, "documents").select("doc_id", "text").join(Q.st26(spark, SF), "doc_id").collect()
    assert len(found) > 900
    for r in found:
        cut = r["text"].replace(" ", "  ")[r["start"] : r["start"] + r["length"]]
        assert flat(cut).split(" ") == flat(r["text"]).split(" ")[2:9]


def plain_windows(text):
    """As by trying every end, longest first."""
    estimate = lambda s: max(1, int(len(s.split()) * 1.6), int(len(s) / 3.2)) if s else 0
    spans = [m.span() for m in re.finditer(r"\S+", text or "")]
    if not spans:
        return []
    if estimate(text) <= 300 and len(spans) <= 300:
        return [(0, len(spans), 0, len(text))]
    out, at = [], 0
    while True:
        fit = [e for e in range(at + 1, min(at + 250, len(spans)) + 1) if estimate(text[spans[at][0] : spans[e - 1][1]]) <= 300]
        end = max(fit, default=at + 1)
        out.append((at, end, spans[at][0], spans[end - 1][1]))
        if end >= len(spans):
            return out
        at = max(at + 1, end - 50)


def test_windows_are_the_longest_that_fit(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "  ", " a b ", "x" * 5000, "a " * 600, " ".join("w" * int(rng.integers(1, 30)) for _ in range(900)), "b" * 2000 + " c " + "d" * 2000]
    for text in texts:
        assert list(C.windows_of(text)) == plain_windows(text)
    rows = table(spark, SF, "documents").where("doc_id < 120").select("text", C.entity_windows(F.col("text")).alias("w")).collect()
    for r in rows:
        assert [tuple(w) for w in r["w"]] == plain_windows(r["text"])
