"""Names that are alike, and persons resolved in order, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions.similar import likeness
from tessera.operators import people as P
from tessera.operators.similar_join import alike_pairs
from tessera.plans.person_queries import name_mentions

SF = "/root/testdata/sf0.01"
form = lambda x: " ".join(sorted(x.split()))


def test_alike_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("aeimnorst"), rng.integers(1, 14))) + " " + "".join(rng.choice(list("aeimnorst"), rng.integers(1, 10))) for _ in range(120)]
    names = [*base, "", "a", "ab", "aa", "é ü", "x" * 200]
    for n in base:
        at = int(rng.integers(0, len(n)))
        names += [n[:at] + n[at + 1 :], n[:at] + "x" + n[at:], " ".join(reversed(n.split(" "))), n]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    for t in (90.0, 93.0, 97.0):
        got = {(r["name"], r["other"]): r["score"] for r in alike_pairs(df, "name", df.select(F.col("name").alias("other")), "other", t).collect()}
        own = sorted({n for n in names if n})
        want = {(a, b): s for a in own for b in own if (s := likeness(form(a), form(b))) >= t}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > len(own)


def test_frequent_bigrams_make_no_pairs(spark):
    from tessera.operators import similar_join

    rng = np.random.default_rng(5)
    forms = spark.createDataFrame(sorted({("".join(rng.choice(["th", "er", "an", "on"], 7)),) for _ in range(400)}), "form string").withColumn("n", F.length("form"))
    met = similar_join._meet_by_pieces(forms, 93.0)
    # names of one length that differ differ by two changes at least: none of 14 characters is 93 % alike to another
    assert met.where("fa <> fb").isEmpty() and met.count() == forms.count()


def plain_resolve(rows):
    """Mention by mention: rows of (raw, normal, display), in order; all state is looked at each time."""
    entries, out = [], []  # called, names in order, mentions
    rank = lambda x: (len(x.split()), len(x))
    for normal, display in rows:
        owner = {n: e for e in entries for n in e["names"]}
        last = normal.split(" ")[-1]
        entry, method, share = owner.get(normal), "exact", 1.0
        if entry is None:
            kin = {n: e for n, e in owner.items() if n.split(" ")[-1] == last}
            found = list({id(e): e for e in kin.values()}.values())
            if " " in normal and last in kin and len(found) == 1:
                entry, method = found[0], "fuzzy_last"
            elif " " not in normal and found:
                top = max((e["n"], rank(e["called"])) for e in found)
                first = [e for e in found if (e["n"], rank(e["called"])) == top]
                if len(first) == 1:
                    entry, method = first[0], "fuzzy_last"
        for among, least, how in () if entry is not None else ((kin, 96, "fuzzy_last"), (owner, 93, "fuzzy_full")):
            best = sorted((-likeness(form(n), form(normal)), n) for n in among)
            if entry is None and best and -best[0][0] >= least:
                entry, method, share = owner[best[0][1]], how, -best[0][0] / 100
        if entry is None:
            entry, method, share = {"called": display, "names": [], "n": 0}, "new", 0.0
            entries.append(entry)
        entry["n"] += 1
        if normal not in entry["names"]:
            entry["names"].append(normal)
        if rank(display) > rank(entry["called"]):
            entry["called"] = display
        out.append((entry["called"], method, round(share, 4)))
    return out


def check(spark, mentions):
    """mentions: (place, raw)."""
    got = {r["place"]: (r["canonical_name"], r["method"], r["confidence"]) for r in P.resolve(mentions, "raw", ["place"]).collect()}
    own = mentions.select("place", N.normalize_name(F.col("raw")).alias("normal"), N.display_form(F.col("raw")).alias("display")).where("normal <> ''").orderBy("place").collect()
    want = dict(zip([r["place"] for r in own], plain_resolve([(r["normal"], r["display"]) for r in own])))
    assert got == want
    return want


def test_persons_resolve_as_one_by_one(spark):
    rng = np.random.default_rng(9)
    first, last = ["Noam", "Ann", "Anna", "Annamaria", "Jo", "Bartholomew", "Bartolomew"], ["Chomsky", "Chomski", "Smith", "Smyth", "Featherstonehaugh", "Featherstonehaugg"]
    for seed in range(3):
        names = []
        for _ in range(250):
            f, s, kind = first[rng.integers(len(first))], last[rng.integers(len(last))], rng.integers(8)
            names.append([f"{f} {s}", s, f"Dr. {f} {s}", f"{f} van {s}", f"{s} {f}", f"{f} {s},", f"{f} {f} {s}", f"  {s.upper()} "][kind])
        names += ["Dr.", "", None, "Sir"]
        want = check(spark, spark.createDataFrame(list(enumerate(names)), "place long, raw string"))
        assert len({m for _, m, _ in want.values()}) == 4, seed


def test_persons_of_the_documents_resolve_as_one_by_one(spark):
    check(spark, name_mentions(spark, SF).select(F.col("doc_id").alias("place"), F.col("raw_name").alias("raw")))


def test_registry_loses_mentions(spark):
    entries = spark.createDataFrame([("Noam Chomsky", 3, ["a", "b"], {"Noam Chomsky": 1, "Chomsky": 2}), ("Smith", 1, ["a"], {"Smith": 1}), ("Ann Lee", 2, ["c"], {"Ann Lee": 2})], "canonical_name string, mention_count long, source_ids array<string>, variants map<string,long>")
    removed = spark.createDataFrame([("Noam Chomsky", "Noam  Chomsky", "b"), ("Smith", "Smith", "a"), ("nobody", "x", "y")], "canonical_name string, raw_name string, source_id string")
    got = {r["canonical_name"]: (r["mention_count"], r["source_ids"], r["variants"]) for r in P.without(entries, removed).collect()}
    assert got == {"Noam Chomsky": (2, ["a"], {"Chomsky": 2}), "Ann Lee": (2, ["c"], {"Ann Lee": 2})}
    a, b = ({"mention_count": n, "source_ids": s, "variants": v} for n, s, v in ((2, ["a"], {"x": 2}), (3, ["a", "b"], {"x": 1, "y": 2})))
    assert P.merge(a, b) == {"mention_count": 5, "source_ids": ["a", "b"], "variants": {"x": 3, "y": 2}}


def test_peopletag_keeps_what_is_sure(spark):
    rows = [(1, "s", "Ann Lee", "x", 0.9), (2, "s", "ann lee", "x", 0.95), (3, "s", "Ann Lee", "y", 0.5), (4, "s", "Lee", "z", None), (5, "t", "Lee", "z", 0.8)]
    df = spark.createDataFrame(rows, "place long, source string, raw string, snippet string, ner double")
    got = [(r["place"], r["canonical_name"], r["method"], r["confidence"]) for r in P.peopletag(df, "raw", "source", "snippet", ["place"], "ner").orderBy("place").collect()]
    assert got == [(1, "Ann Lee", "new", 0.9), (5, "Ann Lee", "fuzzy_last", 1.0)]
