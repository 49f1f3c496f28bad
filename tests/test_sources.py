"""The Markdown source, and places chosen by context."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.geo import haversine
from tessera.operators import refine as X
from tessera.sources import markdown, markdown_source

TEXTS = {"a.md": "intro\n# A\nx\n## B\ny\n### C\nz\n## D\n# E\n", "sub/b.markdown": "no headers\r\nat all", "c.md": "# One\n####  Deep \ntext\n# Two", "d.txt": "# not this", "e.md": " \n "}


@pytest.fixture
def folder(tmp_path):
    for name, text in TEXTS.items():
        path = tmp_path / "notes" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "notes"


def rows(df):
    return sorted((r["file"].rpartition("/")[2], r["section"], r["path"], r["body"]) for r in df.collect())


def test_markdown_source_reads_what_the_plan_reads(spark, folder):
    markdown_source.register(spark)
    got = rows(spark.read.format("tessera_markdown").option("files", 2).load(str(folder)))
    assert [r[:3] for r in got if r[0] == "a.md"] == [("a.md", i, p) for i, p in enumerate(["Document", "A", "A > B", "A > B > C", "A > D", "E"])]
    plain = rows(markdown.read(spark, f"{folder}/*.md").unionByName(markdown.read(spark, f"{folder}/sub/*.markdown")).where(F.trim("body") != " \n "))
    assert got == [r for r in plain if r[0] != "e.md"]
    assert rows(spark.read.format("tessera_markdown").load(f"file://{folder}/a.md")) == [r for r in got if r[0] == "a.md"]


def test_markdown_source_refuses_what_is_missing_or_empty(spark, folder, tmp_path):
    markdown_source.register(spark)
    read = lambda path, **o: spark.read.format("tessera_markdown").options(**o).load(str(path)).count()
    (tmp_path / "none").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.md").write_bytes(b"\xff\xfe")
    for path, options, said in ((tmp_path / "nowhere", {}, "no folder"), (tmp_path / "none", {}, "no Markdown files"), (folder, {"failOnEmpty": "true"}, "is empty"), (tmp_path / "bad", {}, "utf-8")):
        with pytest.raises(Exception, match=said):
            read(path, **options)
    assert read(tmp_path / "none", allowEmpty="true") == 0


def test_markdown_stream_takes_each_file_once(spark, folder, tmp_path):
    markdown_source.register(spark)

    def run():
        stream = spark.readStream.format("tessera_markdown").option("filesPerBatch", 1).load(str(folder))
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
        return rows(spark.read.parquet(f"{tmp_path}/out").select("file", "section", "path", "body"))

    whole = rows(spark.read.format("tessera_markdown").load(str(folder)))
    assert run() == whole
    (folder / "new.md").write_text("# New\nhere")
    assert run() == sorted([*whole, ("new.md", 1, "New", "# New\nhere")])


PLACES = "geonameid long, lat double, lon double, population long, country string, admin1 string"


def test_places_are_chosen_by_context(spark):
    places = spark.createDataFrame([(1, 53.3, -6.2, 1_000_000, "IE", "L"), (2, 40.1, -83.1, 49_000, "US", "OH"), (3, 37.7, -121.9, 60_000, "US", "CA"), (4, 39.9, -83.0, 800_000, "US", "OH"), (5, 48.8, 2.3, 2_000_000, "FR", "Ile de France")], PLACES)
    aliases = spark.createDataFrame([("dublin", 1, 1_000_000), ("dublin", 2, 49_000), ("dublin", 3, 60_000), ("columbus", 4, 800_000), ("paris", 5, 2_000_000), ("baile atha cliath", 1, 1_000_000)], "alias string, geonameid long, population long")
    cases = [(1, "Dublin", []), (2, "Dublin", ["Ohio"]), (3, "Dublin", ["in", "California", None]), (4, "Dublin", ["Columbus"]), (5, "Dublin", ["Cliath"]), (6, "Zzyzx", ["near", "Paris", "French"]), (7, "Zzyzx", ["nothing"]), (8, "", ["French"]), (9, None, ["French"]), (10, "Paris", None)]
    df = spark.createDataFrame(cases, "id int, name string, around array<string>")
    got = {r["id"]: (r["geonameid"], r["method"]) for r in X.forward_in_context(df, "name", "around", places, aliases).collect()}
    assert got == {1: (1, "exact"), 2: (2, "exact"), 3: (3, "exact"), 4: (1, "exact"), 5: (1, "exact"), 6: (5, "query"), 7: (None, None), 8: (None, None), 9: (None, None), 10: (5, "exact")}
    points = {r["geonameid"]: r["points"] for r in X.by_context(spark.createDataFrame([("dublin", ["Ohio", "columbus"])], "query string, context array<string>"), places, aliases).collect()}
    km = spark.range(1).select(haversine(F.lit(40.1), F.lit(-83.1), F.lit(39.9), F.lit(-83.0))).first()[0]
    assert points == {2: pytest.approx(5 * math.sqrt(0.049) + 4.5 + 1.5 * math.exp(-km / 150))}


def test_hardened_matches_lose_the_weak(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0, 10, "FR", "")], PLACES)
    aliases = spark.createDataFrame([("constantinople", 1, 10)], "alias string, geonameid long, population long")
    df = spark.createDataFrame([(1, "Constantinopel"), (2, "Constantinoplezz"), (3, "constantinople")], "id int, name string").withColumn("around", F.array().cast("array<string>"))
    plain = {r["id"]: r["method"] for r in X.forward_in_context(df, "name", "around", places, aliases).collect()}
    hard = {r["id"]: r["method"] for r in X.forward_in_context(df, "name", "around", places, aliases, hardened=True, floor=93.5).collect()}
    assert plain == {1: "trigram_fuzzy", 2: "trigram_fuzzy", 3: "exact"} and hard == {1: None, 2: None, 3: "exact"}
