"""Queries on geocoding. Suppliers stand for places, customers for names; coordinates are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.functions import text as T
from tessera.operators import geocode as C
from tessera.operators import refine as X
from tessera.operators.tables import of_each
from tessera.plans.geo_queries import SQL_KM, SQL_PLACES
from tessera.plans.geo_queries import places as sites
from tessera.registry import query
from tessera.session import table

SQL_TOWNS = f"{SQL_PLACES}, towns AS (SELECT id AS geonameid, name, lat, lon, id * 7919 % 100000 AS population, CASE id % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'IT' END AS country FROM places)"
# an alias is shared by the places of equal remainder, so names are ambiguous
SQL_ALIASES = f"{SQL_TOWNS}, aliases AS (SELECT lower(name) AS alias, geonameid, population FROM towns UNION SELECT 'port ' || (geonameid % 50), geonameid, population FROM towns)"
SQL_BEST = "best AS (SELECT alias AS query, arg_max(geonameid, population * 1000000 - geonameid) AS geonameid, max(population) AS top, count(*) AS rivals, coalesce(list_sort(list(population), 'DESC')[2], -1) AS second FROM aliases GROUP BY alias)"


def towns(spark, d):
    country = F.when(F.col("id") % 4 == 0, "FR").when(F.col("id") % 4 == 1, "DE").when(F.col("id") % 4 == 2, "IT")
    return sites(spark, d).select(F.col("id").alias("geonameid"), "name", "lat", "lon", (F.col("id") * 7919 % 100000).alias("population"), country.alias("country"))


def aliases(spark, d):
    own = towns(spark, d)
    return own.select(F.lower("name").alias("alias"), "geonameid", "population").unionAll(own.select(F.concat(F.lit("port "), (F.col("geonameid") % 50).cast("string")), "geonameid", "population"))


@query("ge06_accents", "SELECT c_custkey, strip_accents(n) AS plain, strip_accents(lower(trim(n))) AS index_form FROM (SELECT c_custkey, ' Zürich Ñandú Łódź ' || c_name || ' é ' AS n FROM customer)")
def ge06(spark, d):
    name = F.concat(F.lit(" Zürich Ñandú Łódź "), "c_name", F.lit(" é "))
    return table(spark, d, "customer").select("c_custkey", T.strip_accents(name).alias("plain"), T.index_form(name).alias("index_form"))


_SQL_COUNTRIES = "CASE lower(n_name) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.COUNTRIES.items()) + " END"


@query("ge10_country_codes", f"SELECT n_nationkey, {_SQL_COUNTRIES} AS code FROM nation")
def ge10(spark, d):
    return table(spark, d, "nation").select("n_nationkey", C.country_code(F.lower("n_name")).alias("code"))


@query("ge11_exact", f"WITH {SQL_ALIASES}, {SQL_BEST} SELECT query, geonameid, rivals, rivals > 1 AND second > top * 0.05 AS ambiguous FROM best")
def ge11(spark, d):
    own = aliases(spark, d)
    return C.exact(own.select(F.col("alias").alias("query")).distinct(), own).select("query", "geonameid", "rivals", "ambiguous")


_FORM = "array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')), ' ')"
_GRAMS = "list_distinct(list_transform(range(1, length({x}) + 3), lambda i: substring('  ' || {x} || '  ', i, 3)))"
_GENERIC = ", ".join(f"'{w}'" for w in E.GENERIC_PLACES)


def _sql_alike(asked: str) -> str:
    """A CTE ``fz``: what the names of another CTE (query) are likest to. A row of the table of common signs is one number, a bit for each sign of the first text."""
    mask = "list_transform(string_split(fb, ''), lambda ch: CAST(list_sum(list_transform(range(1, length(fa) + 1), lambda i: CASE WHEN substring(fa, i, 1) = ch THEN 1::BIGINT << (i - 1)::INTEGER ELSE 0::BIGINT END)) AS BIGINT))"
    common = f"length(fa) - bit_count(list_reduce({mask}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::BIGINT << length(fa)::INTEGER) - 1), (1::BIGINT << length(fa)::INTEGER) - 1))"
    return f"""
pr AS (SELECT query, alias, {_FORM.format(x="query")} AS fa, {_FORM.format(x="alias")} AS fb FROM (SELECT DISTINCT query FROM {asked} WHERE query <> ''), (SELECT DISTINCT alias FROM aliases) WHERE list_has_any({_GRAMS.format(x="query")}, {_GRAMS.format(x="alias")})),
sc AS (SELECT query, alias, 200.0::DOUBLE * ({common}) / (length(fa) + length(fb)) AS score FROM pr WHERE least(length(fa), length(fb)) * 200.0 >= 72 * (length(fa) + length(fb))),
bp AS (SELECT query, geonameid, max(score) AS score, max(population) AS population FROM sc JOIN aliases USING (alias) WHERE score >= 72 GROUP BY query, geonameid),
rk AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt, max(score) OVER (PARTITION BY query) AS best FROM bp WINDOW w AS (PARTITION BY query ORDER BY score DESC, population DESC, geonameid)),
rv AS (SELECT *, sum(CASE WHEN score >= best - 5 THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS rivals FROM rk),
fz AS (SELECT query, geonameid, rivals > 1 AS ambiguous, greatest(0, least(0.88::DOUBLE, least(score / 100, 0.88::DOUBLE) * CASE WHEN rivals > 1 THEN 0.85 ELSE 1.0 END * CASE WHEN nxt IS NOT NULL AND rivals >= 2 THEN 0.65 + 0.35 * greatest(0, least(1, (score - nxt) / 4)) ELSE 1.0 END
  - CASE WHEN len(regexp_extract_all(query, '[a-z]{{2,}}')) BETWEEN 1 AND 3 AND len(list_filter(regexp_extract_all(query, '[a-z]{{2,}}'), lambda w: w NOT IN ({_GENERIC}))) = 0 THEN 0.08 ELSE 0 END)) AS confidence FROM rv WHERE k = 1)"""


@query("ge12_forward", f"""WITH {SQL_ALIASES}, {SQL_BEST}, n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' The Port ' || (c_custkey % 60) WHEN 1 THEN 'French' WHEN 2 THEN 'Zzqqxx' WHEN 3 THEN '' ELSE 'port ' || (c_custkey % 50) END AS name FROM customer),
q AS (SELECT *, regexp_replace(lower(trim(name)), '^the ', '') AS query FROM n),
lost AS (SELECT DISTINCT q.query FROM q LEFT JOIN best b USING (query) WHERE b.geonameid IS NULL), {_sql_alike("lost")},
fr AS (SELECT arg_max(geonameid, population * 1000000 - geonameid) AS g FROM towns WHERE country = 'FR')
SELECT c_custkey, coalesce(b.geonameid, z.geonameid, CASE WHEN q.query = 'french' THEN fr.g END) AS geonameid, CASE WHEN b.geonameid IS NOT NULL THEN 'exact' WHEN z.geonameid IS NOT NULL THEN 'trigram_fuzzy' WHEN q.query = 'french' THEN 'query' END AS method,
round(CASE WHEN b.geonameid IS NOT NULL THEN CASE WHEN b.rivals > 1 AND b.second > b.top * 0.05 THEN 0.85 ELSE 1.0 END WHEN z.geonameid IS NOT NULL THEN z.confidence WHEN q.query = 'french' THEN 0.86 END::DOUBLE, 6) AS confidence
FROM q LEFT JOIN best b USING (query) LEFT JOIN fz z USING (query), fr""")
def ge12(spark, d):
    """Names through every stage: exact, alike, by country, and not at all."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit(" The Port "), (k % 60).cast("string"))).when(k % 5 == 1, "French").when(k % 5 == 2, "Zzqqxx").when(k % 5 == 3, "").otherwise(F.concat(F.lit("port "), (k % 50).cast("string")))
    got = C.forward(table(spark, d, "customer").select("c_custkey", name.alias("name")), "name", towns(spark, d), aliases(spark, d))
    return got.select("c_custkey", "geonameid", "method", F.round("confidence", 6).alias("confidence"))


@query("ge14_coherence", f"""WITH {SQL_TOWNS}, c AS (SELECT geonameid % 40 AS doc, 'n' || (geonameid % 3) AS name, geonameid, lat, lon, population FROM towns),
r AS (SELECT *, row_number() OVER w AS k, lead(population) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY doc, name ORDER BY population DESC, geonameid)), b AS (SELECT * FROM r WHERE k = 1),
clear AS (SELECT doc, name FROM b WHERE nxt IS NULL OR population > 5 * greatest(nxt, 1)),
s AS (SELECT p.doc, p.name, p.geonameid, p.population, sqrt(greatest(p.population, 1)) * (1 + 0.5 * exp(-avg({SQL_KM.format(a='p', b='q')}) / 500.0)) AS s FROM c p JOIN b q ON p.doc = q.doc AND p.name <> q.name WHERE (p.doc, p.name) NOT IN (SELECT (doc, name) FROM clear) GROUP BY p.doc, p.name, p.geonameid, p.population),
t AS (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY s DESC, population DESC, geonameid) AS k FROM s)
SELECT b.doc, b.name, coalesce(t.geonameid, b.geonameid) AS geonameid FROM b LEFT JOIN (SELECT * FROM t WHERE k = 1) t USING (doc, name)""")
def ge14(spark, d):
    own = towns(spark, d).select((F.col("geonameid") % 40).alias("doc"), F.concat(F.lit("n"), (F.col("geonameid") % 3).cast("string")).alias("name"), "geonameid", "lat", "lon", "population")
    return C.coherent(own, ["doc"], "name")


@query("jn10_anchor_distances", f"""WITH {SQL_TOWNS}, c AS (SELECT geonameid % 40 AS doc, 'n' || (geonameid % 3) AS name, geonameid, lat, lon, population FROM towns),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY population DESC, geonameid) AS k FROM c) WHERE k = 1)
SELECT p.geonameid, round(avg({SQL_KM.format(a='p', b='q')}), 3) AS km, count(*) AS anchors FROM c p JOIN b q ON p.doc = q.doc AND p.name <> q.name GROUP BY p.geonameid""")
def jn10(spark, d):
    """Mean distance of each candidate of a name to the best places of its document's other names."""
    from tessera.functions.geo import haversine

    own = towns(spark, d).select("geonameid", (F.col("geonameid") % 40).alias("doc"), F.concat(F.lit("n"), (F.col("geonameid") % 3).cast("string")).alias("name"), "lat", "lon", "population")
    # one row a name: a document's names, not its candidates, meet each candidate
    best = own.groupBy("doc", "name").agg(F.max_by(F.struct("lat", "lon"), F.struct("population", (-F.col("geonameid")).alias("id"))).alias("a")).select("doc", F.col("name").alias("other"), "a")
    met = own.join(best, "doc").where("name <> other")
    return met.groupBy("geonameid").agg(F.round(F.avg(haversine(F.col("lat"), F.col("lon"), F.col("a.lat"), F.col("a.lon"))), 3).alias("km"), F.count(F.lit(1)).alias("anchors"))


@query("ge15_confidence", """WITH m AS (SELECT event_id, (event_id % 21) * 6.0 AS score, ['exact', 'region_table', 'trigram_fuzzy', 'query', 'regex', 'other'][event_id % 6 + 1] AS method, event_id % 7 = 0 AS amb, event_id % 5 AS margin, CASE event_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOC' END AS kind, CASE event_id % 3 WHEN 0 THEN 'lake district' WHEN 1 THEN 'north sea' ELSE 'bay' END AS query FROM events),
c AS (SELECT *, CASE method WHEN 'exact' THEN 1.0 WHEN 'region_table' THEN 0.94 WHEN 'trigram_fuzzy' THEN 0.88 WHEN 'query' THEN 0.86 WHEN 'regex' THEN 0.72 ELSE 0.80 END AS cap FROM m)
SELECT event_id, round(greatest(0, least(cap, least(least(score, 100) / 100, cap) * CASE WHEN amb THEN 0.85 ELSE 1 END * CASE WHEN method = 'trigram_fuzzy' THEN 0.65 + 0.35 * least(1, margin / 4.0) ELSE 1 END - CASE WHEN method = 'trigram_fuzzy' AND query <> 'north sea' THEN 0.08 ELSE 0 END - CASE WHEN kind = 'PERSON' THEN 0.12 ELSE 0 END))::DOUBLE, 6) AS confidence FROM c""")
def ge15(spark, d):
    k = F.col("event_id")
    methods = F.array(*map(F.lit, ("exact", "region_table", "trigram_fuzzy", "query", "regex", "other")))
    asked = F.when(k % 3 == 0, "lake district").when(k % 3 == 1, "north sea").otherwise("bay")
    got = C.confidence((k % 21) * 6.0, methods[(k % 6).cast("int")], k % 7 == 0, asked, F.when(k % 4 == 0, "Person").when(k % 4 == 1, "LOC"), F.lit(2), (k % 5).cast("double"))
    return table(spark, d, "events").select("event_id", F.round(got, 6).alias("confidence"))


@query("ge16_default_confidence", "SELECT event_id, round((event_id % 101) / 100.0 * CASE event_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE 0.8 END * CASE WHEN event_id % 7 = 0 THEN 0.85 ELSE 1 END::DOUBLE, 6) AS confidence FROM events")
def ge16(spark, d):
    k = F.col("event_id")
    got = C.default_confidence((k % 101).cast("double"), F.when(k % 3 == 0, "region_table").when(k % 3 == 1, "trigram_fuzzy").otherwise("other"), k % 7 == 0)
    return table(spark, d, "events").select("event_id", F.round(got, 6).alias("confidence"))


_SQL_REGIONS = "regions AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {r}::DOUBLE)" for k, (a, b, r) in E.NAMED_REGIONS.items()) + ") t(region, lat, lon, radius))"


@query("ge21_region_places", f"WITH {SQL_TOWNS}, {_SQL_REGIONS} SELECT region, arg_max(p.geonameid, p.population * 1000000 - p.geonameid) AS geonameid FROM regions q, towns p WHERE {SQL_KM.format(a='p', b='q')} <= 400 GROUP BY region")
def ge21(spark, d):
    return C.region_places(towns(spark, d), 400.0)


@query("ge24_centres", f"""WITH {SQL_ALIASES}, {SQL_BEST}, {_SQL_REGIONS}, n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' Iberia' WHEN 1 THEN 'Port ' || (c_custkey % 60) ELSE 'Zzqqxx' END AS name FROM customer),
lost AS (SELECT DISTINCT lower(trim(name)) AS query FROM n WHERE lower(trim(name)) <> 'iberia' AND lower(trim(name)) NOT IN (SELECT query FROM best)), {_sql_alike("lost")}
SELECT c_custkey, coalesce(r.lat, t.lat) AS lat, coalesce(r.lon, t.lon) AS lon, coalesce(r.radius, CASE WHEN t.lat IS NOT NULL THEN 50.0 END) AS radius FROM n LEFT JOIN regions r ON r.region = lower(trim(n.name)) LEFT JOIN best b ON b.query = lower(n.name) LEFT JOIN fz z ON z.query = lower(n.name) LEFT JOIN towns t ON t.geonameid = coalesce(b.geonameid, z.geonameid)""")
def ge24(spark, d):
    """Middles of regions, and of towns by their names or the names that theirs are like."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, " Iberia").when(k % 3 == 1, F.concat(F.lit("Port "), (k % 60).cast("string"))).otherwise("Zzqqxx").alias("name"))
    return C.centre(own, "name", towns(spark, d), aliases(spark, d)).drop("name")


@query("ge25_places_in_text", """SELECT event_id, 'Old ' || event_type || ',Rome,Nova Roma,Ostia,Alba,Veii' || CASE WHEN event_id % 2 = 0 THEN ',Gaul,Holy Land' ELSE '' END AS places FROM events""")
def ge25(spark, d):
    said = F.concat(F.lit('What of "Old '), "event_type", F.lit('" near Rome and Nova Roma, from near Ostia, between Alba and Veii, near rome itself or from Rome'), F.when(F.col("even"), F.lit("; the holy land, gaul, gauls")).otherwise(""))
    own = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 2 == 0).alias("even"))
    # equal texts are looked through once
    return of_each(own, ["event_type", "even"], lambda texts: texts.withColumn("places", F.array_join(E.places_in(said), ","))).select("event_id", "places")


@query("ge26_expansion")
def ge26(spark, d):
    """Search terms of each place: likeness has no SQL form, a test states it."""
    return C.expansion(towns(spark, d), aliases(spark, d))


@query("ge27_mentions", f"""WITH {SQL_ALIASES}, {SQL_BEST}, m AS (SELECT c_custkey % 20 AS source_id, c_custkey AS chunk_id, unnest(['port ' || (c_custkey % 50), 'port ' || (c_custkey * 3 % 60), 'port ' || (c_custkey % 50), 'Zzqqxx']) AS name, unnest([0, 1, 2, 3]) AS nth FROM customer),
lost AS (SELECT DISTINCT lower(name) AS query FROM m WHERE lower(name) NOT IN (SELECT query FROM best)), {_sql_alike("lost")},
hit AS (SELECT m.*, coalesce(b.geonameid, z.geonameid) AS geonameid, round(CASE WHEN b.geonameid IS NULL THEN z.confidence WHEN b.rivals > 1 AND b.second > b.top * 0.05 THEN 0.85 ELSE 1.0 END::DOUBLE, 6) AS confidence FROM m LEFT JOIN best b ON b.query = m.name LEFT JOIN fz z ON z.query = m.name),
first AS (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_id, geonameid ORDER BY nth) AS k FROM hit WHERE confidence >= 0.5)
SELECT f.source_id, f.chunk_id, t.geonameid, t.name AS place_name, f.confidence FROM first f JOIN towns t USING (geonameid) WHERE k = 1""")
def ge27(spark, d):
    k = F.col("c_custkey")
    port = lambda n, m: F.concat(F.lit("port "), (n % m).cast("string"))
    own = table(spark, d, "customer").select((k % 20).alias("source_id"), k.alias("chunk_id"), F.array(port(k, 50), port(k * 3, 60), port(k, 50), F.lit("Zzqqxx")).alias("names"))
    got = C.mentions_of(own, "names", towns(spark, d), aliases(spark, d))
    return got.select("source_id", "chunk_id", "geonameid", "place_name", F.round("confidence", 6).alias("confidence"))


@query("ge28_features", f"WITH {SQL_PLACES} SELECT id, sha256('{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || lon || ',' || lat || ']}},\"properties\":{{\"place_name\":\"' || name || '\",\"mention_count\":' || (id % 9) || '}}}}') AS digest FROM places")
def ge28(spark, d):
    own = sites(spark, d)
    return own.select("id", F.sha2(C.feature(F.col("lon"), F.col("lat"), place_name=F.col("name"), mention_count=F.col("id") % 9), 256).alias("digest"))


@query("ge29_clusters", f"WITH {SQL_PLACES}, c AS (SELECT lat, lon, floor((lon + 180) / 360 * 512 * 8 / 50) AS cx, floor((0.5 - ln((1 + sin(radians(greatest(-85, least(85, lat))))) / (1 - sin(radians(greatest(-85, least(85, lat)))))) / (4 * pi())) * 512 * 8 / 50) AS cy FROM places) SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM c GROUP BY ALL")
def ge29(spark, d):
    return C.clusters(sites(spark, d), 3).select("cx", "cy", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("ge33_flat_aliases", f"WITH {SQL_ALIASES}, r AS (SELECT geonameid, alias, row_number() OVER (PARTITION BY geonameid ORDER BY alias) AS place FROM (SELECT DISTINCT geonameid, alias FROM aliases)) SELECT geonameid, alias, CAST(place AS INTEGER) AS place FROM r WHERE place <= 12")
def ge33(spark, d):
    return C.flat_aliases(aliases(spark, d), towns(spark, d))


@query("pf16_generic_places", f"""WITH q AS (SELECT doc_id, regexp_extract_all(CASE doc_id % 3 WHEN 0 THEN 'north ' WHEN 1 THEN 'lake 7 ' ELSE '' END || CASE doc_id % 2 WHEN 0 THEN 'river' ELSE lower(string_split(text, ' ')[1]) END, '[a-z]{{2,}}') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: x NOT IN ({_GENERIC}))) = 0 AS generic FROM q""")
def pf16(spark, d):
    """Names made of generic words and the documents' first ones."""
    k = F.col("doc_id")
    name = F.concat(F.when(k % 3 == 0, "north ").when(k % 3 == 1, "lake 7 ").otherwise(""), F.when(k % 2 == 0, "river").otherwise(F.lower(F.element_at(F.split("text", " "), 1))))
    return table(spark, d, "documents").where("text is not null").select("doc_id", E.generic_place(name).alias("generic"))


SQL_NAMED = f"""{SQL_ALIASES}, {SQL_BEST},
n AS (SELECT doc_id, 'port ' || (doc_id % 50) AS query, [CASE doc_id % 4 WHEN 0 THEN 'french' WHEN 1 THEN 'the Germans' WHEN 2 THEN 'it' ELSE 'Zzqq' END, 'supplier#' || lpad(CAST(doc_id % 97 AS VARCHAR), 9, '0')] AS context FROM documents),
cand AS (SELECT alias AS query, a.geonameid, a.population, t.lat, t.lon, t.country, max(a.population) OVER (PARTITION BY alias) AS top FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY population DESC, geonameid) AS k FROM aliases) a JOIN towns t USING (geonameid) WHERE k <= 10)"""


def named_documents(spark, d):
    """Each document names a port that several towns share, and some words beside it: a people or a country's code, and a supplier that may be an anchor."""
    k = F.col("doc_id")
    word = F.when(k % 4 == 0, "french").when(k % 4 == 1, "the Germans").when(k % 4 == 2, "it").otherwise("Zzqq")
    supplier = F.concat(F.lit("supplier#"), F.lpad((k % 97).cast("string"), 9, "0"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("port "), (k % 50).cast("string")).alias("name"), F.array(word, supplier).alias("around"))


@query("ge17_refine", f"""WITH {SQL_NAMED}, lost AS (SELECT DISTINCT query FROM n WHERE query NOT IN (SELECT query FROM best)), {_sql_alike("lost")},
anchor AS (SELECT DISTINCT n.context[2] AS w, t.lat, t.lon FROM n JOIN (SELECT alias, arg_max(geonameid, population) AS geonameid, max(population) AS people FROM aliases GROUP BY alias) b ON b.alias = n.context[2] JOIN towns t ON t.geonameid = b.geonameid WHERE people >= 50000),
scored AS (
  SELECT n.doc_id, p.geonameid, p.population, CASE WHEN p.top > 0 THEN 5 * sqrt(p.population / greatest(p.top, 1)::DOUBLE) ELSE 0 END
    + CASE WHEN n.context[1] = 'french' AND p.country = 'FR' THEN 4 WHEN n.context[1] = 'it' AND p.country = 'IT' THEN 3 ELSE 0 END
    + 1.5 + coalesce(1.5 * exp(-({SQL_KM.format(a='p', b='q')}) / 150), 0) AS points
  FROM n JOIN best b USING (query) JOIN cand p USING (query) LEFT JOIN anchor q ON q.w = n.context[2] WHERE b.rivals > 1 AND b.second > b.top * 0.05),
won AS (SELECT doc_id, geonameid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, population DESC, geonameid) AS k FROM scored) WHERE k = 1)
SELECT n.doc_id, coalesce(w.geonameid, b.geonameid, z.geonameid) AS geonameid, CASE WHEN b.geonameid IS NOT NULL THEN b.rivals > 1 AND b.second > b.top * 0.05 ELSE z.ambiguous END AS ambiguous FROM n LEFT JOIN best b USING (query) LEFT JOIN fz z USING (query) LEFT JOIN won w USING (doc_id)""")
def ge17(spark, d):
    """The town that each document's port is, by the words around it."""
    got = X.forward_in_context(named_documents(spark, d), "name", "around", towns(spark, d), aliases(spark, d), anchor_people=50_000)
    return got.select("doc_id", "geonameid", "ambiguous")


@query("ge19_forward_batch", f"""WITH {SQL_ALIASES}, {SQL_BEST}, n AS (SELECT doc_id // 10 AS doc, 'port ' || (doc_id % 50) AS query FROM documents GROUP BY ALL), lost AS (SELECT DISTINCT query FROM n WHERE query NOT IN (SELECT query FROM best)), {_sql_alike("lost")},
o AS (SELECT n.doc, n.query FROM n JOIN best b USING (query) WHERE b.rivals > 1 AND b.second > b.top * 0.05),
c AS (SELECT o.doc, o.query AS name, a.geonameid, a.population, t.lat, t.lon FROM o JOIN (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY population DESC, geonameid) AS k FROM aliases) a ON a.alias = o.query AND k <= 10 JOIN towns t USING (geonameid)),
r AS (SELECT *, row_number() OVER w AS k, lead(population) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY doc, name ORDER BY population DESC, geonameid)), f AS (SELECT * FROM r WHERE k = 1),
clear AS (SELECT doc, name FROM f WHERE nxt IS NULL OR population > 5 * greatest(nxt, 1)),
s AS (SELECT p.doc, p.name, p.geonameid, p.population, sqrt(greatest(p.population, 1)) * (1 + 0.5 * exp(-avg({SQL_KM.format(a='p', b='q')}) / 500.0)) AS s FROM c p JOIN f q ON p.doc = q.doc AND p.name <> q.name WHERE (p.doc, p.name) NOT IN (SELECT (doc, name) FROM clear) GROUP BY p.doc, p.name, p.geonameid, p.population),
t AS (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY s DESC, population DESC, geonameid) AS k FROM s)
SELECT n.doc, n.query, coalesce(t.geonameid, b.geonameid, z.geonameid) AS geonameid FROM n LEFT JOIN best b USING (query) LEFT JOIN fz z USING (query) LEFT JOIN (SELECT * FROM t WHERE k = 1) t ON t.doc = n.doc AND t.name = n.query""")
def ge19(spark, d):
    """Ten documents' ports at a time, chosen together."""
    own = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("doc"), F.concat(F.lit("port "), (F.col("doc_id") % 50).cast("string")).alias("name")).distinct()
    got = X.forward_batch(own, "name", ["doc"], towns(spark, d), aliases(spark, d))
    return got.select("doc", "query", "geonameid")
