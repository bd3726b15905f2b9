"""Registered queries: free-text places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import places as L
from ..operators import spatial as P
from ..sources import adapters as S
from ..sources import cache as C
from ..sources import osm
from .feed import Feed
from .registry import query
from .spatial_queries import WAYS, miles
from .views import with_views

DIR = "n|s|e|w|ne|nw|se|sw|north|south|east|west|northeast|northwest|southeast|southwest"
SUF = ("st|street|ave|av|avenue|blvd|boulevard|rd|road|dr|drive|ln|lane|ct|court|pl|place|pkwy|parkway|hwy|highway|"
       "expy|expressway|ter|terrace|way|cir|circle|sq|square|plz|plaza|pt|point|row")


def squash_sql(c: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(lower({c}), '[.,;:''"()]', ' ', 'g'), '\s+', ' ', 'g'))"""


def street_sql(c: str) -> str:
    return (f"regexp_replace(regexp_replace({squash_sql(c)}, '^(?:{DIR}) (.+)$', '\\1', 's'), "
            f"'^(.+) (?:{SUF})$', '\\1', 's')")


def address_sql(c: str) -> str:
    s = squash_sql(c)
    rest = rf"regexp_replace(ltrim(regexp_replace({s}, '^\d\S*', '')), '^(?:{DIR})(?: |$)', '')"
    return (rf"trim(regexp_extract({s}, '^(\d\S*)', 1) || ' ' || "
            rf"regexp_replace({rest}, '^(.+) (?:{SUF})$', '\1', 's'))")


CORPUS = r"""v_addr_raw AS (SELECT c_custkey AS id, (c_custkey % 900) || ' ' ||
       CASE c_custkey % 4 WHEN 0 THEN 'N ' WHEN 1 THEN 'West ' WHEN 2 THEN '' ELSE 'SE ' END || 'Elm' || (c_custkey % 50)
       || CASE c_custkey % 3 WHEN 0 THEN ' St' WHEN 1 THEN ' Avenue' ELSE ' Blvd.' END AS raw,
       (c_custkey % 900) || ' elm' || (c_custkey % 50) AS normalized,
       41.64 + (c_custkey * 3571 % 3800) / 10000.0 AS lat, -87.94 + (c_custkey * 2741 % 4200) / 10000.0 AS lon
     FROM customer WHERE c_custkey % 13 <> 0),
   v_addr AS (SELECT normalized, min(id) AS id, arg_min(raw, id) AS raw, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon
     FROM v_addr_raw GROUP BY normalized, round(lat * 100000), round(lon * 100000)),
   v_marks AS (SELECT lower(replace(s_name, '#', ' plaza ')) || ' avenue' AS name,
       41.64 + (s_suppkey * 3571 % 3800) / 10000.0 AS lat, -87.94 + (s_suppkey * 2741 % 4200) / 10000.0 AS lon FROM supplier),
   v_plaza AS (SELECT o_orderkey, 'Supplier plaza ' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') AS plaza, o_custkey FROM orders),
   v_queries AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 6
       WHEN 0 THEN '41.' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ', -87.7'
       WHEN 1 THEN plaza || ' ave' WHEN 2 THEN replace(plaza, 'plaza', 'plza') || ' avenue'
       WHEN 3 THEN 'N Elm' || (o_orderkey % 50) || ' St and Elm' || (o_custkey % 50) || ' Blvd'
       WHEN 4 THEN (o_orderkey % 900) || ' W Elm' || (o_custkey % 50) || ' St'
       ELSE list_extract(['small ','red','elm7','blue gear & b','Supplier p'], CAST(o_orderkey % 5 + 1 AS INTEGER)) END AS query
     FROM v_plaza)"""


@query("street_names", f"""
    SELECT doc_id, sha256({street_sql('text')}) AS street, sha256({address_sql('text')}) AS address FROM documents""")
def street_names(spark, sf_dir):
    """Both canonical forms of every whole document."""
    t = F.col("text")
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.street_name(t), 256).alias("street"),
        F.sha2(text.address(t), 256).alias("address"))


@query("way_names", f"WITH {WAYS} SELECT k AS way_id, {street_sql('raw')} AS canon FROM v_ways")
def way_names(spark, sf_dir):
    return S.ways(spark, sf_dir).select("way_id", text.street_name(F.col("name")).alias("canon"))


@query("expand_suffixes", f"""WITH {CORPUS} SELECT query_id,
    regexp_replace(regexp_replace(regexp_replace(lower(trim(query)), '\\bave\\b(\\s*(?:,|$))', 'avenue\\1', 'g'),
      '\\bblvd\\b(\\s*(?:,|$))', 'boulevard\\1', 'g'), '\\bst\\b(\\s*(?:,|$))', 'street\\1', 'g') AS typed FROM v_queries""")
def expand_suffixes(spark, sf_dir):
    return S.place_queries(spark, sf_dir).select(
        "query_id", text.expand_suffixes(F.lower(F.trim("query"))).alias("typed"))


@query("parse_queries", f"""WITH {CORPUS} SELECT query_id,
    CASE WHEN query = 'blue gear & b' THEN 'b' WHEN query_id % 6 = 3 AND query_id % 50 <> o_custkey % 50
         THEN least('elm' || (query_id % 50), 'elm' || (o_custkey % 50)) END AS name_a,
    CASE WHEN query = 'blue gear & b' THEN 'blue gear' WHEN query_id % 6 = 3 AND query_id % 50 <> o_custkey % 50
         THEN greatest('elm' || (query_id % 50), 'elm' || (o_custkey % 50)) END AS name_b,
    CASE WHEN query_id % 6 = 0 THEN CAST('41.' || lpad(CAST(query_id % 60 AS VARCHAR), 2, '0') AS DOUBLE) END AS lat,
    'q#' || substr(sha256(query), 1, 10) AS tag FROM v_queries JOIN orders ON o_orderkey = query_id""")
def parse_queries(spark, sf_dir):
    q = F.col("query")
    return S.place_queries(spark, sf_dir).select(
        "query_id", text.cross_street(q)["a"].alias("name_a"), text.cross_street(q)["b"].alias("name_b"),
        text.coordinate_pair(q)["lat"].alias("lat"), text.query_tag(q).alias("tag"))


def addresses(spark, sf_dir):
    return L.dedupe_addresses(osm.addresses(osm.parse_elements(S.osm_json(spark, sf_dir))))


def landmarks(spark, sf_dir):
    return osm.parse_landmarks(S.landmarks_json(spark, sf_dir))


@query("read_landmarks", f"WITH {CORPUS} SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_marks")
def read_landmarks(spark, sf_dir):
    return landmarks(spark, sf_dir).select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("dedupe_addresses", f"""WITH {CORPUS}
    SELECT id, normalized, raw, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_addr""")
def dedupe_addresses(spark, sf_dir):
    return addresses(spark, sf_dir)


@query("merge_by_id", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS label FROM part""")
def merge_by_id(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    first = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    second = p.where(F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return L.merge_by_id([first, second])


def crossings(spark, sf_dir):
    return P.crossing_streets(S.ways(spark, sf_dir))


@query("match_cross_street", f"""WITH {WAYS}, {CORPUS},
    v_pair AS (SELECT DISTINCT query AS q, least('elm' || (query_id % 50), 'elm' || (o_custkey % 50)) AS a,
        greatest('elm' || (query_id % 50), 'elm' || (o_custkey % 50)) AS b
      FROM v_queries JOIN orders ON o_orderkey = query_id WHERE query_id % 6 = 3 AND query_id % 50 <> o_custkey % 50)
    SELECT q, name_a, name_b, lat_q / 100000.0 AS lat, lon_q / 100000.0 AS lon FROM v_pair JOIN v_intersections ON a = name_a AND b = name_b
    UNION ALL SELECT DISTINCT query, name_a, name_b, lat_q / 100000.0, lon_q / 100000.0 FROM v_queries JOIN v_intersections
      ON query IN ('red', 'elm7') AND (name_a = query OR name_b = query)""")
def match_cross_street(spark, sf_dir):
    return L.match_cross_street(S.place_queries(spark, sf_dir), crossings(spark, sf_dir))


def fuzzy_inputs(spark, sf_dir):
    q = S.place_queries(spark, sf_dir).select(F.lower("query").alias("query"))
    return q, landmarks(spark, sf_dir)


@query("fuzzy_match", f"""WITH {CORPUS}, q AS (SELECT DISTINCT lower(query) AS query FROM v_queries),
    s AS (SELECT q.query, m.name, 1.0 - levenshtein(q.query, m.name) * 1.0 / greatest(length(q.query), length(m.name)) AS score
          FROM q JOIN v_marks m ON abs(length(q.query) - length(m.name)) <= 4
          WHERE levenshtein(q.query, m.name) <= floor((length(q.query) + length(m.name)) * 0.05))
    SELECT query, arg_min(name, struct_pack(s := -score, n := name)) AS name, round(max(score), 6) AS score
    FROM s WHERE score >= 0.95 GROUP BY query""")
def fuzzy_match(spark, sf_dir):
    q, names = fuzzy_inputs(spark, sf_dir)
    return L.fuzzy_match(q, names, exact_ratio=False).withColumn("score", F.round("score", 6))


@query("fuzzy_match_ratio")
def fuzzy_match_ratio(spark, sf_dir):
    return L.fuzzy_match(*fuzzy_inputs(spark, sf_dir))


def corpus(spark, sf_dir):
    st = Feed.from_tables(spark, sf_dir).stops
    return L.prefix_corpus(st.where(F.col("kind") == "station"), landmarks(spark, sf_dir),
                           st.where(F.col("kind") == "bus"), addresses(spark, sf_dir))


SCORE = "{base} + CASE WHEN {exact} THEN 100 ELSE 0 END + 50 - (7917.6 * asin(sqrt(pow(sin((radians(lat) - radians(41.8827)) / 2), 2) + cos(radians(41.8827)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-87.6326)) / 2), 2))))"
SUGGEST = f"""{WAYS}, {CORPUS},
   v_bus AS (SELECT lower(name) AS key, arg_min(name, CAST(stop_id AS VARCHAR)) AS label, arg_min(lat, CAST(stop_id AS VARCHAR)) AS lat,
       arg_min(lon, CAST(stop_id AS VARCHAR)) AS lon FROM v_stops WHERE kind = 'bus' GROUP BY 1),
   v_corpus AS (SELECT 1 AS tier, 1100 AS base, lower(name) AS key, name AS label, lat, lon FROM v_stops WHERE kind = 'station'
     UNION ALL SELECT 2, 1000, name, 'Supplier Plaza ' || name[16:24] || ' Avenue', lat, lon FROM v_marks
     UNION ALL SELECT 4, 700, key, label, lat, lon FROM v_bus
     UNION ALL SELECT 5, 600, normalized, raw, lat, lon FROM v_addr),
   v_in AS (SELECT * FROM v_corpus WHERE lat BETWEEN 41.64 AND 42.02 AND lon BETWEEN -87.94 AND -87.52),
   v_q AS (SELECT DISTINCT trim(query) AS q, lower(trim(query)) AS typed, {address_sql('query')} AS norm FROM v_queries),
   v_cq AS (SELECT DISTINCT trim(query) AS q, CASE WHEN query_id % 6 = 3 THEN
        CASE WHEN query_id % 50 <> o_custkey % 50 THEN least('elm' || (query_id % 50), 'elm' || (o_custkey % 50)) || '|' ||
          greatest('elm' || (query_id % 50), 'elm' || (o_custkey % 50)) END
        WHEN query IN ('red', 'elm7', 'small ') THEN trim(query) END AS ask FROM v_queries JOIN orders ON o_orderkey = query_id),
   v_hits AS (SELECT q, tier, key, label, lat, lon, {SCORE.format(base='base', exact='key = CASE WHEN tier = 5 THEN norm ELSE typed END')} AS score
       FROM v_q JOIN v_in ON starts_with(key, CASE WHEN tier = 5 THEN CASE WHEN regexp_matches(norm, '^\\d') THEN norm ELSE '~' END ELSE typed END)
     UNION ALL SELECT q, 3, name_a || '|' || name_b, raw_a || ' & ' || raw_b, lat, lon, {SCORE.format(base='800', exact="ask LIKE '%|%'")}
       FROM v_cq JOIN (SELECT *, lat_q / 100000.0 AS lat, lon_q / 100000.0 AS lon FROM v_intersections) i
         ON ask = name_a || '|' || name_b OR ask = name_a OR ask = name_b
       WHERE lat BETWEEN 41.64 AND 42.02 AND lon BETWEEN -87.94 AND -87.52),
   v_ranked AS (SELECT *, row_number() OVER (PARTITION BY q, tier ORDER BY score DESC, key, label, lat, lon) AS place FROM v_hits)"""


@query("autocomplete_tiers", with_views(["v_stops"], """
    SELECT q, list_extract(['train_station','neighborhood','intersection','bus_stop','address'], tier) AS source,
           count(*) AS n, round(sum(score), 4) AS score, min(label) AS label FROM
      (SELECT * FROM v_ranked WHERE place <= 3 QUALIFY row_number() OVER (PARTITION BY q, tier, lower(label) ORDER BY place) = 1)
    GROUP BY ALL""", SUGGEST))
def autocomplete_tiers(spark, sf_dir):
    """Three best per tier, less repeated labels, summed up per tier."""
    s = L.autocomplete(S.place_queries(spark, sf_dir), corpus(spark, sf_dir), crossings(spark, sf_dir), limit=15)
    return s.groupBy("q", "source").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"),
                                        F.min("label").alias("label"))


@query("autocomplete")
def autocomplete(spark, sf_dir):
    return L.autocomplete(S.place_queries(spark, sf_dir), corpus(spark, sf_dir), crossings(spark, sf_dir))


#: Names at or above the similarity floor of what no landmark equals, by the matching-block ratio: the longest
#: common block, earliest in the name, then in the query; the same left and right of it.
FUZZY = """v_typed AS (SELECT DISTINCT lower(query) || CASE query_id % 6 WHEN 1 THEN 'nue' ELSE '' END AS t FROM v_queries WHERE query_id % 6 IN (1, 2)),
   v_close AS (SELECT t, name FROM v_typed JOIN v_marks ON levenshtein(t, name) <= floor((length(t) + length(name)) * 0.05 + 1e-9)
      WHERE t NOT IN (SELECT name FROM v_marks)),
   v_block(t, name, spot, a, b, m) AS (
      SELECT t, name, '', name, t, 0::BIGINT FROM v_close
      UNION ALL
      SELECT t, name, spot || side, CASE side WHEN 'l' THEN a[:i - 1] ELSE a[i + k:] END, CASE side WHEN 'l' THEN b[:j - 1] ELSE b[j + k:] END,
        CASE side WHEN 'l' THEN k ELSE 0 END
      FROM (SELECT *, row_number() OVER (PARTITION BY t, name, spot ORDER BY k DESC, i, j) AS best FROM (
          SELECT t, name, spot, a, b, i, j, len(list_filter(range(1, least(len(a) - i, len(b) - j) + 2), lambda x: a[i:i + x - 1] = b[j:j + x - 1])) AS k
          FROM v_block, range(1, len(a) + 1) x(i), range(1, len(b) + 1) y(j) WHERE a[i] = b[j])), (VALUES ('l'), ('r')) s(side) WHERE best = 1),
   v_alike AS (SELECT t, name, 2.0 * sum(m) / (length(t) + length(name)) AS score FROM v_block GROUP BY t, name),
   v_fuzzy AS (SELECT t, arg_min(v_marks.lat, struct_pack(s := -score, n := name)) AS lat FROM v_alike JOIN v_marks USING (name) WHERE score >= 0.95 GROUP BY t)"""


@query("geocode", with_views(["v_stops"], """
    SELECT query_id, CASE query_id % 6 WHEN 0 THEN 'coordinates' WHEN 1 THEN CASE WHEN m.name IS NOT NULL THEN 'landmark' WHEN f.t IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END
        WHEN 2 THEN CASE WHEN f.t IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END
        ELSE CASE WHEN r.q IS NOT NULL THEN 'suggestion' ELSE 'unresolved' END END AS tier,
      round(CASE query_id % 6 WHEN 0 THEN CAST('41.' || lpad(CAST(query_id % 60 AS VARCHAR), 2, '0') AS DOUBLE)
        WHEN 1 THEN coalesce(m.lat, f.lat) WHEN 2 THEN f.lat ELSE r.lat END, 5) AS lat,
      query_id % 6 = 0 AND CAST('41.' || lpad(CAST(query_id % 60 AS VARCHAR), 2, '0') AS DOUBLE) < 41.64 AS outside_city
    FROM v_queries v LEFT JOIN v_marks m ON query_id % 6 = 1 AND m.name = lower(query) || 'nue'
    LEFT JOIN v_fuzzy f ON query_id % 6 IN (1, 2) AND f.t = lower(query) || CASE query_id % 6 WHEN 1 THEN 'nue' ELSE '' END
    LEFT JOIN (SELECT q, arg_min(lat, struct_pack(t := tier, p := place)) AS lat FROM v_ranked GROUP BY q) r
      ON query_id % 6 > 2 AND r.q = trim(query)""", SUGGEST + ", " + FUZZY).replace("WITH ", "WITH RECURSIVE ", 1))
def geocode(spark, sf_dir):
    q, marks = S.place_queries(spark, sf_dir), landmarks(spark, sf_dir)
    return L.geocode(q, marks, corpus(spark, sf_dir), crossings(spark, sf_dir)).select(
        "query_id", "tier", F.round("lat", 5).alias("lat"), "outside_city")


@query("reverse_geocode", f"""WITH {CORPUS},
    v_p AS (SELECT p_partkey AS point_id, 41.64 + (p_partkey * 3571 % 3800) / 10000.0 + (p_partkey % 5) / 5000.0 AS lat,
        -87.94 + (p_partkey * 2741 % 4200) / 10000.0 AS lon FROM part),
    v_c AS (SELECT DISTINCT round(lat * 100000) AS a, round(lon * 100000) AS b FROM v_p WHERE point_id % 10 = 0),
    v_m AS (SELECT p.point_id, arg_min(m.name, struct_pack(d := {miles('p', 'm')}, n := m.name)) AS name
      FROM v_p p JOIN v_marks m ON abs(p.lat - m.lat) < 0.01 AND abs(p.lon - m.lon) < 0.01
      WHERE {miles('p', 'm')} <= 200.0 / 1609.344 GROUP BY 1),
    v_a AS (SELECT p.point_id, arg_min(a.raw, struct_pack(d := {miles('p', 'a')}, n := a.raw)) AS raw
      FROM v_p p JOIN v_addr a ON abs(p.lat - a.lat) < 0.01 AND abs(p.lon - a.lon) < 0.01
      WHERE {miles('p', 'a')} < 50.0 / 1609.344 GROUP BY 1)
    SELECT point_id, CASE WHEN v_c.a IS NOT NULL THEN 'cached' WHEN name IS NOT NULL THEN 'Supplier Plaza ' || name[16:24] || ' Avenue'
        WHEN raw IS NOT NULL THEN raw ELSE printf('%.5f, %.5f', lat, lon) END AS label,
      CASE WHEN v_c.a IS NOT NULL THEN 'cached_reverse' WHEN name IS NOT NULL THEN 'neighborhood'
        WHEN raw IS NOT NULL THEN 'address' ELSE 'coordinates' END AS source
    FROM v_p LEFT JOIN v_c ON round(lat * 100000) = v_c.a AND round(lon * 100000) = v_c.b
    LEFT JOIN v_m USING (point_id) LEFT JOIN v_a USING (point_id)""")
def reverse_geocode(spark, sf_dir):
    key = F.col("p_partkey")
    pts = S.table(spark, sf_dir, "part").select(
        key.alias("point_id"), (S.lat_of(key, 3571) + (key % 5) / 5000.0).alias("lat"), S.lon_of(key, 2741).alias("lon"))
    known = pts.where(F.col("point_id") % 10 == 0).select(
        geo.quantise(F.col("lat")).alias("lat_q"), geo.quantise(F.col("lon")).alias("lon_q"), F.lit("cached").alias("label"))
    return L.reverse_geocode(pts, known, landmarks(spark, sf_dir), addresses(spark, sf_dir)).select("point_id", "label", "source")


# --- result cache ---------------------------------------------------------------

NOW = 1_704_067_200


def cache_parts(spark, sf_dir):
    c, key = S.table(spark, sf_dir, "customer"), F.col("c_custkey")
    o = S.table(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit(" Elm"), k, F.lit(" St"))
    pair = lambda k: F.concat(F.lit("["), F.lit("41."), k % 10, F.lit(", -87."), k % 10, F.lit("]"))
    snap = c.select(name(key).alias("key"), key.alias("seq"),
                    F.when(key % 7 == 0, "null").when(key % 11 == 0, '["x"]').otherwise(pair(key)).alias("value"))
    ok = F.col("o_orderkey")
    jour = o.select(F.concat(F.lit("elm"), F.col("o_custkey"), F.when(ok % 2 == 0, " street").otherwise(" st")).alias("key"),
                    ok.alias("seq"), F.when(ok % 5 == 0, "null").otherwise(pair(ok)).alias("value"))
    ages = c.where(key % 2 == 0).select(name(key).alias("key"), (F.lit(NOW) - key * 10000).cast("double").alias("recorded_at"))
    ages = ages.unionByName(c.where(key % 3 == 0).select(
        F.concat(F.lit("elm"), key, F.lit(" st")).alias("key"), (F.lit(NOW) - key * 5000).cast("double").alias("recorded_at")))
    return snap, jour, ages


CACHE = f"""e AS (SELECT ' Elm' || c_custkey || ' St' AS key, 0 AS phase, c_custkey AS seq,
        CASE WHEN c_custkey % 7 = 0 THEN 'negative' WHEN c_custkey % 11 = 0 THEN 'malformed' ELSE 'positive' END AS state, c_custkey % 10 AS d FROM customer
      UNION ALL SELECT 'elm' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' street' ELSE ' st' END, 1, o_orderkey,
        CASE WHEN o_orderkey % 5 = 0 THEN 'negative' ELSE 'positive' END, o_orderkey % 10 FROM orders),
    k AS (SELECT key, arg_max(state, phase * 1e12 + seq) AS state, arg_max(d, phase * 1e12 + seq) AS d, min(phase * 1e12 + seq) AS first_seen FROM e GROUP BY 1),
    c AS (SELECT 'elm' || regexp_extract(key, '(\\d+)', 1) || ' street' AS query, state, d, first_seen,
        greatest(least(coalesce(CASE WHEN key LIKE ' Elm%' AND CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT) % 2 = 0
          THEN {NOW} - CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT) * 10000
          WHEN key LIKE 'elm% st' AND CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT) % 3 = 0
          THEN {NOW} - CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT) * 5000 END, {NOW} - 30 * 86400), {NOW} - 86400), {NOW} - 60 * 86400) AS fetched_at
      FROM k WHERE state <> 'malformed'),
    r AS (SELECT query, CASE WHEN arg_max(state, first_seen) = 'positive' THEN CAST('41.' || arg_max(d, first_seen) AS DOUBLE) END AS lat,
        CASE WHEN arg_max(state, first_seen) = 'positive' THEN CAST('-87.' || arg_max(d, first_seen) AS DOUBLE) END AS lon,
        CAST(arg_max(fetched_at, first_seen) AS BIGINT) AS fetched_at, count(*) - 1 AS collisions FROM c GROUP BY 1)"""


@query("replay_cache", f"WITH {CACHE} SELECT * FROM r")
def replay_cache(spark, sf_dir):
    return C.replay_cache(*cache_parts(spark, sf_dir), now=NOW)


@query("replay_summary", f"""WITH {CACHE} SELECT count(*) AS keys, count(CASE WHEN state = 'positive' THEN 1 END) AS positive,
    count(CASE WHEN state = 'negative' THEN 1 END) AS negative, count(CASE WHEN state = 'malformed' THEN 1 END) AS malformed FROM k""")
def replay_summary(spark, sf_dir):
    snap, jour, _ = cache_parts(spark, sf_dir)
    return C.replay_summary(snap, jour)


@query("evict_older_than", f"WITH {CACHE} SELECT query, fetched_at FROM r WHERE fetched_at >= {NOW} - 29 * 86400")
def evict_older_than(spark, sf_dir):
    rows = C.replay_cache(*cache_parts(spark, sf_dir), now=NOW)
    return C.evict_older_than(rows, 29, NOW)[0].select("query", "fetched_at")
