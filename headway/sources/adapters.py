"""Views of the driver's tables in the shapes the operators expect.

Every view is a plain projection or aggregation of a whole table, so the work
grows with the data. The same shapes are spelled out in SQL in `plans.views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timecode import minutes_text

USER_AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)",
    "Mozilla/5.0 (Windows NT 10.0; Win64)",
    "Mozilla/5.0 (iPad; CPU OS 17_0)",
    "Examplebot/2.1",
    "",
    "Mozilla/5.0 (Linux; Android 14; Mobile)",
]
EVENT_NAMES = {
    "view": "app_loaded",
    "click": "recommend_submitted",
    "signup": "recommend_returned",
    "purchase": "trip_completed",
}
SERVICES = [  # service_id, Monday..Sunday
    ("S1", 1, 1, 1, 1, 1, 0, 0),
    ("S2", 0, 0, 0, 0, 0, 1, 0),
    ("S3", 0, 0, 0, 0, 0, 0, 1),
    ("S4", 0, 0, 0, 0, 0, 1, 1),
    ("S5", 1, 1, 1, 1, 1, 1, 1),
]
DAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def ip_text(n: Column) -> Column:
    octet = lambda s: F.shiftright(n, s).bitwiseAND(255).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit log: one visit per event, same user = same sid, rid and address."""
    e = table(spark, sf_dir, "events")
    return visits_from_events(e)


def visits_from_events(e: DataFrame) -> DataFrame:
    name = F.coalesce(
        *[F.when(F.col("event_type") == k, v) for k, v in EVENT_NAMES.items()],
        F.col("event_type"),
    )
    return e.select(
        F.col("event_id").alias("visit_id"),
        "ts",
        F.when(F.col("event_type").isin("click", "purchase"), "/recommend")
        .otherwise("/ping").alias("path"),
        ip_text((F.col("user_id") * 2862933) % 4294967296).alias("ip"),
        pick(USER_AGENTS, F.pmod(F.floor(F.col("value")), F.lit(6))).alias("user_agent"),
        F.col("user_id").cast("string").alias("sid"),
        F.col("user_id").cast("string").alias("rid"),
        name.alias("event_name"),
    )


def dense_requests(visits: DataFrame) -> DataFrame:
    """The visits with their days squeezed 2000-fold, so that limits are reached."""
    start = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    past = f"timestampdiff(MICROSECOND, {start}, cast(ts as timestamp_ntz))"
    return visits.withColumn("ts", F.expr(f"timestampadd(MICROSECOND, cast(floor({past} / 2000) as int), {start})"))


def referers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int"))
    return p.select(F.col("page_id").alias("visit_id"), day.alias("day"),
                    F.col("url").alias("referer"))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    start = F.col("n_nationkey").cast("bigint") * 171798691
    return n.select(start.alias("start_ip"), (start + 120000000).alias("end_ip"),
                    F.col("n_name").alias("city"))


def visits_both_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits; every third user comes by an IPv6 address, in short and long spellings."""
    v, user = visits(spark, sf_dir), F.col("sid").cast("bigint")
    group = lambda n: F.lower(F.hex(n))
    six = F.when(user % 2 == 0, F.concat(F.lit("2001:db8:"), group(user % 4096), F.lit("::"), group(user % 60000))).otherwise(
        F.concat(F.lit("2001:0DB8:"), group(user % 4096), F.lit(":0:0:0:0:"), group(user % 60000)))
    return v.withColumn("ip", F.when(user % 3 == 0, six).otherwise(F.col("ip")))


def networks_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 networks of 64 /48 blocks a nation, the first two of which are a smaller network of the next one."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("bigint")
    at = F.concat(F.lit("2001:db8:"), F.lower(F.hex(k * 128)), F.lit("::"))
    return n.select(F.concat(at, F.lit("/42")).alias("network"), F.col("n_name").alias("city")).unionByName(
        n.select(F.concat(at, F.lit("/47")).alias("network"), F.concat(F.col("n_name"), F.lit(" inner")).alias("city")))


def stop_id_of(part: Column) -> Column:
    """A quarter of the parts are stations, a quarter platforms, the rest bus stops."""
    slot = F.floor(part / 4) % 10000
    return (
        F.when(part % 4 == 0, slot + 40000).when(part % 4 == 1, slot + 30000)
        .otherwise(part % 30000).cast("bigint").cast("string")
    )


def lat_of(key: Column, a: int = 7919) -> Column:
    return F.lit(41.64) + (key * a % 3800) / F.lit(10000.0)


def lon_of(key: Column, a: int | None = None) -> Column:
    n = key * key * 31 + key * 17 if a is None else key * a
    return F.lit(-87.94) + (n % 4200) / F.lit(10000.0)


def stops_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stops table as text, the way a feed delivers it."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        stop_id_of(key).alias("stop_id"),
        F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand")).alias("stop_name"),
        lat_of(key).cast("string").alias("stop_lat"),
        lon_of(key).cast("string").alias("stop_lon"),
        F.when(key % 4 == 0, "1").otherwise("0").alias("location_type"),
        F.when(key % 4 == 1, (F.floor(key / 4) % 10000 + 40000).cast("bigint").cast("string"))
        .otherwise("").alias("parent_station"),
    )


def routes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 routes; the first eight are rail."""
    c = table(spark, sf_dir, "customer")
    n = (F.col("c_custkey") % 40).alias("n")
    k = F.col("n")
    colour = F.when(k % 5 == 0, "B71234").when(k % 5 == 1, "414145").otherwise("565a5c")
    return c.groupBy(n).agg(F.count("*").alias("riders")).select(
        F.concat(F.lit("R"), k).alias("route_id"),
        F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("route_short_name"),
        F.concat(F.lit("Route "), k).alias("route_long_name"),
        F.when(k < 8, "1").otherwise("3").alias("route_type"),
        colour.alias("route_color"),
    )


def trips_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("R"), F.col("o_custkey") % 40).alias("route_id"),
        F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("service_id"),
        key.cast("string").alias("trip_id"),
        (key % 2).cast("string").alias("direction_id"),
        F.concat(F.lit("H"), F.col("o_custkey") % 40, F.lit("-"), key % 3).alias("shape_id"),
        F.concat(F.lit("To "), F.col("o_orderstatus")).alias("trip_headsign"),
    )


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its place `ln` in its order, as line numbers repeat; p is the part."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.row_number().over(place).cast("bigint").alias("ln"), F.col("l_partkey").alias("p"), "l_suppkey")


def stop_times_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call of a trip per line item; see `call_lines` for its sequence number."""
    key, seq = F.col("l_orderkey"), F.col("ln")
    minutes = key * 37 % 1700 + seq * 4
    return call_lines(spark, sf_dir).select(
        key.cast("string").alias("trip_id"),
        F.when((key + seq) % 11 == 0, "").otherwise(minutes_text(minutes)).alias("arrival_time"),
        minutes_text(minutes).alias("departure_time"),
        stop_id_of(F.col("p")).alias("stop_id"),
        seq.cast("string").alias("stop_sequence"),
        F.lit("").alias("stop_headsign"),
    )


def calendar_raw(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        "('" + "', '".join([s[0], *map(str, s[1:]), "20240101", "20241231"]) + "')" for s in SERVICES
    )
    cols = ", ".join(["service_id", *DAY_NAMES, "start_date", "end_date"])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({cols})")


def calendar_dates_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added (1) and removed (2) dates taken from the order dates of each service."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    return (
        o.groupBy(F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("service_id"),
                  F.date_format(d, "yyyyMMdd").alias("date"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") % 3 == 0)
        .select("service_id", "date", F.when(F.col("n") % 2 == 0, "2").otherwise("1")
                .alias("exception_type"))
    )


def shapes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape points from customers: 40 routes x 4 variants, one of them unused."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.concat(F.lit("H"), key % 40, F.lit("-"), F.floor(key / 40) % 4).alias("shape_id"),
        lat_of(key).cast("string").alias("shape_pt_lat"),
        lon_of(key).cast("string").alias("shape_pt_lon"),
        F.floor(key / 40).cast("string").alias("shape_pt_sequence"),
    )


def transfers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers between stations from supplier pairs of neighbouring keys."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        stop_id_of(key).alias("from_stop_id"),
        stop_id_of(F.floor(key / 4) * 4 + key % 12).alias("to_stop_id"),
        F.lit("2").alias("transfer_type"),
        F.when(key % 6 == 0, "").otherwise((key * 13 % 600).cast("string"))
        .alias("min_transfer_time"),
    )


def gtfs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All raw feed tables, before coercion."""
    return {
        "stops": stops_raw(spark, sf_dir),
        "routes": routes_raw(spark, sf_dir),
        "trips": trips_raw(spark, sf_dir),
        "stop_times": stop_times_raw(spark, sf_dir),
        "transfers": transfers_raw(spark, sf_dir),
        "shapes": shapes_raw(spark, sf_dir),
        "calendar": calendar_raw(spark),
        "calendar_dates": calendar_dates_raw(spark, sf_dir),
    }


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(key.alias("point_id"), lat_of(key, 6007).alias("lat"),
                    lon_of(key, 15013).alias("lon"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(key.alias("target_id"), lat_of(key).alias("lat"), lon_of(key).alias("lon"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short two-piece streets, one per customer, 50 names in several spellings."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    lat, lon = lat_of(key, 6007), lon_of(key, 15013)
    pt = lambda dy, dx: F.struct((lat + dy).alias("lat"), (lon + dx).alias("lon"))
    off = lambda m, n: ((key * m) % n - F.floor(n / 2)) / 10000.0
    name = F.concat(
        pick(["N ", "West ", "", "SE "], key % 4), F.lit("Elm"), key % 50,
        pick([" St", " Avenue", " Blvd", ""], key % 3))
    return c.select(
        key.alias("way_id"), name.alias("name"),
        F.array(pt(F.lit(0.0), F.lit(0.0)), pt(off(13, F.lit(160)), off(29, F.lit(160))),
                pt(off(37, F.lit(240)), off(53, F.lit(240)))).alias("geometry"))


def od_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin-destination pairs: every supplier to a point a few miles away."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    lat, lon = lat_of(key, 7211), lon_of(key, 9973)
    return s.select(
        key.alias("od_id"), lat.alias("o_lat"), lon.alias("o_lon"),
        (lat + ((key * 31) % 600 - 300) / 10000.0).alias("d_lat"),
        (lon + ((key * 17) % 600 - 300) / 10000.0).alias("d_lon"))


def entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station entrances: each station part shifted a little, some unlabelled."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        key.alias("entrance_id"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Exit "), F.col("p_brand"))).alias("label"),
        (lat_of(F.floor(key / 4) * 4) + (key % 7) / 2000.0).alias("lat"),
        (lon_of(F.floor(key / 4) * 4) + (key % 5) / 2000.0).alias("lon"))


def landmarks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmark documents: a JSON map with one entry per supplier."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lower(F.regexp_replace("s_name", "#", " plaza ")), F.lit(" avenue"))
    point = F.array(lat_of(key, 3571), lon_of(key, 2741))
    return s.select(F.to_json(F.create_map(name, point)).alias("value"))


def osm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small map extract per customer: an address node or a building centre."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    lat, lon = lat_of(key, 3571), lon_of(key, 2741)
    street = F.concat(
        pick(["N ", "West ", "", "SE "], key % 4), F.lit("Elm"), key % 50,
        pick([" St", " Avenue", " Blvd."], key % 3))
    tags = F.create_map(
        F.lit("addr:housenumber"), F.when(key % 13 == 0, "").otherwise((key % 900).cast("string")),
        F.lit("addr:street"), street)
    node = key % 2 == 0
    centre = F.struct(lat.alias("lat"), lon.alias("lon"))
    el = F.struct(
        F.when(node, "node").otherwise("way").alias("type"), key.alias("id"),
        F.when(node, lat).alias("lat"), F.when(node, lon).alias("lon"),
        F.when(~node, centre).alias("center"), tags.alias("tags"))
    return c.select(F.to_json(F.struct(F.array(el).alias("elements"))).alias("value"))


def place_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places of six kinds, one per order."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n_sup = F.col("o_custkey") % 100
    plaza = F.concat(F.lit("Supplier plaza "), F.lpad(n_sup.cast("string"), 9, "0"))
    return o.select(
        key.alias("query_id"),
        F.when(key % 6 == 0, F.concat(F.lit("41."), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(", -87.7")))
        .when(key % 6 == 1, F.concat(plaza, F.lit(" ave")))
        .when(key % 6 == 2, F.concat(F.regexp_replace(plaza, "plaza", "plza"), F.lit(" avenue")))
        .when(key % 6 == 3, F.concat(F.lit("N Elm"), key % 50, F.lit(" St and Elm"), F.col("o_custkey") % 50,
                                     F.lit(" Blvd")))
        .when(key % 6 == 4, F.concat((key % 900).cast("string"), F.lit(" W Elm"), F.col("o_custkey") % 50, F.lit(" St")))
        .otherwise(F.concat(pick(["small ", "red", "elm7", "blue gear & b", "Supplier p"], key % 5), F.lit("")))
        .alias("query"))


def street_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street grid 40 nodes wide, one node per part; every 23rd has a twin 5 m off."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    twin = F.when(key % 23 == 22, F.lit(1)).otherwise(F.lit(0))
    col, row = key % 40 - twin, F.floor(key / 40)
    return p.select(
        key.alias("node"), (F.lit(41.80) + row * 0.001 + twin * 0.00004).alias("lat"),
        (F.lit(-87.75) + col * 0.0014).alias("lon"))


def street_edges_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges east, north and back west, some of them service ways."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    edge = lambda u, v, no: F.struct(
        u.alias("u"), v.alias("v"), (key * 3 + no).alias("edge_id"), F.lit(no).alias("side"))
    e = p.select("p_partkey", F.inline(F.array(edge(key, key + 1, 0), edge(key, key + 40, 1), edge(key + 1, key, 2))))
    real = p.select(key.alias("v2"))
    inside = e.where((F.col("side") == 1) | (F.greatest("u", "v") % 40 != 0))
    k = F.col("p_partkey")
    return inside.join(real, F.greatest("u", "v") == F.col("v2"), "left_semi").select(
        "edge_id", "u", "v", (F.lit(112.0) + k % 7 * 10 + F.col("side")).alias("length"),
        F.when(F.col("side") == 1, F.concat(F.lit("Oak"), k % 40)).when(k % 9 == 0, "")
        .otherwise(F.concat(F.lit("Elm"), F.floor(k / 40))).alias("name"),
        F.when(k % 17 == 0, "service").when(k % 9 == 0, "footway").otherwise("residential").alias("highway"),
        F.when(k % 27 == 0, "crossing").otherwise("").alias("footway"))


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of 25 edges along consecutive parts."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        F.floor(k / 25).alias("path_id"), (k % 25).alias("edge_no"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Elm"), F.floor(k / 3) % 5)).alias("name"),
        F.when(k % 14 == 0, "footway").otherwise("residential").alias("highway"),
        F.when(k % 28 == 0, "crossing").otherwise("").alias("footway"),
        (F.lit(60.0) + k * 13 % 200).alias("length"),
        lat_of(k).alias("lat1"), lon_of(k, 2741).alias("lon1"),
        lat_of(k + 1).alias("lat2"), lon_of(k + 1, 2741).alias("lon2"))


# --- live payloads, built from the orders table and then read back -------------

NOW_LOCAL = "2024-01-10 08:00:00"


def _now():
    return F.lit(NOW_LOCAL).cast("timestamp_ntz")


def _after(seconds: Column) -> Column:
    return _now() + F.make_interval(secs=seconds.cast("decimal(18,6)"))


def train_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arrivals payload per order: a single object or a list, some in error."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first, second = _after(k * 37 % 3600 - 300), _after(k * 37 % 3600 + 270)
    eta = lambda at, bad: F.struct(
        F.concat(F.lit("Stop "), k % 50).alias("staNm"), F.lit("Service toward").alias("stpDe"),
        pick(["Howard", "95th", "Loop", "Kimball"], k % 4).alias("destNm"),
        pick(["Red", "Brn", "G", "Zz"], F.col("o_custkey") % 4).alias("rt"),
        F.when(bad, "soon").otherwise(at).alias("arrT"),
        F.when(k % 3 == 0, "1").otherwise("0").alias("isApp"),
        F.when(k % 5 == 0, "1").otherwise("0").alias("isDly"), F.lit("0").alias("isSch"))
    iso = eta(F.date_format(first, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(False))
    flat = eta(F.date_format(second, "yyyyMMdd HH:mm:ss"), k % 7 == 0)
    head = lambda e: F.struct(
        F.when(k % 50 == 0, "101").otherwise("0").alias("errCd"), F.lit("limit").alias("errNm"), e.alias("eta"))
    body = F.when(k % 2 == 0, F.to_json(F.struct(head(iso).alias("ctatt")))).otherwise(
        F.to_json(F.struct(head(F.array(iso, flat)).alias("ctatt"))))
    return o.select((F.lit(40000) + k % 50).cast("string").alias("station_id"),
                    F.lit("Station").alias("station_label"), _now().alias("now"), body.alias("body"),
                    k.alias("payload_id"))


def bus_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    prd = F.struct(
        F.concat(F.lit(""), F.col("o_custkey") % 40).alias("rt"), pick(["Northbound", "Eastbound"], k % 2).alias("rtdir"),
        (k % 200).cast("string").alias("stpid"), F.concat(F.lit("Corner "), k % 200).alias("stpnm"),
        pick(["Lake", "Park", "Pier"], k % 3).alias("des"),
        F.when(k % 6 == 0, "DUE").otherwise((k * 7 % 40).cast("string")).alias("prdctdn"),
        pick(["true", "1", "no", "Yes"], k % 4).alias("dly"), pick(["Empty", "Half Empty", "Full", ""], k % 4).alias("psgld"))
    body = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(prd.alias("prd")).alias("bustime-response")))).otherwise(
        F.to_json(F.struct(F.struct(F.array(prd).alias("prd")).alias("bustime-response"))))
    return o.select(k.alias("payload_id"), body.alias("body"))


def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and XML forms of one alert per order; ids repeat."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    score = (k * 13 % 100).cast("string")
    route = pick(["red", "brn", "22", "X9"], k % 4)
    svc = F.struct(route.alias("ServiceId"))
    alert = lambda s: F.struct(
        (k % 500).cast("string").alias("AlertId"), F.concat(F.lit("Notice "), k % 500).alias("Headline"),
        F.lit("Delay").alias("Impact"), score.alias("SeverityScore"),
        F.when(k % 3 == 0, "").otherwise("2024-02-01").alias("EventEnd"),
        F.struct(s.alias("Service")).alias("ImpactedService"))
    body = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(alert(svc).alias("Alert")).alias("CTAAlerts")))).otherwise(
        F.to_json(F.struct(F.struct(F.array(alert(F.array(svc, F.struct(F.lit("7").alias("ServiceId"))))).alias("Alert")).alias("CTAAlerts"))))
    name = pick(["Red Line", "Brown Line", "22", " X9 "], k % 4)
    xml = F.concat(
        F.lit("<CTAAlerts><Alert><AlertId>"), k % 500, F.lit("</AlertId><Headline>Notice "), k % 500,
        F.lit("</Headline><SeverityScore>"), score, F.lit("</SeverityScore><ImpactedService><Service><ServiceName>"), name,
        F.lit("</ServiceName></Service><Service><ServiceName>7</ServiceName></Service></ImpactedService></Alert></CTAAlerts>"))
    return o.select(k.alias("seq"), body.alias("body"), xml.alias("xml"))


def service_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route status, vehicle position and bus route payloads, one set per customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    status = F.struct(F.struct(F.struct(
        (k % 40).cast("string").alias("ServiceId"), F.concat(F.lit("Route "), k % 40).alias("Route"),
        F.when(k % 5 == 0, "Significant Delays").otherwise("Normal Service").alias("RouteStatus"),
        F.lit("404040").alias("RouteStatusColor")).alias("RouteInfo")).alias("CTARoutes"))
    train = F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.struct(i.cast("string").alias("rn")))
    one = F.struct(F.lit("0").alias("errCd"), F.struct(
        pick(["Red", "G", "P"], k % 3).alias("@name"), F.filter(train, lambda t: t["rn"] != "0").alias("train")).alias("route"))
    bus = F.struct(F.struct(F.array(F.struct(
        (k % 60).cast("string").alias("rt"), F.concat(F.lit("Feed "), k % 60).alias("rtnm"),
        F.lit("#aabbcc").alias("rtclr"))).alias("routes")).alias("bustime-response"))
    return c.select(k.alias("payload_id"), F.to_json(status).alias("status"),
                    F.to_json(F.struct(one.alias("ctatt"))).alias("positions"), F.to_json(bus).alias("buses"))


TEXTS = ["Sunny", "Light Rain", "Heavy Snow", "Freezing Drizzle", "Sleet", "Scattered Flurries", "Rain Showers", "Blizzard"]


def forecast_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen periods per order line number group: one payload per customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    period = lambda i: F.struct(
        F.concat(F.lit("2024-01-10T"), F.lpad(((k + i) % 24).cast("string"), 2, "0"), F.lit(":00:00-06:00")).alias("startTime"),
        ((k * 7 + i * 5) % 130 - 20).cast("double").alias("temperature"), F.when(k % 4 == 0, "C").otherwise("F").alias("temperatureUnit"),
        pick(TEXTS, (k + i) % 8).alias("shortForecast"),
        F.when(i % 2 == 0, F.concat((k + i) % 30, F.lit(" mph"))).otherwise(F.concat(F.lit("5 to "), (k + i) % 30 + 5, F.lit(" mph"))).alias("windSpeed"),
        F.when(i % 3 == 0, "").otherwise(F.concat((k + i) % 60, F.lit(" mph"))).alias("windGust"),
        F.struct(F.when(i % 5 == 0, F.lit(None)).otherwise((k + i) % 100).cast("double").alias("value")).alias("relativeHumidity"))
    periods = F.transform(F.sequence(F.lit(0), F.lit(13)), period)
    body = F.to_json(F.struct(F.struct(periods.alias("periods")).alias("properties")))
    head = F.transform(F.sequence(F.lit(0), k % 6), lambda i: F.struct(F.struct(
        F.when(i % 2 == 0, F.concat(F.lit("Warning "), i % 4)).alias("headline"), F.concat(F.lit("Event "), i).alias("event")).alias("properties")))
    return c.select(k.alias("payload_id"), body.alias("body"), F.to_json(F.struct(head.alias("features"))).alias("alerts"))


def trip_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast before the departure of every pair, in one of three cells, up to 50 minutes old."""
    k = F.col("s_suppkey")
    ago = F.make_interval(mins=(k * 97 % 1440 - k % 50).cast("int"), days=(k % 7).cast("int"))
    kinds = ["none", "rain", "snow", "freezing_rain"]
    return table(spark, sf_dir, "supplier").select(
        *cell_of(k), (F.lit("2024-01-08 00:00:00").cast("timestamp_ntz") + ago).alias("ts"), pick(kinds, k % 4).alias("precipitation"),
        pick(["light", "moderate", "heavy"], k % 3).alias("intensity"), (k % 60).cast("double").alias("gust"),
        (k % 90 - 20).cast("double").alias("feels_like"))


def cell_of(key: Column) -> list[Column]:
    """The weather cell of a pair."""
    return [(F.lit(41.8) + key % 3 * 0.01 + 0.001).alias("lat"), F.lit(-87.651).alias("lon")]


def asof_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and forecasts from the event stream, over a handful of cells."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    at = [(F.lit(41.8) + u % 3 * 0.01 + 0.001).alias("lat"), F.lit(-87.651).alias("lon"), F.col("ts")]
    req = e.where(F.col("event_type").isin("click", "purchase", "view")).select(F.col("event_id").alias("request_id"), *at)
    fc = e.where(~F.col("event_type").isin("click", "purchase", "view")).select(F.col("event_id").alias("forecast_id"), *at)
    return req, fc
