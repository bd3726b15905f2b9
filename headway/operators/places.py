"""Free-text places: normalised corpora, tiered matching, reverse look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..session import save_table
from .spatial import ADDRESS_METRES, LANDMARK_METRES, in_city, nearest_within

# Suggestion tiers in order, their base scores, bonuses, limits.
TIERS = {
    "train_station": 1100.0, "neighborhood": 1000.0, "intersection": 800.0,
    "bus_stop": 700.0, "address": 600.0,
}
EXACT_BONUS, CITY_BONUS = 100.0, 50.0
TIER_CAP, SUGGESTIONS = 3, 8


# --- corpora -------------------------------------------------------------------


def dedupe_addresses(addresses: DataFrame) -> DataFrame:
    """One row per (normalised text, 1e-5 coordinate): the least id."""
    keys = ["normalized", geo.quantise(F.col("lat")).alias("lat_q"),
            geo.quantise(F.col("lon")).alias("lon_q")]
    return addresses.groupBy(*keys).agg(F.min(F.struct("id", "raw", "lat", "lon")).alias("a")).select(
        "a.id", "normalized", "a.raw", F.round("a.lat", 6).alias("lat"), F.round("a.lon", 6).alias("lon"))


def merge_by_id(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of overlapping extracts; the row of the last part wins."""
    cols = parts[0].columns
    tagged = [p.select(F.lit(i).alias("_part"), *cols) for i, p in enumerate(parts)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    return u.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in cols if c != key]), "_part").alias("r")
    ).select(key, "r.*").select(*cols)


def prefix_corpus(stations: DataFrame, landmarks: DataFrame, bus_stops: DataFrame,
                  addresses: DataFrame) -> DataFrame:
    """(tier, key, label, lat, lon) of everything a typed prefix can match.

    Bus stops of one name count once, at the least stop id.
    """
    st = stations.where(F.trim("name") != "").select(
        F.lit("train_station").alias("tier"), F.lower(F.trim("name")).alias("key"),
        F.trim("name").alias("label"), "lat", "lon")
    lm = landmarks.select(F.lit("neighborhood").alias("tier"), F.col("name").alias("key"),
                          text.title_case(F.col("name")).alias("label"), "lat", "lon")
    bus = (
        bus_stops.where(F.trim("name") != "").groupBy(F.lower(F.trim("name")).alias("key"))
        .agg(F.min(F.struct("stop_id", F.trim("name").alias("label"), "lat", "lon")).alias("s"))
        .select(F.lit("bus_stop").alias("tier"), "key", "s.label", "s.lat", "s.lon")
    )
    ad = addresses.select(F.lit("address").alias("tier"), F.col("normalized").alias("key"),
                          F.col("raw").alias("label"), "lat", "lon")
    return st.unionByName(lm).unionByName(bus).unionByName(ad)


# --- suggestions ------------------------------------------------------------------


def suggestion_score(tier: Column, exact: Column, lat: Column, lon: Column) -> Column:
    """Order inside a tier: exact first, in the city, near its centre."""
    base = F.lit(0.0)
    for name, s in TIERS.items():
        base = F.when(tier == name, s).otherwise(base)
    away = geo.haversine(F.lit(geo.CITY_CENTRE[0]), F.lit(geo.CITY_CENTRE[1]), lat, lon)
    return (base + F.when(exact, EXACT_BONUS).otherwise(0.0)
            + F.when(in_city(lat, lon), CITY_BONUS).otherwise(0.0) - away)


def _asked(queries: DataFrame) -> DataFrame:
    """(q, tier, key): what each distinct query looks for in each tier."""
    q = queries.select(F.trim("query").alias("q")).where(F.col("q") != "").distinct()
    q = q.select("q", text.address(F.col("q")).alias("norm"), text.street_name(F.col("q")).alias("street"),
                 text.cross_street(F.col("q")).alias("cross"))
    norm, street, cross = F.col("norm"), F.col("street"), F.col("cross")
    numbered = text.has_house_number(norm)
    pair = lambda s: F.concat_ws("|", s["a"], s["b"])
    typed = F.lower("q")
    one_word = cross.isNull() & (street != "") & ~street.contains(" ") & ~numbered
    entry = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("key"))
    return q.select("q", F.inline(F.array_compact(F.array(
        *[entry(t, typed) for t in ("train_station", "neighborhood", "bus_stop")],
        F.when(numbered, entry("address", norm)),
        F.when(cross.isNotNull(), entry("intersection", pair(cross))),
        F.when(one_word, entry("intersection", street)),
    ))))


def _best_per_key(hits: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("tier", "ask").orderBy(F.desc("score"), "key", "label", "lat", "lon")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def autocomplete(queries: DataFrame, corpus: DataFrame, crossings: DataFrame,
                 limit: int = SUGGESTIONS, cap: int = TIER_CAP,
                 city_only: bool = True) -> DataFrame:
    """Ranked suggestions per distinct query over five tiers.

    A prefix match is an equi-join on the prefix itself: corpus keys are spread
    over their own prefixes of the lengths that are asked for, kept where some
    query asks for that prefix, and cut to the best `cap` per prefix before any
    query is attached. Neither a popular prefix nor a popular query multiplies
    the other.
    """
    asked = save_table(_asked(queries), "asked")
    keys = asked.select("tier", F.col("key").alias("ask")).distinct()
    # As many rows as there are lengths of one text field.
    lengths: dict[str, list[int]] = {}
    for r in asked.groupBy("tier", F.length("key").alias("n")).count().collect():
        lengths.setdefault(r.tier, []).append(r.n)
    of_tier = F.array().cast("array<int>")
    for name, some in lengths.items():
        of_tier = F.when(F.col("tier") == name, F.array(*(F.lit(n) for n in sorted(some)))).otherwise(of_tier)
    inside = in_city(F.col("lat"), F.col("lon")) if city_only else F.lit(True)
    spread = corpus.where(inside).withColumn("ask", F.explode(F.transform(
        F.filter(of_tier, lambda n: n <= F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n)
    )))
    named = crossings.where(inside).select(
        F.lit("intersection").alias("tier"), F.concat_ws("|", "name_a", "name_b").alias("key"),
        F.concat_ws(" & ", "raw_a", "raw_b").alias("label"), "lat", "lon",
        F.explode(F.array(F.concat_ws("|", "name_a", "name_b"), "name_a", "name_b")).alias("ask"))
    cols = ["tier", "key", "label", "lat", "lon", "ask"]
    hits = spread.select(*cols).unionByName(named.select(*cols)).join(keys, ["tier", "ask"], "left_semi")
    hits = hits.withColumn("score", suggestion_score(
        F.col("tier"), F.col("key") == F.col("ask"), F.col("lat"), F.col("lon")))
    best = _best_per_key(hits, cap)
    found = asked.withColumnRenamed("key", "ask").join(best, ["tier", "ask"])
    tier_no = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    ranked = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(
        tier_no.alias("tier_no"), "place", "tier", "label", "lat", "lon", "score"))).alias("items"))
    kept = F.slice(dedupe_two_keys(F.col("items")), 1, limit)
    return ranked.select("q", F.posexplode(kept).alias("rank", "s")).select(
        "q", "rank", F.col("s.tier").alias("source"), "s.label", "s.lat", "s.lon", "s.score")


def dedupe_two_keys(items: Column) -> Column:
    """Drop, in order, what shares its 1e-5 coordinate or (tier, label) with a kept item.

    Order-dependent, hence a fold; at most five tiers times the cap are in the array.
    """
    def same(x: Column, y: Column) -> Column:
        place = (geo.quantise(x["lat"]) == geo.quantise(y["lat"])) & (
            geo.quantise(x["lon"]) == geo.quantise(y["lon"]))
        return place | ((x["tier"] == y["tier"]) & (F.lower(x["label"]) == F.lower(y["label"])))

    return F.aggregate(
        items, F.slice(items, 1, 0),
        lambda kept, y: F.when(F.exists(kept, lambda x: same(x, y)), kept)
        .otherwise(F.concat(kept, F.array(y))),
    )


# --- matching ------------------------------------------------------------------------


def match_cross_street(queries: DataFrame, crossings: DataFrame) -> DataFrame:
    """Distinct queries naming two streets, or one, with their crossings (by equality)."""
    a = _asked(queries).where(F.col("tier") == "intersection").select("q", F.col("key").alias("ask"))
    c = crossings.select(
        "name_a", "name_b", "lat", "lon",
        F.explode(F.array(F.concat_ws("|", "name_a", "name_b"), "name_a", "name_b")).alias("ask"))
    return a.join(c, "ask").drop("ask")


def _blocks(names: DataFrame, column: str, q: int = 4) -> DataFrame:
    """Distinct texts with their distinct q-grams."""
    return names.select(F.col(column).alias("t")).distinct().select(
        "t", F.explode(text.grams(F.col("t"), q)).alias("g"))


def fuzzy_candidates(queries: DataFrame, names: DataFrame,
                     floor: float = text.SIMILARITY_FLOOR) -> DataFrame:
    """Distinct (query, name) pairs that can reach the similarity floor.

    Reaching it allows few edits, so texts of very unequal length go first:
    only queries as long as some name are cut into grams. It allows
    k = 2 (1 - floor) / floor * |text| edits, each of which touches four
    4-grams, so the 4k + 1 rarest grams of both texts must meet. Joining only on
    those keeps frequent grams out of the join.
    """
    # As many rows as there are lengths of a name.
    long = [r.n for r in names.select(F.length("name").alias("n")).where("n is not null").distinct().collect()]
    size = F.length("query")
    near = F.exists(F.array(*map(F.lit, sorted(long))).cast("array<int>"), lambda n: F.abs(n - size) <= F.floor(
        (n + size) * F.lit(1.0 - floor) + F.lit(1e-9)))
    queries = queries.select("query").distinct().where(near)
    qg, ng = (save_table(_blocks(df, c), "grams") for df, c in ((queries, "query"), (names, "name")))
    freq = ng.groupBy("g").agg(F.count("*").alias("df"))
    k = F.floor(F.length("t") * F.lit(2.0 * (1.0 - floor) / floor) + F.lit(1e-9))

    def rare(df: DataFrame, alias: str) -> DataFrame:
        w = Window.partitionBy("t").orderBy("df", "g")
        return (
            df.join(freq, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
            .withColumn("r", F.row_number().over(w)).where(F.col("r") <= 4 * k + 1)
            .select(F.col("t").alias(alias), "g")
        )

    pairs = rare(qg, "query").join(rare(ng, "name"), "g").select("query", "name").distinct()
    return pairs.where(text.edit_bound(F.col("query"), F.col("name"), floor))


def fuzzy_match(queries: DataFrame, names: DataFrame, floor: float = text.SIMILARITY_FLOOR,
                exact_ratio: bool = True) -> DataFrame:
    """Best name per distinct query at or above the floor.

    A query of several meaningful words must share one with the name. The
    matching-block ratio runs on the few pairs the edit bound lets through;
    `exact_ratio=False` uses 1 - edits / length throughout.
    """
    c = fuzzy_candidates(queries, names, floor)
    words_q = text.meaningful_words(F.col("query"))
    shared = F.arrays_overlap(words_q, text.meaningful_words(F.col("name")))
    c = c.where((F.size(words_q) <= 1) | shared)
    ratio = text.matching_ratio if exact_ratio else text.edit_similarity
    scored = c.withColumn("score", ratio(F.col("name"), F.col("query"))).where(F.col("score") >= floor)
    best = F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b")
    return scored.groupBy("query").agg(best).select(
        "query", F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"))


def geocode(queries: DataFrame, landmarks: DataFrame, corpus: DataFrame,
            crossings: DataFrame, exact_ratio: bool = True) -> DataFrame:
    """Every query with the first tier that resolves it.

    coordinate pair, exact landmark, fuzzy landmark, best suggestion. Distinct
    texts are resolved once. The costly fuzzy tier sees only what the exact
    tier left; suggestions are cheap equi-joins and are looked up for all, so
    no tier is computed twice.
    """
    q = queries.select("query").distinct().withColumn("p", text.coordinate_pair(F.col("query")))
    typed = text.expand_suffixes(F.lower(F.trim("query")))
    q = q.withColumn("typed", F.when(F.col("p").isNull(), F.nullif(typed, F.lit(""))))
    marks = landmarks.groupBy(F.col("name").alias("typed")).agg(F.min(F.struct("lat", "lon")).alias("m"))
    asked = q.select("typed").where(F.col("typed").isNotNull()).distinct()
    names = marks.select(F.col("typed").alias("name"), F.col("m").alias("f"))
    unknown = asked.join(marks, "typed", "left_anti").select(F.col("typed").alias("query"))
    fuzzy = fuzzy_match(unknown, names, exact_ratio=exact_ratio).join(names, "name").select(
        F.col("query").alias("typed"), "f")
    best = autocomplete(asked.select(F.col("typed").alias("query")), corpus, crossings, limit=1).select(
        F.col("q").alias("typed"), F.struct("lat", "lon").alias("s"))
    tried = q.join(marks, "typed", "left").join(fuzzy, "typed", "left").join(best, "typed", "left")
    point = F.coalesce("p", "m", "f", "s")
    tier = (
        F.when(F.col("p").isNotNull(), "coordinates").when(F.col("m").isNotNull(), "landmark")
        .when(F.col("f").isNotNull(), "fuzzy").when(F.col("s").isNotNull(), "suggestion")
        .otherwise("unresolved")
    )
    done = tried.select("query", tier.alias("tier"), point["lat"].alias("lat"), point["lon"].alias("lon"))
    out = F.coalesce(~in_city(F.col("lat"), F.col("lon")), F.lit(False))
    return queries.join(done.withColumn("outside_city", out), "query", "left")


def reverse_geocode(points: DataFrame, cache: DataFrame, landmarks: DataFrame,
                    addresses: DataFrame) -> DataFrame:
    """Label and source of every point: cached cell, landmark, address, coordinates.

    `cache` has (lat_q, lon_q, label); equal coordinates are labelled once. A
    point without both coordinates stays, without label and source.
    """
    lat, lon = F.col("lat"), F.col("lon")
    spots = points.select("lat", "lon").where(lat.isNotNull() & lon.isNotNull()).distinct().withColumn(
        "lat_q", geo.quantise(lat)).withColumn("lon_q", geo.quantise(lon))
    hits = cache.groupBy("lat_q", "lon_q").agg(F.min("label").alias("c_label"))
    tried = spots.join(hits, ["lat_q", "lon_q"], "left")
    known = tried.where(F.col("c_label").isNotNull()).select(
        "lat", "lon", F.col("c_label").alias("label"), F.lit("cached_reverse").alias("source"))
    rest = tried.where(F.col("c_label").isNull()).select("lat", "lon")
    near_l = nearest_within(rest, landmarks.select("name", "lat", "lon"),
                            LANDMARK_METRES / geo.METRES_PER_MILE, "name")
    near_a = nearest_within(rest, addresses.select("raw", "lat", "lon"),
                            ADDRESS_METRES / geo.METRES_PER_MILE, "raw", strict=True)
    tried = (
        rest.join(near_l.select("lat", "lon", F.col("name")), ["lat", "lon"], "left")
        .join(near_a.select("lat", "lon", F.col("raw")), ["lat", "lon"], "left")
    )
    found = tried.select(
        "lat", "lon",
        F.coalesce(text.title_case(F.col("name")), "raw", F.format_string("%.5f, %.5f", lat, lon))
        .alias("label"),
        F.when(F.col("name").isNotNull(), "neighborhood").when(F.col("raw").isNotNull(), "address")
        .otherwise("coordinates").alias("source"))
    return points.join(known.unionByName(found), ["lat", "lon"], "left")
