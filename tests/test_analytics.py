import datetime as dt
import random

from pyspark.sql import functions as F

from headway.operators import analytics as A
from headway.operators import limits as M
from headway.operators import panels as P
from headway.streaming import jobs as J

T0 = dt.datetime(2024, 1, 10, 15)


def visits(spark, rows):
    """rows: (second, sid, path[, event])"""
    data = [(i, T0 + dt.timedelta(seconds=r[0]), r[2], r[1], r[1], r[1], r[3] if len(r) > 3 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "visit_id long, ts timestamp_ntz, path string, ip string, sid string, rid string, event_name string")


def test_session_gap_is_strict(spark):
    v = visits(spark, [(0, "a", "/ping"), (1800, "a", "/recommend"), (3601, "a", "/recommend"), (3700, "a", "/recommend"), (9, "b", "/admin")])
    s = sorted((r.session_no, r.visits, r.recommends) for r in A.sessionize(v).collect())
    assert s == [(1, 2, 1), (2, 2, 2)]
    m = A.session_metrics(A.sessionize(v)).first()
    assert (m.sessions, m.total_duration_seconds, m.bounces, m.bounce_rate_pct) == (2, 1899, 1, 50.0)


def test_sessions_reset_at_local_midnight(spark):
    night = (dt.datetime(2024, 1, 11, 5, 59) - T0).total_seconds()
    v = visits(spark, [(night, "a", "/ping"), (night + 120, "a", "/ping")])
    assert sorted(str(r.day) for r in A.sessionize(v).collect()) == ["2024-01-10", "2024-01-11"]


def test_sessions_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(0, 80_000), rng.choice("abc"), "/ping") for _ in range(400)]
    want = 0
    by = {}
    for s, sid, _ in rows:
        day = (T0 + dt.timedelta(seconds=s) - dt.timedelta(hours=6)).date()
        by.setdefault((sid, day), []).append(s)
    for x in by.values():
        x.sort()
        want += 1 + sum(b - a > 1800 for a, b in zip(x, x[1:]))
    assert A.sessionize(visits(spark, rows)).count() == want


def test_funnel_counts_events_while_the_session_lives(spark):
    v = visits(spark, [(0, "a", "/ping"), (0, "b", "/ping"), (0, "c", "/ping")])
    e = visits(spark, [(1800, "a", "/e", "recommend_returned"), (1801, "b", "/e", "trip_completed"), (5, "c", "/e", "map_opened")])
    st = {r.sid: r.stage for r in A.session_stages(v, e).collect()}
    assert st == {"a": 2, "b": -1, "c": -1}
    f = A.funnel(A.session_stages(v, e)).first()
    assert (f.counts, f.result_rate_pct) == ([1, 1, 1, 0, 0, 0], 100.0)


def test_retention_and_dau_agree(spark):
    v = visits(spark, [(0, "a", "/ping"), (5, "a", "/ping"), (86400, "a", "/ping"), (86400, "b", "/ping")])
    r = {str(x.day): (x["new"], x.returning) for x in A.new_vs_returning(v).collect()}
    assert r == {"2024-01-10": (1, 0), "2024-01-11": (1, 1)}
    assert {str(x.day): x["count"] for x in A.daily_active(v).collect()} == {"2024-01-10": 1, "2024-01-11": 2}


def test_city_floor(spark):
    df = spark.createDataFrame([("d", c, n) for c, n in [("A", 200), ("B", 50), ("C", 5), ("D", 4), ("E", 2), ("F", 1)]], "day string, city string, n long")
    assert {r.city: r.n for r in A.city_counts(df).collect()} == {"A": 200, "B": 50, "C": 5, "Other": 7}
    m = A.metro_share(df, ["a", "D"]).first()
    assert (m.metro, m.total, m.share_pct) == (204, 262, 77.9)


def test_rate_demand_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(0, 7200), rng.choice("ab"), "/ping") for _ in range(300)] + [(3600, "a", "/ping"), (3660, "a", "/ping"), (3660, "a", "/ping")]
    got = {r.visit_id: (r.last_minute, r.last_hour) for r in A.rate_demand(visits(spark, rows)).collect()}
    for i, (s, ip, _) in enumerate(rows):
        back = lambda w: sum(1 for t, j, _ in rows if j == ip and s - w <= t <= s)  # noqa: B023, E731
        assert got[i] == (back(60), back(3600))


def test_panels_leak_nothing(spark):
    d = dt.date(2024, 1, 1)
    dev = spark.createDataFrame([(d, 3, 1, 2, 99, 7)], "day date, mobile long, tablet long, desktop long, bot long, unknown long")
    row = P.public_panel(dev, "devices").first().asDict()
    assert set(row) == set(P.PANEL_COLUMNS["devices"]) and row["total"] == 6
    hours = spark.createDataFrame([(d, [1] * 24), (d, [1] * 23)], "day date, hours array<long>")
    assert [r.total for r in P.public_panel(hours, "hourly").collect()] == [24]
    fun = spark.createDataFrame([(d, [0, 0, 0, 0, 0, 0]), (d, [1, 2])], "day date, counts array<long>")
    assert [r.result_rate_pct for r in P.public_panel(fun, "funnel").collect()] == [0.0]


def brute_limit(rows, lim):
    out, state = {}, {}
    for s, i, ip in sorted((r[0], i, r[1]) for i, r in enumerate(rows)):
        hour, day = state.setdefault(ip, ([], []))
        hour[:] = [t for t in hour if s - t <= 3600]
        ok = len(hour) < lim.per_hour and sum(s - t <= 60 for t in hour) < lim.per_minute
        if ok:
            hour.append(s)
            if lim.per_day is not None:
                day[:] = [t for t in day if s - t <= 86400]
                ok = len(day) < lim.per_day
                if ok:
                    day.append(s)
        out[i] = ok
    return out


def test_rate_limit_batch_stream_and_brute_force_agree(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 200_000) // rng.choice([1, 40]), rng.choice("abc"), "/ping") for _ in range(500)]
    lim = M.Limit(2, 6, 20)
    want = brute_limit(rows, lim)
    v = visits(spark, rows)
    assert {r.visit_id: r.allowed for r in M.rate_limit(v, lim).collect()} == want
    v.write.parquet(str(tmp_path / "v"))
    st = J.to_table(J.stream_rate_limit(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v")), lim, "10 days"), "t")
    assert {r.visit_id: r.allowed for r in st.collect()} == want


def test_stream_sessions_keep_the_exact_gap_together_across_batches(spark, tmp_path):
    rows = [(0, "a", "/ping"), (1800, "a", "/recommend"), (3601, "a", "/ping"), (90_000, "z", "/ping")]
    for i, r in enumerate(rows):
        visits(spark, [r]).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    src = spark.readStream.schema(visits(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sorted((r.sid, r.visits, r.recommends) for r in J.to_table(J.stream_sessions(src, delay="2 hours"), "s").collect())
    assert got == [("a", 1, 0), ("a", 2, 1)]


def test_sketched_visitors_stay_within_their_error(spark):
    """More visitors than a sketch holds: counts are near the exact ones; small spans are exact."""
    day = "timestampadd(DAY, cast(id % 5 as int), TIMESTAMP_NTZ'2024-01-02 18:00:00')"
    v = spark.range(60_000).selectExpr("concat('v', id * 7 % 40000 + id % 5 * 3000) AS rid", f"{day} AS ts", "'/ping' AS path")
    want = {r.day: r for r in A.new_vs_returning(v).collect()}
    got = {r.day: r for r in A.returning_sketched(A.visitor_sketches(v)).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert abs(got[d].new - want[d].new) <= 0.03 * 60_000 and abs(got[d].returning - want[d].returning) <= 0.03 * 60_000
    few = v.where("cast(substr(rid, 2) as int) < 3000")
    rows = lambda df: sorted((r.day, r.new, r.returning, r.returning_pct) for r in df.collect())
    assert rows(A.returning_sketched(A.visitor_sketches(few))) == rows(A.new_vs_returning(few))
    assert A.returning_sketched(A.visitor_sketches(few.limit(0))).count() == 0
