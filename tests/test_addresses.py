import ipaddress
import random

from pyspark.sql import functions as F

from headway.functions import web
from headway.operators import analytics as A
from headway.operators import live as V

ODD = ["", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "fe80::1%eth0", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33",
       "1:2:3:4:5:6:1.2.3.4", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1:2", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", "g::",
       "1:2:3:4:5:6:7:8::", "unknown", "2001:DB8::A", " 2001:db8::1 ", "1:2:3:4:5:6:7:1.2.3.4", None]


def number(ip):
    """The 128-bit number of an address, or None."""
    try:
        a = ipaddress.ip_address((ip or "").strip().split("%")[0])
    except ValueError:
        return None
    return int(a) if a.version == 6 else int(a) + (0xFFFF << 32)


def test_addresses_as_hex(spark):
    r = random.Random(4)
    texts = ODD + [str(ipaddress.IPv6Address(r.getrandbits(128) & ~(((1 << r.choice([0, 48, 80])) - 1) << r.choice([0, 16])))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", web.address_hex(F.col("ip")).alias("h")).collect()
    for x in got:
        n = number(x.ip)
        assert x.h == (None if n is None else f"{n:032x}"), x.ip


def test_narrowest_network_of_both_families(spark):
    r = random.Random(7)
    cidr, ranges = [], []
    for i in range(60):
        bits = r.choice([0, 1, 7, 20, 33, 47, 48, 64, 127, 128])
        cidr.append((f"{ipaddress.ip_network((r.getrandbits(8) << 120, bits), strict=False)}", f"six{i}"))
        bits = r.choice([0, 3, 8, 15, 24, 32])
        cidr.append((f"{ipaddress.ip_network((r.getrandbits(5) << 27, bits), strict=False)}", f"four{i}"))
        a = r.getrandbits(32)
        ranges.append((a, min(a + r.choice([0, 1, 5, 300, 10**6, 10**9]), 2**32 - 1), f"range{i}"))
    cidr += [("not a network", "x"), ("1.2.3.4", "host"), ("10.0.0.0/40", "bad")]
    ips = [str(ipaddress.IPv6Address(r.getrandbits(8) << 120 | r.getrandbits(9))) for _ in range(80)]
    ips += [str(ipaddress.IPv4Address(r.choice([r.getrandbits(32), (a[0] + a[1]) // 2]))) for a in ranges for _ in range(2)]
    ips += ["1.2.3.4", "::ffff:1.2.3.4", "junk", None]
    visits = spark.createDataFrame([(ip, "/ping") for ip in ips], "ip string, path string").withColumn("ts", F.lit("2024-01-05 18:00:00").cast("timestamp_ntz"))
    nets = []
    for text, city in cidr:
        try:
            n = ipaddress.ip_network(text)
        except ValueError:
            continue
        off = 0 if n.version == 6 else 0xFFFF << 32
        nets.append((float(n.num_addresses), int(n[0]) + off, int(n[0]) + n.num_addresses - 1 + off, city))
    nets += [(float(b - a + 1), a + (0xFFFF << 32), b + (0xFFFF << 32), c) for a, b, c in ranges]
    want = {}
    for ip in ips:
        n = number(ip)
        hit = min(((w, a, c) for w, a, b, c in nets if n is not None and a <= n <= b), default=None)
        if hit:
            want[hit[2]] = want.get(hit[2], 0) + 1
    got = A.ip_to_city(visits, spark.createDataFrame(cidr, "network string, city string"),
                       spark.createDataFrame(ranges, "start_ip long, end_ip long, city string")).collect()
    assert {x.city: x.n for x in got} == want


def test_forecast_of_a_request(spark):
    r = random.Random(2)
    t0 = 1_704_067_200
    f = [(41.8 + 0.01 * r.randrange(2), -87.6, t0 + r.randrange(0, 40_000), i) for i in range(60)] + [(None, -87.6, t0, 99), (41.8, -87.6, None, 98)]
    q = [(41.8 + 0.01 * r.randrange(3) + 0.001, -87.6, t0 + r.randrange(0, 45_000), i) for i in range(400)]
    q += [(a, b, t + d, 1000 + 10 * i + k) for i, (a, b, t, _) in enumerate(f[:20]) for k, d in enumerate((0, 1800, 1801, -1))] + [(None, None, t0, 5000), (41.8, -87.6, None, 5001)]
    table = lambda rows, key: spark.createDataFrame(rows, f"lat double, lon double, s long, {key} int").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = V.weather_asof(table(q, "request_id"), table(f, "forecast_id"))
    assert "Window" not in got.select("request_id")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    rows = got.select("request_id", F.col("forecast.forecast_id").alias("f")).collect()
    at = {i: t for *_, t, i in f}
    assert len(rows) == len(q)
    for x, (a, b, t, i) in zip(sorted(rows, key=lambda x: x.request_id), sorted(q, key=lambda x: x[3]), strict=True):
        held = [ft for fa, fb, ft, _ in f if None not in (a, t, fa, ft) and round(fa, 2) == round(a, 2) and ft <= t <= ft + 1800]
        assert (at[x.f] if x.f is not None else None) == max(held, default=None), (x, t)
