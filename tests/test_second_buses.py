"""Second buses are cut to a few per place before they meet the first ones, and no better one is lost."""

import random

from headway.operators import itinerary as I

SEQ = "route_id string, direction_id string, pos int, stop_id string, lat double, lon double, arr_min double"


def test_the_best_of_any_first_bus_are_kept(spark):
    r = random.Random(5)
    stops = [f"s{i}" for i in range(8)]
    rows = [(f"L{n}", "0", p, s, 0.0, 0.0, 10.0 * p) for n in range(9) for p, s in enumerate(r.choices(stops, k=r.randint(2, 6)))]
    exits = {(od, s): r.choice([0.01, 0.05, 0.1, 0.3, 0.45]) for od in (1, 2) for s in r.sample(stops, 3 + od)}
    near = {(a, b): 0.0 if a == b else r.choice([0.02, 0.1, 0.2, 0.25]) for a in stops for b in stops if a <= b or r.random() < 0.5}
    asked = [(od, s) for od in (1, 2) for s in stops[:6]]
    frame = spark.createDataFrame
    got = I._second_buses(
        frame(asked, "od_id long, sk_stop string"), frame([(*k, m) for k, m in exits.items()], "od_id long, exit_stop string, exit_miles double"),
        I.bus_hops(frame(rows, SEQ), []), frame([(*k, m) for k, m in near.items()], "sk_stop string, t_stop string, change_miles double"), []).collect()
    kept = {}
    for x in got:
        kept.setdefault((x.od_id, x.sk_stop), []).append((x.change_miles + x.exit_miles, x.t_stop, x.route_b, x.exit_pos))
    for od, sk in asked:
        every = []
        for line, _, p, t, *_ in rows:
            later = [(exits[od, s], -q) for n, _, q, s, *_ in rows if n == line and q > p and (od, s) in exits]
            if later and (sk, t) in near:
                every.append((near[sk, t] + min(later)[0], t, line, -min(later)[1]))
        mine = sorted(kept.get((od, sk), []))
        for own in [None, *{e[2] for e in every}]:
            want = sorted(e for e in every if e[2] != own)[:I.PER_ARRIVAL]
            assert sorted(e for e in mine if e[2] != own)[:I.PER_ARRIVAL] == want


def test_many_lines_at_one_corner_leave_few_rows(spark):
    seq = spark.range(200).selectExpr("concat('L', id) as route_id", "'0' as direction_id", "inline(array(struct(0 as pos, 'a' as stop_id), struct(1 as pos, 'b' as stop_id)))").selectExpr(
        "route_id", "direction_id", "pos", "stop_id", "0D as lat", "0D as lon", "10D * pos as arr_min")
    one = lambda text: spark.sql(f"select {text}")
    got = I._second_buses(one("1L as od_id, 'c' as sk_stop"), one("1L as od_id, 'b' as exit_stop, 0.1D as exit_miles"),
                          I.bus_hops(seq, []), one("'c' as sk_stop, 'a' as t_stop, 0.1D as change_miles"), [])
    assert got.count() == 2 * I.PER_ARRIVAL
