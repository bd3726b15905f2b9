"""Itineraries with changes are searched up to limits that rise, and none of the best is lost."""

import random

from headway.operators import itinerary as I


def network(r, stops=14):
    names = [f"s{i}" for i in range(stops)]
    rides = [("p", f"L{n % 7}", "bus", f"L{n % 7}", *r.sample(names, 2), float(r.choice([2, 3, 4, 7, 9.5]))) for n in range(60)]
    walks = [("p", *r.sample(names, 2), r.choice([3.0, 3.0, 3.4, 4.1])) for _ in range(25)]
    ends = lambda: [(od, s, r.choice([0.2, 0.7, 1.0, 2.5])) for od in range(12) for s in r.sample(names, 3)]
    return rides, walks, ends(), ends()


def answer(spark, seed, transfers):
    rides, walks, access, egress = network(random.Random(seed))
    frame = spark.createDataFrame
    ends = "od_id long, stop_id string, walk_minutes double"
    od = frame([(i, "p", 1.0 + i % 3 / 4) for i in range(12)], "od_id long, period string, walk_factor double")
    got = I.itineraries(od, frame(access, ends), frame(egress, ends),
                        frame(rides, "period string, route_id string, mode string, line string, board_id string, alight_id string, minutes double"),
                        frame(walks, "period string, from_id string, to_id string, minutes double"), k=3, max_transfers=transfers)
    return sorted((x.od_id, x.rank, x.signature, x.total, x.transfers, len(x.legs)) for x in got.collect())


def test_limits_lose_no_itinerary(spark, monkeypatch):
    want = answer(spark, 11, 1)
    asked, real = [], I._with_changes

    def spy(pairs, *rest):
        asked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(I, "_with_changes", spy)
    monkeypatch.setattr(I, "LIMIT_STEPS", [0.0, 4.0])
    monkeypatch.setattr(I, "LABELS_AT_ONCE", 20)
    monkeypatch.setattr(I, "LABELS_JOINED", 0)      # walks come to the labels
    assert answer(spark, 11, 1) == want
    assert len(asked) > 1 and asked[-1] < asked[0]
    assert len({x[0] for x in want}) == 12 and {x[4] for x in want} > {0}


def test_labels_meet_the_goals_they_can_walk_to(spark, monkeypatch):
    r = random.Random(2)
    names = [f"s{i}" for i in range(30)]
    labels = [(n, r.randrange(9), r.choice("pq"), r.choice(names)) for n in range(300)] + [(900, 3, "p", "elsewhere"), (901, None, "p", "s1")]
    goals = sorted({(r.randrange(8), r.choice([*names, "far"])) for _ in range(60)})
    walks = [(r.choice("pq"), *r.sample(names, 2), r.choice([3.0, 4.0])) for _ in range(200)] + [("p", "s1", "far", 5.0)] * 2
    frame = spark.createDataFrame
    args = (frame(labels, "label long, od_id long, period string, stop_id string"), frame(goals, "od_id long, stop_id string"),
            frame(walks, "period string, from_id string, to_id string, minutes double"))
    joined = sorted(tuple(x) for x in I._reaching(*args).na.fill(-1.0).collect())
    monkeypatch.setattr(I, "LABELS_JOINED", 0)
    monkeypatch.setattr(I, "LABELS_A_GROUP", 50)
    assert sorted(tuple(x) for x in I._reaching(*args).na.fill(-1.0).collect()) == joined
    assert {x[3] for x in joined} == {True, False}
