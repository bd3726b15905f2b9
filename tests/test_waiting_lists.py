"""Rows that wait for the watermark are added and read per key, and labels walk only to where a last ride boards."""

from types import SimpleNamespace

from headway.operators import itinerary as I
from headway.operators import limits as M
from headway.streaming.state import OrderedRateLimiter


class Cell:
    """Keyed state of one key that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("appendList", "put"):
                self.rows += args[0]
            elif name == "update":
                self.rows = [args[0]]
            elif name == "clear":
                self.rows = []
            return {"get": lambda: list(self.rows), "exists": lambda: bool(self.rows)}.get(name, lambda: None)()
        return call


def test_state_is_asked_per_key_not_per_row():
    waiting, value, timers = Cell(), Cell(), []
    handle = SimpleNamespace(getListState=lambda *a: waiting, getValueState=lambda *a: value, listTimers=lambda: iter(timers), registerTimer=timers.append)
    rule = OrderedRateLimiter(M.Limit(2, 6, 20))
    rule.init(handle)
    rows = [SimpleNamespace(us=1_000_000 * (i // 2), tie=i, payload="") for i in range(1000)]
    assert list(rule.handleInputRows(("a",), iter(rows + rows[:3]), None)) == []
    assert waiting.calls == 1
    got = list(rule.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 99_000), None))
    assert [r.visit_id for r in got] == sorted([*range(200), 0, 1, 2]) and len(waiting.rows) == 800
    assert waiting.calls <= 4


def test_labels_walk_only_to_boarding_stops_of_last_rides(spark, monkeypatch):
    boards, real = [], I._keep_best

    def spy(labels, k, found):
        boards.append({r.stop_id for r in labels.select("stop_id").collect()})
        return real(labels, k, found)

    monkeypatch.setattr(I, "_keep_best", spy)
    frame = spark.createDataFrame
    ends = "od_id long, stop_id string, walk_minutes double"
    rides = [("p", "Q", "bus", "Q", "A", "B", 4.0), ("p", "R", "bus", "R", "C", "Z", 5.0)]
    walks = [("p", "B", "C", 1.0)] + [("p", "B", f"far{i}", 1.0) for i in range(9)]
    got = I.itineraries(frame([(1, "p")], "od_id long, period string"), frame([(1, "A", 1.0)], ends), frame([(1, "Z", 1.0)], ends),
                        frame(rides, "period string, route_id string, mode string, line string, board_id string, alight_id string, minutes double"),
                        frame(walks, "period string, from_id string, to_id string, minutes double"), max_transfers=1).collect()
    assert [(r.signature, r.total) for r in got] == [("Q:A>B|R:C>Z", 15.0)]
    assert boards[-1] == {"C"}
