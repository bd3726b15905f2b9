import random
from datetime import datetime, timedelta

from headway.streaming import jobs as J

SCHEMA = "mode string, line_code string, stop_id string, destination string, minutes int, fetched_at timestamp_ntz"
START = datetime(2024, 1, 10, 8)
PINS = [("bus", str(i)) for i in range(6)] + [("train", "1")]


def brute(rows):
    """Newest prediction per key, shown for 30 seconds, three a stop."""
    newest, clock = {}, max(r[5] for r in rows)
    for m, line, stop, dest, minutes, at in rows:
        newest[m, line, stop, dest] = max(newest.get((m, line, stop, dest), (START, 0)), (at, -minutes))
    board = {f"{m}:{s}": [] for m, s in PINS}
    for (m, line, stop, dest), (at, minus) in newest.items():
        if at > clock - timedelta(seconds=30) and (m, stop) in PINS:
            board[f"{m}:{stop}"].append((-minus, line, dest))
    return {k: sorted(v)[:3] for k, v in board.items()}


def board(spark, tmp_path, name, files):
    """The board after the files, one a batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{name}/b={i}"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}/*"))
    pins = spark.createDataFrame(PINS, "mode string, stop_id string")
    path = str(tmp_path / f"{name}-board")
    J.stream_stop_board(src, pins, path, path + "-state")
    got = spark.read.parquet(path).collect()
    assert len(got) == len(PINS)
    return {r.key: [(a.minutes, a.route, a.destination) for a in r.arrivals] for r in got}


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_board_reaches_over_slot_borders(spark, tmp_path):
    rows = [("bus", "22", "1", "N", 4, at(29)), ("bus", "22", "1", "N", 9, at(2)), ("bus", "9", "2", "S", 7, at(31)),
            ("bus", "9", "3", "S", 5, at(1)), ("bus", "8", "4", "S", 5, at(0))]
    want = {f"{m}:{s}": [] for m, s in PINS} | {"bus:1": [(4, "22", "N")], "bus:2": [(7, "9", "S")]}
    assert brute(rows) == want         # stop 3 is 30 seconds old
    assert board(spark, tmp_path, "one", [rows]) == want


def test_board_equals_brute_force_in_any_order(spark, tmp_path):
    r = random.Random(4)
    rows = [("bus", r.choice(["9", "22"]), str(r.randrange(8)), r.choice("NS"), r.randrange(20), at(r.randrange(100))) for _ in range(160)]
    want = brute(rows)
    assert sum(map(len, want.values())) > 6 and len({x[5].second // 30 for x in rows}) > 1
    assert board(spark, tmp_path, "whole", [rows]) == want
    ordered = sorted(rows, key=lambda x: x[5])
    assert board(spark, tmp_path, "ordered", [ordered[i:i + 32] for i in range(0, 160, 32)]) == want
    r.shuffle(rows)
    assert board(spark, tmp_path, "shuffled", [rows[i:i + 32] for i in range(0, 160, 32)]) == want
    newest_first = ordered[::-1]
    assert board(spark, tmp_path, "backwards", [newest_first[i:i + 32] for i in range(0, 160, 32)]) == want
