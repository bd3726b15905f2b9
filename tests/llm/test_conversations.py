import hashlib
import random
import zlib
from itertools import groupby

import duckdb
import pytest

from headway.llm import conversations as C
from headway.llm.queries import LLM_ORACLES

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, gone string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f == 0:
            continue
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def brute(rows):
    """(gaps, …, digest) of one conversation's rows: every edit of every row, the best by cost, then audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        t = text.rstrip(WS)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    # All reachable (state, audit) with their least cost, nothing pruned but by cost at equal audits.
    ways = {("", ""): (0, ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(2):
            for (q, a), (c, made) in list(out.items()):
                r = "a" if q == "u" else "u"
                k = (step[q, r], a + "I")
                if k not in out or out[k][0] > c + 3:
                    out[k] = (c + 3, (*made, ("user:" if r == "u" else "assistant:")))
        return out

    for (_, _, role, text), f in zip(rows, faults, strict=True):
        new = {}

        def put(q, a, c, made):
            if (q, a) not in new or new[q, a][0] > c:
                new[q, a] = (c, made)

        for (q, a), (c, made) in inserted(ways).items():
            put(q, a + "D", c + 4, made)
            if f in ("blank", "duplicate"):
                continue
            more = 3 if f == "truncated" else 0
            if (q, role[:1]) in step:
                put(step[q, role[:1]], a + "K", c + more, (*made, f"{role}:{text}"))
            for r, name in (("u", "user"), ("a", "assistant")):
                if (q, r) in step:
                    put(step[q, r], a + "R", c + 3 + more, (*made, f"{name}:{text}"))
        cheapest = min(c for c, _ in new.values())
        ways = {k: v for k, v in new.items() if v[0] <= cheapest + 14}      # wider than any detour pays
    cost, a, made = min((c, a, made) for (q, a), (c, made) in inserted(ways).items() if q in ("", "a"))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, a, hashlib.sha256("\n".join(made).encode()).hexdigest())


def conversations(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        turns = list(range(r.randint(0, longest)))
        if r.random() < 0.3:
            turns = [t + r.choice([0, 0, 3]) for t in turns]
        usual = ["user", "assistant"] * longest
        for k, t in enumerate(turns):
            role = usual[k] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "unknown", "", None])
            text = r.choice(["Fine.", "Yes!", "cut", "", " \n", None, "Why? \t", "é — ok.", f"turn {k}.", "a.\x1c"])
            rows.append((conv, t if r.random() < 0.95 else None, role, text))
    return rows


def whole(rows):
    """Expected rows of the query."""
    kept = sorted(damage(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    found = {c: brute(list(g)) for c, g in groupby(kept, key=lambda r: r[0])}
    return sorted(((c, *found.get(c, brute([]))) for c in {r[0] for r in rows}), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", "other") for r in rows], SCHEMA).drop("gone").withColumnRenamed("audit", "cost")


def test_equals_brute_force(spark):
    rows = conversations(1, 150, 9) + [(1000 + i, 0, "user", "Same.") for i in range(40)]
    got = C.op12_conversations(table(spark, rows))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == whole(rows)


def test_repaired_rows_equal_their_digest(spark):
    rows = conversations(2, 60, 8)
    src = C.damaged(table(spark, rows))
    audits = C.audit(src)
    want = {r.conv_id: r.repaired_sha256 for r in audits.collect()}
    made = sorted(map(tuple, C.repaired(src, audits).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    text = {c: "\n".join(f"{role}:{t}" for _, _, role, t in g) for c, g in groupby(made, key=lambda r: r[0])}
    assert {c: hashlib.sha256(text.get(c, "").encode()).hexdigest() for c in want} == want
    assert all([r[1] for r in g] == list(range(len(g))) for g in [list(g) for _, g in groupby(made, key=lambda r: r[0])])


def test_sql(spark):
    rows = conversations(3, 60, 7)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(LLM_ORACLES["op12_conversations"])
    assert [c[0] for c in got.description] == COLUMNS
    assert sorted(got.fetchall(), key=repr) == whole(rows)


@pytest.mark.parametrize("weak", [False, True])
def test_long_conversations_settle(monkeypatch, weak):
    """Chains cut often, or never, or with hashes that always collide, give the same edits."""
    r = random.Random(9)
    for roles in ("usa", "s", "ua", "ut"):
        rows = [(0, k, r.choice(roles), r.choice(["x.", "y", f"{k}.", ""])) for k in range(600)]
        results = []
        for settle in (10**9, 40):
            monkeypatch.setattr(C, "SETTLE", settle)
            if weak:
                monkeypatch.setattr(C, "_MOD", 2)
            one, seen = C.Repair(), set()
            for _, t, role, text in rows:
                one.row(t, role, text, (role, text) in seen)
                seen.add((role, text))
            results.append(one.result())
        monkeypatch.undo()
        one, seen = C.Repair(), set()
        for _, t, role, text in rows:
            one.row(t, role, text, (role, text) in seen)
            seen.add((role, text))
        assert results[0] == results[1] == one.result()


def test_prefixes_compare_as_strings():
    r = random.Random(2)
    chain = C.Chain()
    nodes = [0]
    for _ in range(600):
        nodes.append(chain.add(r.choice(nodes[-8:]), r.choice("DIKR")))
    for _ in range(3_000):
        a, b = r.choice(nodes), r.choice(nodes)
        assert chain.less(a, b) == (chain.text(a) < chain.text(b))


def test_empty_table(spark):
    assert C.op12_conversations(table(spark, [])).count() == 0
