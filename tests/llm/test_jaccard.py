import random

from headway.llm import jaccard as J


def sets(t, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def grouped(rows):
    """Sets and group number of each row."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            k = len(s[i] & s[j])
            if k and 100 * k >= 80 * (len(s[i]) + len(s[j]) - k):
                parent[top(i)] = top(j)
    return s, [top(i) for i in range(len(s))]


def brute(rows):
    s, g = grouped(rows)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[g[i]] = min(name.get(g[i], d), d)
    return sorted(((d, len(s[i]), name.get(g[i])) for i, (d, _) in enumerate(rows)), key=repr)


def survivors(rows):
    """(least id, texts that may stay for it) of each group; null ids last, texts without words by themselves."""
    s, g = grouped(rows)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(g[i] if s[i] else (d, t or ""), []).append((d is None, d, t))
    out = []
    for members in groups.values():
        null, d, _ = min(members, key=lambda m: (m[0], m[1] or 0))
        out.append((d, {t for a, b, t in members if b == d}))
    return out


def edited(t, r, n):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 6)          # so that token pairs are indexed too
    monkeypatch.setattr(J, "BLOCK", 4)             # so that hubs fall into blocks
    r = random.Random(3)
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b c d e", "a b c d e f"]
    for seed in range(5):
        base = prose(r.choice([30, 90, 250]), seed)
        texts += [base, base] + [edited(base, r, r.randint(1, 12)) for _ in range(14)]
    line = prose(12, 99)
    texts += [line + " " + prose(r.randint(1, 60), 200 + i) for i in range(25)]
    texts += [prose(8_000, 77), edited(prose(8_000, 77), r, 3)]
    ids = [r.randrange(10**6) for _ in texts]
    ids[20], ids[-1] = None, ids[-3]               # a missing and a repeated id
    rows = list(zip(ids, texts, strict=True))
    got = J.op8_jaccard_join(make_docs(texts, ids)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    kept = J.one_of_each(make_docs(texts, ids))
    assert kept.columns == make_docs(texts).columns
    left = [(x.doc_id, x.text) for x in kept.collect()]
    want = survivors(rows)
    assert len(left) == len(want)
    for d, texts in want:
        left.remove(next((e, t) for e, t in left if e == d and t in texts))
    assert not left


def test_an_id_with_two_unlike_texts_keeps_both(make_docs, prose):
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    kept = J.one_of_each(make_docs([a, b, b, c], [5, 5, 9, 7])).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(5, a), (5, b), (7, c)])


def test_prefixes_share_entries():
    """Sets at the threshold always share an index entry, whichever tokens are frequent."""
    import numpy as np

    r = random.Random(8)
    for _ in range(400):
        n = r.choice([5, 24, 26, 60, 130, 400])
        common = -(-80 * n // 100)
        pool = r.sample(range(1 << 40), 2 * n)
        a = pool[:n]
        b = a[:common] if r.random() < 0.5 else a[:common + (n - common) // 2]
        b = b + pool[n:n + r.randint(0, max(0, 100 * len(b) // 80 - n))]
        inter = len(set(a) & set(b))
        if 100 * inter < 80 * len(set(a) | set(b)):
            continue
        often = set(r.sample(pool, r.choice([0, n, 2 * n])))
        keys = []
        for s in (a, b):
            p = np.sort(np.array(s))[:J.prefix_length(len(s), 80)].tolist()
            keys.append(set(J.entries([t for t in p if t not in often], [t for t in p if t in often], len(s), 80)))
        assert keys[0] & keys[1]


def test_empty_table(make_docs):
    assert J.op8_jaccard_join(make_docs([])).count() == 0
    assert J.one_of_each(make_docs([None, "", "", "x"], [5, 5, 5, None])).count() == 4 - 2
