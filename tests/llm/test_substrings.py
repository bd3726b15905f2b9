import hashlib
import random
from collections import Counter

import numpy as np

from headway.llm import substrings as S


def brute(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_matching_statistics_equal_brute_force():
    r = random.Random(5)
    for _ in range(120):
        window, voc = r.choice([3, 5, 8]), r.choice([1, 2, 3, 6])
        seqs = [np.array([r.randint(1, voc) for _ in range(r.randint(1, window + 12))]) for _ in range(r.randint(1, 12))]
        seen = Counter(tuple(s[i:i + k]) for s in seqs for k in range(1, 24) for i in range(len(s) - k + 1))
        for s, m in zip(seqs, S.FMIndex(seqs).matches(seqs, 2, window), strict=True):
            for i in range(len(s)):
                longest = max((k for k in range(1, len(s) - i + 1) if seen[tuple(s[i:i + k])] > 1), default=0)
                assert m[i] == longest or (longest < window and m[i] == 0)


def test_segments_hold_every_window_once():
    r = random.Random(6)
    sizes = [0, 3, 34, 35, 36, 200, 60, 0]
    h = np.array([r.randrange(40) for _ in range(sum(sizes))], np.uint64)
    starts = np.cumsum([0, *sizes])
    got = Counter((d, p + i) for d, p, n, _ in zip(*S.segments(h, starts), strict=True) for i in range(n))
    assert got == Counter((d, p) for d, n in enumerate(sizes) for p in range(n - 34))


def test_rows(make_docs, prose, monkeypatch):
    shared, line = prose(60, 1), prose(40, 2)
    texts = [None, "", "a", prose(100, 3) + " " + shared + " " + prose(50, 4), shared + "\t" + prose(20, 5), prose(34, 6), prose(34, 6),
             prose(35, 7), prose(35, 7), "la " * 300, prose(20, 8) + " " + line + " " + line + " end", prose(200, 9), "é" + prose(200, 9),
             prose(15_000, 10), prose(90, 11), prose(90, 11)]
    texts += [f"{prose(10, 100 + i)} {line} {prose(10, 200 + i)}" for i in range(30)]
    ids = list(range(len(texts)))
    ids[15] = ids[14]                              # a repeated row
    ids[5] = None

    def rows():
        got = S.op5_substrings(make_docs(texts, ids)).collect()
        return sorted((tuple(r) for r in got), key=repr)

    want = sorted(((i, *b) for i, b in zip(ids, brute(texts), strict=True)), key=repr)
    assert rows() == want
    monkeypatch.setattr(S, "HOT_ANCHOR", 3)        # frequent anchors are cut into windows
    monkeypatch.setattr(S, "SHARD_WORDS", 200)     # and shards are many
    assert rows() == want
    assert S.op5_substrings(make_docs([])).count() == 0
