import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from headway.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def enc():
    return A.encoders(*PATHS)


def ends(ids, names):
    at, out = 0, []
    for i in ids:
        at += len(names[i])
        out.append(at)
    return out


def plain(text, enc):
    """Groups of a whole text, straight from both libraries."""
    if not text:
        return []
    a, b = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(enc.a_bytes[i] for i in a) != whole or b"".join(enc.b_bytes[i] for i in b) != whole:
        return []
    x, y = ends(a, enc.a_bytes), ends(b, enc.b_bytes)
    cuts = sorted(set(x) & set(y))
    groups, i, j = [], 0, 0
    for c in cuts:
        p, q = x.index(c, i) + 1, y.index(c, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


def brute(rows, enc):
    groups = [plain(t, enc) for _, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    n = Counter(p for k in links for p in k)
    best = defaultdict(int)
    for (a, _), c in n.items():
        best[a] = max(best[a], c)
    out = []
    for (d, _), g, k in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(k.values()),
                    sum(m for p, m in k.items() if n[p] == best[p[0]]), sum(m * n[p] for p, m in k.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def cases(prose):
    r = random.Random(5)
    odd = ["a  b", " a", "a ", "  ", "\n", "a\n b", "a\n\n  b c\t d", "x  y", "x　y z", "<|endoftext|> <s> </s> <0x0A>", "a▁b", "a ▁b ok",
           "\x00 a\x00", "don't we'll I'M", "日本語のテキスト です", "😀😀 emoji é é", "ÀÉ\x85 b\x1c c", "naïve " * 30, "​   x",
           "".join(r.choice("aZ9+/é日 ") for _ in range(300)), "A" * 500, "".join(chr(r.randrange(32, 0x3000)) for _ in range(400))]
    return [None, "", *odd, *(prose(n, n) for n in (1, 7, 300)), prose(5_000, 3), prose(300, 300), "ba" * 3_000]


def test_equals_brute_force(make_docs, prose, enc, monkeypatch):
    monkeypatch.setattr(A, "LANE", 32)
    texts = cases(prose)
    ids = list(range(len(texts)))
    ids[3], ids[5] = ids[4], None
    want = brute(list(zip(ids, texts, strict=True)), enc)
    for limit in (A.BROADCAST_PAIRS, 20, 0):            # all pairs sent to the tasks, some, none
        got = A.op13_alignment(make_docs(texts, ids), *PATHS, limit=limit).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_small_limits_change_nothing(prose, enc, monkeypatch):
    texts = [t or "" for t in cases(prose)]
    want = A.Aligner(enc).written(A.Aligner(enc).align(texts))
    assert want == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(t, enc)) for t in texts]
    monkeypatch.setattr(A, "CACHE_WORDS", 3)
    aligner = A.Aligner(enc)
    assert [w for t in texts for w in aligner.written(aligner.align([t]))] == want
    r = aligner.align(texts)
    sizes = r["ea"] - r["ga"], r["eb"] - r["gb"]
    pairs = A.id_pairs(r["doc"], r["ga"], sizes[0], r["gb"], sizes[1], r["a_ids"], r["b_ids"], aligner.base)
    for layout, large in ((7, 4096), (2_000_000, 1), (50, 3)):
        monkeypatch.setattr(A, "LAYOUT", layout)
        monkeypatch.setattr(A, "LARGE_GROUP", large)
        again = A.id_pairs(r["doc"], r["ga"], sizes[0], r["gb"], sizes[1], r["a_ids"], r["b_ids"], aligner.base)
        assert all(np.array_equal(x, y) for x, y in zip(pairs, again, strict=True))


def test_lockstep_of_random_ends():
    r = random.Random(1)
    for _ in range(200):
        a, b, first, stop, other, want = [], [], [], [], [], []
        base = 0
        for _ in range(r.randint(0, 5)):
            n = r.randint(1, 30)
            x, y = (sorted({n, *r.sample(range(1, n + 1), r.randint(0, n))}) for _ in range(2))
            first.append(len(a))
            other.append(len(b))
            i, j = len(a), len(b)
            for c in sorted(set(x) & set(y)):
                p, q = len(a) + x.index(c) + 1, len(b) + y.index(c) + 1
                want.append((i, p, j, q))
                i, j = p, q
            a += [base + k for k in x]
            b += [base + k for k in y]
            stop.append(len(a))
            base += n
        got = A.lockstep(*(np.array(v, np.int64) for v in (a, b, first, stop, other)))
        assert list(zip(*(c.tolist() for c in got), strict=True)) == want


def test_general_operator_and_empty_table(make_docs, enc):
    rows = A.align(make_docs(["one two", None]), *PATHS, ["doc_id", "lang", "items"], groups=True).sort("doc_id").collect()
    assert rows[0].groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain("one two", enc))
    assert rows[0].lang == "en" and rows[0].items == "extra" and rows[1].groups == "" and rows[1].n_links == 0
    assert A.op13_alignment(make_docs([]), *PATHS).count() == 0
