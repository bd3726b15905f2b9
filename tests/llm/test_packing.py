import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from headway.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cases(prose):
    r = random.Random(4)
    odd = ["a  b\n c", "Don't STOP, we'll go.", "<|endoftext|> x<|startoftext|>y", "ÀÉÎ é ΣΑΣ İstanbul ŉ", "ab\x1ccd", "x　y\x85z w", "日本語 です",
            "word*** #tag (paren) 12,345.6", "́a é", "'s 't 'S", "\x00", "ǅ ª º ß ẞ", "naïve..., «a» “b”", "\t\n ", "ΑΣ. ﬁ", "K Å"]
    return [None, "", *odd, *(prose(n, n) for n in (1, 40, 400)), prose(9_000, 2), "x " * 2047, "x " * 2048, "x " * 4095,
            "".join(chr(r.randrange(32, 0x2fff)) for _ in range(600)), *(prose(r.randint(5, 500), 50 + i) for i in range(120))]


def check(rows, texts_by_id, library, capacity):
    """Every piece of every document once, with its ids; sequences without gaps or overflow."""
    want = defaultdict(list)
    for d, t in texts_by_id:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a:a + capacity], "<u4")
            want[d].append((k, a, len(part), zlib.crc32(part.tobytes())))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    for s in sequences.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= capacity
    return len(sequences), -(-sum(n for v in want.values() for _, _, n, _ in v) // capacity)


def test_pieces_and_sequences(make_docs, prose, library, monkeypatch):
    texts = cases(prose)
    ids = list(range(len(texts)))
    ids[4], ids[7] = None, ids[8]
    rows = K.op11_packing(make_docs(texts, ids), PATH).collect()
    found, least = check(rows, list(zip(ids, texts, strict=True)), library, K.CAPACITY)
    assert found <= least + 1
    # Small blocks: several levels, several rounds.
    monkeypatch.setattr(K, "BLOCK", 24)
    monkeypatch.setattr(K, "LOOSE", 2)
    rows = K.op11_packing(make_docs(texts, ids), PATH).collect()
    small, least = check(rows, list(zip(ids, texts, strict=True)), library, K.CAPACITY)
    assert small <= least + 3


def test_word_ids_equal_the_library(prose, library, monkeypatch):
    texts = [t or "" for t in cases(prose)]
    ids, counts = K.WordIds(PATH).encode(pa.array(texts))
    monkeypatch.setattr(K, "CACHE_PARTS", 3)
    encoder = K.WordIds(PATH)
    assert np.concatenate([encoder.encode(pa.array([t]))[0] for t in texts]).tolist() == ids.tolist()
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at:at + n].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], t[:40]
        at += n


def test_crossover_keeps_every_piece_and_whole_bins():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 100, rng.integers(1, 200)))[::-1]
        first = K.evolve(sizes, [], [0], 100)[0]
        second = K.mutate(rng, sizes, first, 100)
        child = K.crossover(rng, sizes, first, second, 100)
        for g in (first, second, child):
            fill = np.bincount(g, weights=sizes)
            assert g.min() == 0 and fill.max() <= 100 and fill.min() > 0


def test_evolution_beats_best_fit_decreasing():
    """Planted bins without waste whose pieces best-fit decreasing cannot put together again."""
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(12):
        cuts = [np.diff(np.sort(np.append(rng.integers(200, 900, 2), [0, 1000]))) for _ in range(40)]
        sizes = np.sort(np.concatenate([c[c > 0] for c in cuts]))[::-1]
        plain = np.zeros(len(sizes), np.int64)
        K.best_fit(sizes.tolist(), list(range(len(sizes))), plain, [], 1000)
        groups = []
        for k in range(4):
            groups = K.evolve(sizes, groups, [0, k], 1000)
        assert K.cost(sizes, groups[0]) <= K.cost(sizes, plain)
        better += K.cost(sizes, groups[0]) < K.cost(sizes, plain)
    assert better >= 6


def test_empty_and_repeated_rows(make_docs, library):
    assert K.op11_packing(make_docs([]), PATH).count() == 0
    docs = make_docs(["same text", "same text", None], [1, 1, None])
    rows = K.op11_packing(docs, PATH).collect()
    assert check(rows, [(1, "same text"), (1, "same text"), (None, None)], library, K.CAPACITY) == (1, 1)
    wide = K.pack_documents(docs, PATH, ["doc_id", "lang", "items"], capacity=2)
    assert {"lang", "items", "sequence_id"} <= set(wide.columns) and wide.count() == 5
