import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from headway.llm import byte_bpe as B
from headway.llm.queries import VOCABULARY

PATH = P.path(VOCABULARY)


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library():
    r, m, lib = random.Random(1), B.Merger(PATH), library()
    alphabet = list("abstredmlv''' '  \n\t\r1290½Ⅷ.,!?-_\"éßñ中日ｱ  　​😀́\x1c\x85\x00")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, "'" * 400, "ab" * 400 + " " * 700, "it's we'll they've I'm 'tis ''s 's's\n're", "x" * 90_000 + " y" * 40_000]
    for t, ids in zip(texts, m.encode(texts), strict=True):
        assert ids == lib.encode_ordinary(t)
        assert m.decode(ids) == t.encode()


def test_scan_is_associative():
    """Any blocking gives the states that stepping through gives."""
    import numpy as np

    r = random.Random(2)
    s = np.array([r.randrange(5) for _ in range(3 * B.BLOCK * B.BLOCK + 77)], np.uint8)
    state, want = B.FREE, []
    for c in s.tolist():
        want.append(state)
        state = B._step(state, c)
    assert B.scan(s).tolist() == want


def test_rows_and_round_trip(make_docs):
    texts = [None, "", "Plain text, it's 42.", "Plain text, it's 42.", "ñ" * 200_000]
    lib = library()
    got = B.op6_byte_bpe(make_docs(texts), PATH).sort("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = lib.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    full = B.encode(make_docs(texts), PATH, ["doc_id", "score"])
    assert [r.text for r in B.decode(full, PATH, ["doc_id"]).sort("doc_id").collect()] == [t or "" for t in texts]
    r = full.where("doc_id = 2").first()
    assert texts[2].encode()[r.ends[1]:r.ends[3]] == B.merger(PATH).decode(r.ids[2:4])
    assert B.op6_byte_bpe(make_docs([]), PATH).count() == 0
