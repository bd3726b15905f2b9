import random
import re

import numpy as np

from headway.llm import personal_data as P


def plain(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and (sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_rules_equal_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab@@..+1234567890 -()_%é") for _ in range(r.randint(0, 60)))
        assert P.base_spans(t) == plain(t), t


def test_propagation_is_exact_on_trees():
    r = np.random.default_rng(2)
    f = P.Field.__new__(P.Field)
    f.known, f.unary = True, r.normal(size=(P.WIDTH + 1, 5))
    f.chain, f.skip = r.normal(size=(5, 5)), r.normal(size=(5, 5))
    f.skip = f.skip + f.skip.T
    masks = [1, 2, 4, 8]
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    u = np.exp(P.bits(masks) @ f.unary)
    joint = np.einsum("a,b,c,d,ab,bc,ad->abcd", *u, np.exp(f.chain), np.exp(f.chain), np.exp(f.skip))
    joint /= joint.sum()
    P_ROUNDS, P.ROUNDS = P.ROUNDS, 60
    try:
        p = f.marginals(masks, chain, skip)
    finally:
        P.ROUNDS = P_ROUNDS
    for i in range(4):
        assert np.allclose(p[i], joint.sum(tuple(j for j in range(4) if j != i)), atol=1e-6)


CARDS = "4111111111111111 4012888888881881"


def test_rows(make_docs):
    r = random.Random(1)
    texts = [None, "", "no data"]
    for i in range(900):
        texts.append(r.choice(["call +1 (171) 555-2{:03d} now", "mail x{}@mail.example.com today", "host 10.0.3.{} up", "room {} floor 3",
                               "card 4111111111111111 paid {}", "year 19{:02d} was"]).format(r.randint(0, 99)))
    texts += ["both " + CARDS + " end", "word " * 80_000 + "a@b.co", "a@b.co", "a@b.co", "1." * 30_000 + "9" * 30_000]
    got = P.op10_personal_data(make_docs(texts)).sort("doc_id").collect()
    for row, t in zip(got, texts, strict=True):
        base = plain(t or "") if len(t or "") < 50_000 else P.base_spans(t)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert {f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(row.spans.split(","))
    # The rule takes both numbers for one of 32 digits and drops it; the field finds cards there.
    assert got[903].n_card == 0 and "card:" in got[903].spans
    assert P.op10_personal_data(make_docs([])).count() == 0
    assert P.op10_personal_data(make_docs(["a", None])).where("spans != ''").count() == 0
