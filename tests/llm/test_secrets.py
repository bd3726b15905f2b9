import math
import re
from collections import Counter

from headway.llm import secrets as S

TOKEN = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"


def plain(t):
    out = []
    for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out)


CASES = ["", "no secret here", f'token = "{TOKEN}" é', "PassWord:hunter22 api_key='abc' APIKEY=xyz_123", "AKIA" + "A1" * 8, "AKIA" + "B" * 15,
         TOKEN, "é" * 50 + " " + TOKEN[:23] + " " + TOKEN[:24], "secret=short secret: longer1", "tokentoken=a.b-c_d/e=", "passwd==" + TOKEN,
         "Kiey=ſecret=abcdefg", "123e4567-e89b-12d3-a456-426614174000"]


def test_rules():
    for t in CASES:
        assert S.base_spans(t) == plain(t), t


def test_entropy_equals_brute_force():
    for s in (TOKEN, "a" * 40 + TOKEN, "aA1" * 20 + "Xy7kQ9zLm2Np4Rs8TvWb3C", "Z" * 19):
        for limit in (2.0, 3.0, 3.8):
            want = set()
            for i in range(len(s) - S.WINDOW + 1):
                c = Counter(s[i:i + S.WINDOW])
                if -sum(k / S.WINDOW * math.log2(k / S.WINDOW) for k in c.values()) >= limit - 1e-9:
                    want |= set(range(i, i + S.WINDOW))
            assert set().union(*(range(a, b) for a, b in S.dense_windows(s, limit))) == want


def test_method_adds_and_allow_list_suppresses():
    key = "Xy7kQ9zLm2Np4Rs8TvWb3C"
    assert S.scan(f"key {key} end")[1] == [(4, 3, 26)]
    assert S.scan(f"key EXAMPLE{key} end")[1] == []
    base, spans = S.scan(f"token={key}")
    assert base == spans == [(0, 0, 28)]
    assert S.redact("a token=abcdef12 b " + TOKEN, S.scan("a token=abcdef12 b " + TOKEN)[1]) == "a [SECRET] b [SECRET]"


def test_allow_list_hides_no_neighbour():
    key = "iK2ZWeqhFWCEPyYngFb51yBMWXaSCrUZoL8g5ubb"
    letters = "QwZrTyUbOpAsDfGhJkLxCvBnMqWe"
    for text in (f"SAMPLE_SERVICE_KEY={key}", f"/srv/example/{key}", f"{key}/dummy/{key}", f"12345678-{key}", f"run={letters}"):
        want = [k for k in (key, letters) if k in text]
        got = [text[a:b] for a, b in S.entropy_spans(text)]
        assert got and all(any(w in g for g in got) for w in want), (text, got)
        assert not any(w in S.redact(text, S.scan(text)[1]) for w in want)
    assert S.entropy_spans("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == []
    assert S.entropy_spans("internationalisation-of-documentation/handlers") == []
    assert S.fragments("x" * 25, S.ALLOWED) == [] and S.fragments("", S.ALLOWED) == []
    assert S.fragments("y" * 20 + "=sample=" + "z" * 19, S.ALLOWED) == [(0, "y" * 20 + "="), (27, "=" + "z" * 19)]


def test_rows(make_docs):
    texts = [None, *CASES, "x " * 200_000 + TOKEN, TOKEN, TOKEN]
    got = S.op4_secrets(make_docs(texts)).sort("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        base = plain(t or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(S.written(base).split(",")) <= set(r.spans.split(",")) | {""}
    assert S.op4_secrets(make_docs([])).count() == 0


def test_rest_of_an_entropy_span_beside_a_rule_stays():
    key, secret = "Xy7kQ9zLm2Np4Rs8TvWb3C", "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ3tH8sLk0Vd"
    access = "AKIA" + "Q7W2E9R4T1Y6U3I8"
    hexa = TOKEN[:32]
    for text in (f"{key}-{hexa}", f"{hexa}-{key}", f"{access}/{secret}", f"{key}/{hexa}/{secret}", f"{key}-{hexa}_{access}={secret}"):
        base, spans = S.scan(f"see {text} end")
        assert base == plain(f"see {text} end") and set(base) <= set(spans)
        got = [f"see {text} end"[a:b] for a, k, b in spans if k == 3]
        want = [x for x in (key, secret) if x in text]
        assert [w in g for w, g in zip(want, got, strict=True)] == [True] * len(want), (text, spans)
        assert not any(part in S.redact(f"see {text} end", spans) for part in (key, secret, hexa, access))
        found = set().union(*(range(a, b) for a, b in S.entropy_spans(f"see {text} end")))
        kept = set().union(*(range(a, b) for a, _, b in spans))
        assert all(f"see {text} end"[i] in S.SEPARATORS for i in found - kept)
