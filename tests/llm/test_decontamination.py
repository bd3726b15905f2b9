import hashlib
import random
import re

from headway.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute(text, items, window=13):
    w, hit, ids = words(text), set(), set()
    for key, t in items:
        v = words(t)
        for g in ([v[i:i + window] for i in range(len(v) - window + 1)] if len(v) >= window else [v] if v else []):
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    ids.add("null" if key is None else str(key))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_automaton_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        voc = r.choice(["ab", "abc", "abcdefgh"])
        text = lambda n: " ".join(r.choice(voc) for _ in range(n))
        items = [(str(i), text(r.randint(0, 9))) for i in range(r.randint(0, 6))]
        docs = [text(r.randint(0, 40)) for _ in range(4)]
        sam = D.Automaton([(k, D.words_of(t)) for k, t in items], 4)
        for t, (spans, found) in zip(docs, sam.search([D.words_of(t) for t in docs]), strict=True):
            n, hit, n_items, digest, _ = brute(t, items, 4)
            assert sum(b - a for a, b in spans) == hit and len(found) == n_items
            assert hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() == digest


def test_rows(spark, make_docs, prose):
    item = prose(20, 1)
    items = [(7, item), (7, item), (12, "Two words!"), (None, prose(15, 2)), (3, None), (4, ""), (5, "...")]
    texts = [None, "", "…", item.upper(), prose(300, 3) + " " + " ".join(item.split()[3:16]), "x two WORDS", prose(14, 2), prose(14, 2),
             prose(30_000, 5) + " " + item, "two"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.op3_decontamination(make_docs(texts), bench).sort("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute(t, items) for t in texts]
    sharded = D.judged(D.find_spans(make_docs(texts), bench, ["doc_id"], shard_chars=60)).sort("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in sharded] == [brute(t, items)[:3] for t in texts]
    assert D.op3_decontamination(make_docs(texts), bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert D.op3_decontamination(make_docs([]), bench).count() == 0


def test_spans_are_cut(spark, make_docs, prose):
    item = prose(60, 8)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = prose(5_000, 9)
    got = D.find_spans(make_docs([long + "\n" + item + "\n" + long, prose(40, 10) + " " + " ".join(item.split()[:20]), long]),
                       bench, ["doc_id", "items"], clean=True).sort("doc_id").collect()
    assert got[0].clean_text == long + "\n\n" + long and got[1].clean_text == prose(40, 10) + " " and got[2].clean_text == long
    assert got[0]["items"] == ["1"]
