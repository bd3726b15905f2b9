import hashlib

from headway.llm import fingerprints as I

DIR = "/root/testdata/sf0.001"


def edited(rows):
    """Each id's edited text: ids ascending, missing ones first, the last followed by the first."""
    out = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = a or "", b or ""
        half = len(a) // 2
        out.append((i, len(a), hashlib.sha256((a[:len(a) - half] + b[:half]).encode()).hexdigest()))
    return out


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(I, "BUCKET_DOCS", 7)                # many ranges and buckets
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = I.op7_fingerprints(docs).sort("doc_id").collect()
    src = [tuple(r) for r in docs.select("doc_id", "text").sort("doc_id").collect()]
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in rows] == edited(src)
    by_text = {}
    for r, (_, t) in zip(rows, src, strict=True):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)
    assert not any("Python" in x or "Arrow" in x for x in [I.op7_fingerprints(docs)._jdf.queryExecution().toString()])


def test_edge_rows(make_docs, prose):
    texts = [None, "", "é", prose(9_000, 3), prose(40, 4), prose(40, 4), "😀 b c d"]
    ids = [None, -5, 0, 2**62, 1, 1, 7]
    got = I.op7_fingerprints(make_docs(texts, ids)).collect()
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(edited(order), key=repr)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    lone = I.op7_fingerprints(make_docs(["abcd"])).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1.0
    assert I.op7_fingerprints(make_docs([])).count() == 0


def test_band_and_table(spark, make_docs):
    docs = make_docs(["rare common", "middle common", "middle common", "common"])
    h = {w: spark.sql(f"select xxhash64('{w}')").first()[0] for w in ("rare", "middle", "common")}
    assert I.lexicon(docs, least=0.4, most=0.6) == [h["middle"]]
    assert I.lexicon(docs, least=0.4, most=1.0) == sorted([h["middle"], h["common"]])
