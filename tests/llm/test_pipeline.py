import corpus_pipeline as C
from headway.llm import byte_bpe, decontamination, secrets, toxicity
from headway.llm.common import read
from headway.llm.queries import VOCABULARY
from pyspark.sql import functions as F
from test_decontamination import brute as contamination
from test_jaccard import sets

DIR = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_version(spark):
    import public_tokenizers

    docs = [r.asDict() for r in read(spark, DIR, "documents").collect()]
    model = toxicity.fit(read(spark, DIR, "documents"), read(spark, DIR, "labels"), toxicity.fold(F.col("doc_id"), 3) == 1)
    weights, bias = model
    kept = [d for d in docs if 1 / (1 + 2.718281828459045 ** -(bias + sum(weights.get(w, 0) for w in toxicity.words_of(d["text"])))) < 0.7]
    assert 0 < len(kept) < len(docs)
    s = {d["doc_id"]: sets(d["text"]) for d in kept}
    links = {i: {j for j in s if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) and s[i] & s[j]} for i in s}
    first = set()
    for i in s:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        if i == min(seen):
            first.add(i)
    assert len(first) < len(kept)
    items = [tuple(r) for r in read(spark, DIR, "benchmark").select("item_id", "text").collect()]
    kept = [d for d in kept if d["doc_id"] in first and not contamination(d["text"], items)[4]]
    m = byte_bpe.merger(public_tokenizers.path(VOCABULARY))
    want = {}
    for d in kept:
        t = secrets.redact(d["text"], secrets.scan(d["text"])[1])
        want[d["doc_id"]] = (d["lang"], d["source"], len(t), m.encode([t])[0])
    got = {r.doc_id: (r["lang"], r["source"], r.n_chars, r.ids) for r in C.run(spark, DIR).collect()}
    assert got == want


def test_stages_keep_columns(spark, make_docs):
    labels = read(spark, DIR, "labels")
    assert labels.count()
    docs = read(spark, DIR, "documents").limit(0)
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() == 0
    assert C.STAGES[-1][1](spark, docs, DIR).count() == 0


def test_benchmark_stage_leaves_clean_documents_alone(spark, make_docs):
    texts = ["plain text", None, "", read(spark, DIR, "benchmark").first().text]
    src = make_docs(texts).select("doc_id", "text", "lang", "source", "n_chars")
    got = C.decontaminate(spark, src, DIR).sort("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [(0, "plain text"), (1, None), (2, "")]
    assert decontamination.WINDOW == 13


def test_null_empty_and_repeated_rows(spark, make_docs, prose):
    a, b = prose(30, 1), prose(30, 2)
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    src = make_docs([None, "", a, b, a, "key = token=abcdef12 end", "key = token=abcdef12 end"], [1, 2, 5, 5, 9, 7, 7]).select(*cols)
    scanned = sorted(((r.doc_id, r.text, r.n_chars) for r in C.scan_secrets(spark, src, DIR).collect()), key=repr)
    marked = "key = [SECRET] end"
    assert scanned == sorted([(1, None, None), (2, "", 0), (5, a, len(a)), (5, b, len(b)), (9, a, len(a)), *[(7, marked, len(marked))] * 2], key=repr)
    left = sorted(((r.doc_id, r.text) for r in C.drop_near_copies(spark, src, DIR).collect()), key=repr)
    assert left == sorted([(1, None), (2, ""), (5, a), (5, b), (7, "key = token=abcdef12 end")], key=repr)
    ids = C.tokenize(spark, src, DIR).collect()
    assert len(ids) == 7 and {r.n_tokens for r in ids if r.doc_id in (1, 2)} == {0}
