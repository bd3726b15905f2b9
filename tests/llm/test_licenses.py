import bisect
import math

from pyspark.sql import functions as F

from headway.llm import licenses as L

DIR = "/root/testdata/sf0.01"


def test_families(spark, make_docs):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in L.op9_licenses(docs).collect()}
    marks = {"gpl": "GNU General Public License", "proprietary": "All rights reserved.", "cc_by_nc": "CC BY-NC 4.0",
             "mit": "MIT License", "apache": "Apache License"}
    rows = docs.collect()
    for r in rows:
        assert got[r.doc_id].families == ",".join(sorted(k for k, m in marks.items() if m in r.text))
        assert got[r.doc_id].n_paragraphs == sum(bool(p.strip(" ")) for p in r.text.split("\n"))
    plan = L.op9_licenses(docs.limit(5))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

    texts = [None, "", "\n \n", "All rights reserved.", "all   RIGHTS reserved", "the rights of the people are not reserved for kings",
             "We got a license to drive under the law.", "word " * 60_000 + "\nReleased under the MIT License.", "Licensed under CC BY 4.0.\nx",
             "Licensed under CC BY 4.0.\nx", "Fine day.\nReleased under the BSD 3-Clause License.\nAll rights reserved."]
    model = L.fit(docs)
    fit, L.fit = L.fit, lambda *a: model
    try:
        rows = L.op9_licenses(make_docs(texts)).sort("doc_id").collect()
        assert L.op9_licenses(make_docs([])).count() == 0
    finally:
        L.fit = fit
    assert [r.families for r in rows] == ["", "", "", "proprietary", "proprietary", "", "", "mit", "cc_by", "cc_by", "bsd,proprietary"]


def test_learns_without_a_corpus(make_docs):
    assert [r.n_paragraphs for r in L.op9_licenses(make_docs([None, ""])).collect()] == [0, 0]


def test_limit_is_taken_from_all_paragraphs(spark, make_docs, prose, monkeypatch):
    """Two licence-like lines among those held back from the sample do not set the limit of 3,000."""
    monkeypatch.setattr(L, "MAX_UNKNOWN", 300)

    def hashed(lines):
        df = spark.createDataFrame([(x,) for x in lines], "p string")
        return sorted((r.h, r.p) for r in df.select("p", F.xxhash64("p").alias("h")).collect())

    plain = hashed(prose(15, i) for i in range(3_000))
    least, planted = [h for h, _ in plain], []
    for h, line in hashed(f"Licensed under the terms agreed in town {i}." for i in range(3_000)):
        at = bisect.bisect(least, h)
        if len(planted) < 2 and (at + 1) % 3 == 0:
            planted.append(line)
            least.insert(at, h)
            last = at
    assert last < 300
    lines = [p for _, p in plain] + planted
    model = L.fit(make_docs(["\n".join(lines[i:i + 60]) for i in range(0, len(lines), 60)] + lines[:500]))
    known = L._constant(model.known, "array<struct<label:int,grams:array<bigint>>>")
    grams = L.grams_of(L.words_of(F.col("p")))
    top = F.coalesce(F.array_max(F.slice(model.probabilities(grams), 2, len(L.FAMILIES))), F.lit(0.0))
    rows = spark.createDataFrame([(x,) for x in lines], "p string").select(
        "p", F.xxhash64("p").alias("h"), top.alias("top"), L.likest(grams, known).alias("match")).sort("h").collect()
    assert all(r.match < L.CONFIRM for r in rows)
    rest = sorted(r.top for i, r in enumerate(rows, 1) if i > 300 or i % 3 == 0)
    assert model.limit == max(0.5, rest[math.ceil(0.999 * len(rest)) - 1])
    assert model.limit < min(r.top for r in rows if r.p in planted)
