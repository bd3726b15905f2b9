import numpy as np
from pyspark.sql import functions as F

from headway.llm import quality as Q
from headway.llm import toxicity as T

DIR = "/root/testdata/sf0.01"


def test_risk_gradient_follows_the_prior():
    """With a word that only positives have, scores separate and the rest stays near the prior of hidden positives."""
    r = np.random.default_rng(0)
    pos = np.c_[np.ones(200), r.random((200, 3)) < 0.5, np.ones(200)].astype(np.float32)
    unl = np.c_[r.random(2000) < 0.1, r.random((2000, 3)) < 0.5, np.ones(2000)].astype(np.float32)
    w = T.train(pos, unl, 0.1)
    s = 1 / (1 + np.exp(-(unl @ w)))
    assert s[unl[:, 0] == 1].mean() > 0.7 and s[unl[:, 0] == 0].mean() < 0.1


def test_toxic_rows(spark, make_docs):
    clean = ["heron marsh stone river" + str(i) for i in range(60)]
    bad = [f"you idiot moron river{i} " + ("stupid" if i % 2 else "scum") for i in range(40)]
    texts = [None, "", "moron", *clean, *bad, "word " * 100_000 + "idiot moron scum", bad[0], bad[0]]
    ids = [None, *range(1, len(texts))]
    labels = [(i, None if i == 9 else int(3 + 60 <= i < 103)) for i in range(1, len(texts))] + [(70, 0), (70, 1), (None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("score", F.lit("clash"))
    got = T.op1_toxicity(make_docs(texts, ids), lab)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(texts)
    rows = {r.doc_id: r for r in got.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    toxic = {i for i, t in zip(ids, texts, strict=True) if t in bad}
    assert {i for i, r in rows.items() if r.predicted} >= toxic
    assert not any(rows[i].predicted for i in range(3, 63))
    assert T.op1_toxicity(make_docs(["x"]), lab.limit(0)).first().score < 1e-9
    assert T.op1_toxicity(make_docs([]), lab).count() == 0


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = int(y.sum())
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held(spark, rows, column):
    r = rows.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return auc(r[column].to_numpy(), r["score"].to_numpy()), r


def test_held_out_toxicity(spark):
    rows = T.op1_toxicity(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    assert held(spark, rows, "toxic")[0] > 0.85


def test_held_out_quality(spark):
    rows = Q.op2_quality(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    score, r = held(spark, rows, "quality")
    assert score > 0.95 and ((r.score >= 0.3).astype(int) == r.predicted).all()


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    net, count = Q.GatedAttention(), np.array([1, 4, 2])
    x, y = r.normal(size=(7, Q.SURFACE + Q.BUCKETS)), np.array([0.0, 1.0, 1.0])

    def loss():
        z = net.forward(x, count)[0]
        return (np.logaddexp(0, z) - y * z).sum()

    z, state = net.forward(x, count)
    grads = net.gradient(state, 1 / (1 + np.exp(-z)) - y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = net.p[k][i], 1e-5
        net.p[k][i] = old + eps
        up = loss()
        net.p[k][i] = old - eps
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_passages_cover_whole_texts():
    texts = ["", "a", " ".join(["word"] * 64), " ".join(["word"] * 65), "x\n" * 1000]
    x, count = Q.encode(texts)
    assert count.tolist() == [1, 1, 1, 2, 16] and np.isfinite(x).all() and len(x) == 21
    alone = np.concatenate([Q.encode([t])[0] for t in texts])
    assert np.allclose(alone, x)


def test_quality_rows(spark, make_docs):
    texts = [None, "", "A fair sentence of words. " * 5, "### $$$ %%% " * 10, "w " * 150_000, "same", "same"]
    lab = spark.createDataFrame([(2, 1), (3, 0), (3, None), (None, 1)], "doc_id long, quality int")
    for labels in (lab, lab.limit(0), lab.where("quality = 1")):
        got = Q.op2_quality(make_docs(texts, [None, 1, 2, 3, 4, 5, 5]), labels).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert Q.op2_quality(make_docs([]), lab).count() == 0
