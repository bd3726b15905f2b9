"""Toxicity: non-negative positive-unlabelled learning.

Positives are documents marked toxic in the learning folds; everything else
is unlabelled text. A linear classifier over the presence of words and word beginnings minimises

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss, so its output estimates the chance of label 1. Where
the bracket turns negative the step goes against it instead of fitting noise.

At most `max_positive` and `max_unlabelled` documents are learned from (chosen
by hash of their text, equal texts once); the word list keeps the
`max_words` words that tell the two apart best, counted by Spark. Every
document is scored over its whole text.

Defined results: null and empty texts score the classifier's bias; repeated
rows are scored each; a document with conflicting labels counts as toxic; rows
with a null doc_id carry no label; without positives no score is above 1e-9.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ALNUM, explode_rows, map_rows, utf8

MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 4_000, 12_000, 1_000
LIMIT = 0.7


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased words, and for words of five bytes or more their first four with a star."""
    words = set(utf8(text).translate(LOWER_ALNUM).split())
    return words | {w[:4] + b"*" for w in words if len(w) > 4}


def learning_rows(docs: DataFrame, labels: DataFrame, held_out: Column, max_positive: int, max_unlabelled: int,
                  text: str) -> tuple[DataFrame, float]:
    """(text, positive) of the learning sample, and the class prior of the learning folds."""
    marked = labels.where(F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    prior = marked.agg(F.avg("y")).first()[0] or 0.0
    pool = docs.where(~held_out).select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    keys = pool.join(marked.where("y = 1"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    positive = keys.orderBy("h").limit(max_positive)
    unlabelled = pool.groupBy("h").agg(F.min("doc_id").alias("doc_id")).orderBy("h").limit(max_unlabelled)
    chosen = positive.select("doc_id", "h", F.lit(True).alias("positive")).unionByName(
        unlabelled.select("doc_id", "h", F.lit(False).alias("positive")))
    # At most max_positive + max_unlabelled rows of ids.
    rows = pool.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")),
                     pool["doc_id"].eqNullSafe(F.col("id")) & (pool["h"] == chosen["h"]))
    return rows.select("text", "positive"), float(prior)


def train(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 800, rate: float = 0.15,
          ridge: float = 5e-6) -> np.ndarray:
    """Weights of the non-negative risk estimator by Adam; the last column of x is the constant 1."""
    w = np.zeros(x_pos.shape[1], x_pos.dtype)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = x_pos @ w, x_unl @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        gain = x_pos.T @ (sp - 1) / len(zp)                                  # gradient of R+(positives)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = x_unl.T @ su / len(zu) - prior * (x_pos.T @ sp) / len(zp)     # gradient of the bracket
        g = (prior * gain + rest if negative >= 0 else -rest) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(x_pos.dtype)
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> tuple[dict[bytes, float], float]:
    """(weight of each word, bias)."""
    rows, prior = learning_rows(docs, labels, held_out, max_positive, max_unlabelled, text)

    def split():
        def run(v: dict) -> list:
            words, flags = [], []
            for t, p in zip(v["text"], v["positive"], strict=True):
                found = words_of(t)
                words += found
                flags += [int(p)] * len(found)
            return [words, flags]
        return run

    seen = explode_rows(rows, split, ["text", "positive"], {"word": "binary", "p": "long"})
    total = rows.agg(F.sum(F.col("positive").cast("long")), F.count("*")).first()
    n_pos, n_unl = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    if not n_pos or not n_unl:
        return {}, -1e9 if not n_pos else 1e9
    df = seen.groupBy("word").agg(F.sum("p").alias("a"), (F.count("*") - F.sum("p")).alias("b"))
    # How far the two shares differ, in standard deviations of the pooled share.
    share = (F.col("a") + F.col("b") + 1) / (n_pos + n_unl + 2)
    z = (F.col("a") / n_pos - F.col("b") / n_unl) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_unl))
    top = df.where(F.col("a") + F.col("b") >= 5).select("word", z.alias("z")).where("abs(z) > 3").orderBy(
        F.desc(F.abs("z")), "word").limit(max_words).collect()
    vocab = {bytes(r.word): i for i, r in enumerate(top)}

    def encode():
        def run(v: dict) -> list:
            return [[[i for w in words_of(t) if (i := vocab.get(w)) is not None] for t in v["text"]], v["positive"]]
        return run

    got = map_rows(rows, encode, ["text", "positive"], [], {"x": "array<int>", "p": "boolean"}).collect()
    x = np.zeros((len(got), len(vocab) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(got):
        x[i, r.x] = 1
    p = np.array([r.p for r in got])
    w = train(x[p], x[~p], prior)
    return {k: float(w[i]) for k, i in vocab.items()}, float(w[-1])


def score(docs: DataFrame, model: tuple[dict[bytes, float], float], carry: list[str], text: str = "text",
          limit: float = LIMIT) -> DataFrame:
    """`carry` columns with the score of the whole text and whether it reaches the limit."""
    weights, bias = model

    def make():
        def run(v: dict) -> list:
            z = np.array([bias + sum(weights[w] for w in sorted(words_of(t) & weights.keys())) for t in v[text]])
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            return [s, (s >= limit).astype(np.int32)]
        return run

    return map_rows(docs, make, [text], carry, {"score": "double", "predicted": "int"}, text)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs, labels, held_out)
    return score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
