"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from
the make-up of its characters, the repetition of its words and a small hashed
bag of words, then by a tanh layer. Gated attention weighs the passages, the
weighted sum is scored. Only document labels are known; passages get their
weights from training.

The network learns from at most `max_docs` labelled documents of the learning
folds (by hash of the id, equal texts once, texts of up to `max_chars`
characters); every passage of every document is scored, whatever its length.

Defined results: null and empty texts are one empty passage; repeated rows are
scored each; of conflicting labels the higher counts; rows with a null doc_id
carry no label; without labels of both kinds every score is the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_rows, mix, utf8, word_hashes
from .toxicity import fold

PASSAGE = 64
BUCKETS, SURFACE = 32, 14
HIDDEN, GATE = 24, 12
MAX_DOCS, MAX_CHARS = 6_000, 60_000
LIMIT = 0.3

#: Kind of each byte: upper, lower, digit, white space, sentence mark, other ASCII, beyond ASCII.
_KIND = np.array([6 if b >= 128 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57
                  else 3 if b in (32, 9, 10, 11, 12, 13) else 4 if chr(b) in ".,;:!?'\"()-" else 5
                  for b in range(256)], np.uint8)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage of every text, number of passages of each text)."""
    data = [utf8(t) for t in texts]
    words = [d.split() or [b""] for d in data]
    sizes = np.array([len(w) for w in words], np.int64)
    count = -(-sizes // PASSAGE)
    n = int(count.sum())
    start = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(start, sizes)
    owner = np.repeat(np.cumsum(count) - count, sizes) + within // PASSAGE      # passage of each word
    flat = [w for d in words for w in d]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    per = np.bincount(owner, minlength=n).astype(np.float64)
    kinds = _KIND[np.frombuffer(b"".join(flat), np.uint8)]
    where = np.repeat(owner, lengths)
    chars = np.bincount(where * 7 + kinds, minlength=n * 7).reshape(n, 7).astype(np.float64)
    total = np.maximum(chars.sum(1), 1)
    h = word_hashes([w.translate(LOWER) for w in flat])
    key = np.sort(((owner.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(36)).astype(np.int64), minlength=n)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(key)))
    most = np.zeros(n)
    np.maximum.at(most, (key[fresh] >> np.uint64(36)).astype(np.int64), runs)
    same = np.zeros(len(flat))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    last = np.frombuffer(b"".join(w[-1:] or b" " for w in flat), np.uint8)
    first = np.frombuffer(b"".join(w[:1] or b" " for w in flat), np.uint8)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flag, minlength=n) / per

    surface = [chars[:, k] / total for k in (0, 1, 2, 4, 5, 6)]
    surface += [distinct / per, most / per, share(same), np.minimum(total / per, 40) / 10,
                share(_KIND[last] == 5), share(_KIND[first] == 0), share(lengths == 1), np.log1p(per) / 5]
    bag = np.bincount(owner * BUCKETS + (mix(h) % np.uint64(BUCKETS)).astype(np.int64),
                      minlength=n * BUCKETS).reshape(n, BUCKETS) / per[:, None] * 4
    return np.concatenate([np.stack(surface, 1), bag], 1), count


class GatedAttention:
    """Passage encoder, gated attention and document score, with training by Adam."""

    SHAPES = {"w1": (SURFACE + BUCKETS, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,),
              "c": (HIDDEN,), "d": (1,)}

    def __init__(self, prior: float = 0.5, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k == "a" else np.zeros(s)
                  for k, s in self.SHAPES.items()}
        self.p["c"] = r.normal(0, 0.1, HIDDEN)
        self.p["d"] = np.array([np.log(prior / (1 - prior))])
        self.mean, self.scale = np.zeros(SURFACE + BUCKETS), np.ones(SURFACE + BUCKETS)

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logit of each bag and what the backward step needs."""
        p = self.p
        x = (x - self.mean) / self.scale
        at = np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, at)[bag])
        alpha = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(alpha[:, None] * h, at)
        return z @ p["c"] + p["d"][0], {"x": x, "at": at, "bag": bag, "h": h, "t": t, "g": g, "alpha": alpha, "z": z}

    def gradient(self, s: dict, err: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for the error of each logit."""
        p = self.p
        dz = err[:, None] * p["c"]
        dh = s["alpha"][:, None] * dz[s["bag"]]
        da = (s["h"] * dz[s["bag"]]).sum(1)
        ds = s["alpha"] * (da - np.add.reduceat(s["alpha"] * da, s["at"])[s["bag"]])
        dt, dg = ds[:, None] * p["a"] * s["g"], ds[:, None] * p["a"] * s["t"]
        dv, du = dt * (1 - s["t"] ** 2), dg * s["g"] * (1 - s["g"])
        dh += dv @ p["v"].T + du @ p["u"].T
        d1 = dh * (1 - s["h"] ** 2)
        return {"w1": s["x"].T @ d1, "b1": d1.sum(0), "v": s["h"].T @ dv, "u": s["h"].T @ du, "a": (s["t"] * s["g"]).T @ ds,
                "c": s["z"].T @ err, "d": np.array([err.sum()])}

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01,
              ridge: float = 1e-4, seed: int = 11) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        r, t = np.random.default_rng(seed), 0
        steps = epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                t += 1
                z, state = self.forward(np.concatenate([bags[j] for j in part]), np.array([len(bags[j]) for j in part]))
                grads = self.gradient(state, (1 / (1 + np.exp(-z)) - y[part]) / len(part))
                step = rate * (1 - 0.9 * t / steps)
                for k, g in grads.items():
                    g = g + ridge * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, count)[0], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", max_docs: int = MAX_DOCS,
        max_chars: int = MAX_CHARS) -> GatedAttention:
    """A network trained on the learning folds."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out).groupBy("doc_id").agg(
        F.max("quality").alias("y"))
    # At most max_docs ids, so texts are picked where they are read and never shuffled.
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).join(chosen, "doc_id").where(
        F.length("text") <= max_chars).withColumn("h", F.xxhash64("text"))

    def make():
        def run(v: dict) -> list:
            x, count = encode(v["text"])
            edges = [0, *(np.cumsum(count) * x.shape[1]).tolist()]
            flat = x.reshape(-1)
            return [pa.array([flat[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.list_(pa.float64())), v["y"]]
        return run

    got = map_rows(rows, make, ["text", "y"], ["doc_id", "h"], {"x": "array<double>", "label": "int"}).toPandas()
    got = got.sort_values(["h", "doc_id"]).drop_duplicates("h")        # equal texts once
    if not len(got):
        net = GatedAttention()
        net.p["c"][:] = 0
        return net
    y = got["label"].to_numpy(np.float64)
    net = GatedAttention(float(np.clip(y.mean(), 0.01, 0.99)))
    if 0 < y.mean() < 1:
        net.train([np.asarray(x).reshape(-1, SURFACE + BUCKETS) for x in got["x"]], y)
    else:
        net.p["c"][:] = 0
    return net


def score(docs: DataFrame, net: GatedAttention, carry: list[str], text: str = "text", limit: float = LIMIT) -> DataFrame:
    """`carry` columns with the score of all passages, and whether it reaches the limit."""
    def make():
        def run(v: dict) -> list:
            s = net.scores(*encode(v[text]))
            return [s, (s >= limit).astype(np.int32)]
        return run

    return map_rows(docs, make, [text], carry, {"score": "double", "predicted": "int"}, text)


def op2_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    net = fit(docs, labels, held_out)
    return score(docs, net, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
