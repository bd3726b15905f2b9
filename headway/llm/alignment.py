"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers, A and B, cut the same bytes. Where a token of each ends at the
same byte there is a cut; between two cuts lies a group, and every A token of a
group is linked with every B token of it. One NumPy state vector holds a
pointer into A and one into B for every document of a batch. Each step compares
the two ends of all documents at once, moves the pointer that is behind (both
at a cut), emits the groups whose cuts it reached and drops finished documents
from the vector. A long document enters as several lanes, split where both
tokenizers have used the same number of bytes at the border of a word, so that
the vector stays full to the end.

Words repeat, so a word (a run that starts with a space after a visible
character) is encoded once per task: no token of either tokenizer reaches over
such a border, which `tests/llm` holds against whole texts.

Corpus counts: how many documents hold an id pair linked. The commonest pairs,
all if they are few enough, go to the tasks as two arrays; rarer ones are
joined, so nothing depends on how many pairs there are.

Defined results: a null or empty text, and one whose tokens do not give back
its bytes (U+2581 reads as a space in B), has no tokens; repeated rows count as
documents of their own; null and repeated ids are kept; ties for the highest
count all count as best.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save_table
from .common import map_rows, sha256, utf8

#: Tokens of A per lane; longer documents are split into lanes.
LANE = 256
#: Distinct words whose tokens a task keeps.
CACHE_WORDS = 250_000
#: New words encoded behind one another.
GROUP = 256
#: Id pairs sent to the tasks; the rarer rest is joined.
BROADCAST_PAIRS = 2_000_000
#: Links laid out at a time, and links of a group beyond which its ids are counted first.
LAYOUT, LARGE_GROUP = 2_000_000, 4_096

_BORDER = re.compile(r"(?<=\S)(?= )")
_SPACED = re.compile(r"\s ")
# Fixed value: the bytes that byte-level vocabularies write as themselves.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, to the byte."""
    rest = [b for b in range(256) if b not in _PLAIN]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, with the byte length of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.space = self.b.piece_to_id("▁")      # B adds no space to an empty text, the last word may be one
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else utf8(token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else utf8(piece.replace("▁", " ")))
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # Written ids: the first and the later tokens of a group, of A, then of B.
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{c}{i}" for c, k in ((";", n), (",", n), ("|", m), (",", m)) for i in range(k)]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of each word by A and by B, a word with the space that B adds, and whether both give back its bytes.

        Words are encoded GROUP at a time, one behind the other, and taken apart at
        their byte lengths. What does not give back its bytes, or ends in white
        space, is encoded word by word.
        """
        alone = [w[-1].isspace() for w in words]
        size = np.fromiter((len(utf8(w)) for w in words), np.int64, len(words))
        joint = [i for i, odd in enumerate(alone) if not odd]
        groups = [joint[k:k + GROUP] for k in range(0, len(joint), GROUP)]
        texts = ["".join(map(words.__getitem__, g)) for g in groups]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        ids: tuple[list, list] = [None] * len(words), [None] * len(words)
        good = [True] * len(words)
        for g, t, *both in zip(groups, texts, a, b, strict=True):
            ends, data = np.cumsum(size[g]), utf8(t)
            cuts = []
            for x, sizes, names in zip(both, (self.a_size, self.b_size), (self.a_bytes, self.b_bytes), strict=True):
                used = np.cumsum(sizes[x])
                k = np.minimum(np.searchsorted(used, ends), len(used) - 1)
                if not (used[k] == ends).all() or b"".join(map(names.__getitem__, x)) != data:
                    break
                cuts.append([0, *(k + 1).tolist()])
            if len(cuts) < 2:
                for i in g:
                    alone[i] = True
                continue
            for out, x, cut in zip(ids, both, cuts, strict=True):
                for i, lo, hi in zip(g, cut, cut[1:], strict=False):
                    out[i] = x[lo:hi]
        for i in (i for i, odd in enumerate(alone) if odd):
            w = words[i]
            ids[0][i] = x = self.a.encode(w, add_special_tokens=False).ids
            ids[1][i] = y = self.b.encode(w[1:]) if w != " " else [self.space]
            good[i] = b"".join(map(self.a_bytes.__getitem__, x)) == utf8(w) == b"".join(map(self.b_bytes.__getitem__, y))
        return *ids, good


@lru_cache(1)
def encoders(path_a: str, path_b: str) -> Encoders:
    """One pair of tokenizers per worker process."""
    return Encoders(path_a, path_b)


def words_of(text: str) -> list[str]:
    """A space and the text, cut before every space that follows a visible character."""
    spaced = " " + text
    if _SPACED.search(spaced):
        return _BORDER.split(spaced)
    return [" " + w for w in text.split(" ")]


class Words:
    """Tokens of the words met in a task, in flat arrays."""

    def __init__(self, enc: Encoders):
        self.enc = enc
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((5, 1024), np.int64)     # start and length in A and in B, whether the bytes agree
        self.ids = [np.zeros(4096, np.int32), np.zeros(4096, np.int32)]
        self.used = [0, 0]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table; new words are encoded together."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = list(dict.fromkeys(map(words.__getitem__, new.tolist())))
            for i in range(0, len(fresh), 20_000):
                self._add(fresh[i:i + 20_000])
            at[new] = np.fromiter(map(self.index.__getitem__, map(words.__getitem__, new.tolist())), np.int64, len(new))
        return at

    def _add(self, words: list[str]) -> None:
        first = len(self.index)
        rows = np.zeros((5, len(words)), np.int64)
        *both, good = self.enc.encode(words)
        for k, ids in enumerate(both):
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
            rows[2 * k] = self.used[k] + np.cumsum(size) - size
            rows[2 * k + 1] = size
            self.ids[k] = _grown(self.ids[k], self.used[k] + len(flat))
            self.ids[k][self.used[k]:self.used[k] + len(flat)] = flat
            self.used[k] += len(flat)
        rows[4] = good
        while self.table.shape[1] < first + len(words):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, first:first + len(words)] = rows
        self.index.update(zip(words, range(first, first + len(words)), strict=True))

    def tokens(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each word) of tokenizer k for the words numbered `at`."""
        start, size = self.table[2 * k][at], self.table[2 * k + 1][at]
        return self.ids[k][spread(start, size)], size


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … for `size` places, one run after another."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, a_stop: np.ndarray,
             b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first A, A stop, first B, B stop) of every group of every lane, ordered.

    A lane is the A tokens from `a_first` to before `a_stop` and the B tokens from
    `b_first` over the same bytes; the last ends of both are equal.
    """
    live = a_first < a_stop
    pa_, pb_, stop = a_first[live].copy(), b_first[live].copy(), a_stop[live]
    ga, gb = pa_.copy(), pb_.copy()
    out: list[tuple[np.ndarray, ...]] = []
    while len(pa_):
        x, y = a_ends[pa_], b_ends[pb_]
        on_a, on_b = x <= y, y <= x
        cut = on_a & on_b
        pa_ += on_a
        pb_ += on_b
        hit = np.flatnonzero(cut)
        if len(hit):
            out.append((ga[hit], pa_[hit], gb[hit], pb_[hit]))
            ga[hit], gb[hit] = pa_[hit], pb_[hit]
            live = pa_ < stop
            if not live.all():                       # finished lanes leave the vector
                pa_, pb_, stop, ga, gb = pa_[live], pb_[live], stop[live], ga[live], gb[live]
    if not out:
        return (np.zeros(0, np.int64),) * 4
    got = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.argsort(got[0], kind="stable")
    return tuple(c[order] for c in got)


def lanes(doc_of_word: np.ndarray, a_size: np.ndarray, a_used: np.ndarray, b_used: np.ndarray) -> np.ndarray:
    """Words at which a lane begins: first words of documents, and about every LANE tokens a word
    before which both tokenizers have used the same bytes."""
    before = np.cumsum(a_size) - a_size
    head = np.diff(doc_of_word, prepend=-1) > 0
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    part = (before - before[first]) // LANE
    even = a_used == b_used
    return np.flatnonzero(head | ((np.diff(part, prepend=0) > 0) & even))


def id_pairs(doc: np.ndarray, ga: np.ndarray, sa: np.ndarray, gb: np.ndarray, sb: np.ndarray, a_ids: np.ndarray,
             b_ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, a * base + b, links) of the distinct linked id pairs of each document, ordered.

    `doc` is the document of each group; sa and sb are the sizes of the groups.
    """
    keys, times = [], []
    size = sa * sb
    space = base * (int(a_ids.max(initial=0)) + 1)
    small = np.flatnonzero(size <= LARGE_GROUP)
    edge = np.searchsorted(np.cumsum(size[small]), np.arange(LAYOUT, int(size[small].sum()) + LAYOUT, LAYOUT), side="right")
    for lo, hi in zip([0, *edge], [*edge, len(small)], strict=True):
        g = small[lo:hi]
        if len(g):
            k = spread(np.zeros(len(g), np.int64), size[g])
            wide = np.repeat(sb[g], size[g])
            code = a_ids[np.repeat(ga[g], size[g]) + k // wide].astype(np.int64) * base + b_ids[np.repeat(gb[g], size[g]) + k % wide]
            u, n = np.unique(np.repeat(doc[g], size[g]) * space + code, return_counts=True)
            keys.append(u)
            times.append(n)
    for g in np.flatnonzero(size > LARGE_GROUP):
        x, nx = np.unique(a_ids[ga[g]:ga[g] + sa[g]], return_counts=True)
        y, ny = np.unique(b_ids[gb[g]:gb[g] + sb[g]], return_counts=True)
        keys.append((doc[g] * space + x.astype(np.int64)[:, None] * base + y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, times = np.concatenate(keys), np.concatenate(times)
    if len(keys) > 1:
        key, at = np.unique(key, return_inverse=True)
        times = np.bincount(at, weights=times).astype(np.int64)
    return key // space, key % space, times


class Aligner:
    """Aligns a batch of texts."""

    def __init__(self, enc: Encoders):
        self.enc, self.words, self.base = enc, Words(enc), len(enc.b_bytes)

    def align(self, texts: list[str]) -> dict:
        """Per document: tokens of A and of B, groups; and of all, in one run each: ids, groups with their document."""
        split = [words_of(t) if t else [] for t in texts]
        per_doc = np.fromiter(map(len, split), np.int64, len(split))
        at = self.words.numbers(list(chain.from_iterable(split)))
        doc = np.repeat(np.arange(len(texts)), per_doc)
        good = self.words.table[4][at].astype(bool)
        if not good.all():
            # Only where a word differs can a text; then its bytes decide.
            for d in np.unique(doc[~good]):
                if not self._whole(texts[d], at[doc == d]):
                    keep = doc != d
                    doc, at = doc[keep], at[keep]
        a_ids, a_size = self.words.tokens(at, 0)
        b_ids, b_size = self.words.tokens(at, 1)
        a_ends, b_ends = np.cumsum(self.enc.a_size[a_ids]), np.cumsum(self.enc.b_size[b_ids])
        a_at, b_at = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        a_used, b_used = np.append(0, a_ends)[a_at], np.append(0, b_ends)[b_at]
        lane = lanes(doc, a_size, a_used, b_used)
        ga, ea, gb, eb = lockstep(a_ends, b_ends, a_at[lane], np.append(a_at[lane[1:]], len(a_ids)) if len(lane) else lane, b_at[lane])
        n = len(texts)
        of_a = np.repeat(doc, a_size)
        return {"a_ids": a_ids, "b_ids": b_ids, "ga": ga, "ea": ea, "gb": gb, "eb": eb, "doc": of_a[ga],
                "n_a": np.bincount(of_a, minlength=n), "n_b": np.bincount(np.repeat(doc, b_size), minlength=n),
                "n_groups": np.bincount(of_a[ga], minlength=n)}

    def _whole(self, text: str, at: np.ndarray) -> bool:
        want = utf8(" " + text)
        return all(b"".join(map(names.__getitem__, self.words.tokens(at, k)[0].tolist())) == want
                   for k, names in enumerate((self.enc.a_bytes, self.enc.b_bytes)))

    def written(self, r: dict) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        n, m = len(self.enc.a_bytes), self.base
        sa, sb = r["ea"] - r["ga"], r["eb"] - r["gb"]
        code = np.empty(len(r["a_ids"]) + len(r["b_ids"]), np.int64)
        # Within the run of a document an A token stands after the B tokens of earlier groups, a B token
        # after the A tokens up to its group.
        first = np.zeros(len(r["a_ids"]), bool)
        first[r["ga"]] = True
        code[np.arange(len(first)) + np.repeat(r["gb"], sa)] = r["a_ids"] + np.where(first, 0, n)
        first = np.zeros(len(r["b_ids"]), bool)
        first[r["gb"]] = True
        code[np.arange(len(first)) + np.repeat(r["ea"], sb)] = r["b_ids"] + 2 * n + np.where(first, 0, m)
        name, out, at = self.enc.written.__getitem__, [], 0
        for size in (r["n_a"] + r["n_b"]).tolist():
            out.append("".join(map(name, code[at:at + size].tolist()))[1:])
            at += size
        return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Runs of `counts` values as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, path_a: str, path_b: str, carry: list[str], text: str = "text", groups: bool = False) -> DataFrame:
    """`carry` columns with n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens) and the distinct
    linked id pairs (a * size of B + b) with their links; with `groups` also the groups as written."""
    def make():
        gc.disable()        # nothing here makes cycles, and the caches are large; `release` turns it on again
        aligner = Aligner(encoders(path_a, path_b))

        def run(v: dict) -> list:
            r = aligner.align(v[text])
            n = len(v[text])
            doc, pair, times = id_pairs(r["doc"], r["ga"], r["ea"] - r["ga"], r["gb"], r["eb"] - r["gb"],
                                        r["a_ids"], r["b_ids"], aligner.base)
            held = np.bincount(doc, minlength=n)
            links = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
            texts = aligner.written(r)
            return [r["n_a"], r["n_b"], r["n_groups"], links, [sha256(t) if t else "" for t in texts],
                    lists(pair, held, pa.int64()), lists(times, held, pa.int64()), *([texts] if groups else [])]

        run.done = aligner.words.forget
        return run

    results = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
               "pairs": "array<long>", "times": "array<long>"} | ({"groups": "string"} if groups else {})
    return map_rows(docs, make, [text], carry, results, text)


def weigh(aligned: DataFrame, base: int, carry: list[str], limit: int = BROADCAST_PAIRS) -> DataFrame:
    """`carry` columns of a written table of `align` with n_best and count_sum from the counts of all its documents."""
    spark = aligned.sparkSession
    counts = save_table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "alignment-counts")
    best = counts.groupBy(F.floor(F.col("pair") / base).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()  # one row per id of A
    few = counts.count() <= limit
    top = (counts if few else counts.orderBy(F.desc("n"), "pair").limit(limit)).toArrow()
    pair, n = top["pair"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(pair)
    highest = np.zeros(int(max(best["a"].to_numpy(), default=-1)) + 1, np.int64)
    highest[best["a"].to_numpy()] = best["n"].to_numpy()
    shared = spark.sparkContext.broadcast((pair[order], n[order], highest))
    keep = [c for c in carry if c not in ("n_best", "count_sum")]
    if not few:
        aligned = save_table(aligned.withColumn("__row", F.monotonically_increasing_id()), "alignment-rows")
        keep = [*keep, "__row"]
    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_best long, count_sum long"])
    if not few:
        ddl += ", rest array<struct<pair:long,times:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, top_of = shared.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            size = pairs.value_lengths().to_numpy(zero_copy_only=False)
            code, links = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            found = known[at] == code if len(known) else np.zeros(len(code), bool)
            n = np.where(found, often[at], 0) if len(known) else np.zeros(len(code), np.int64)
            edge = np.append(0, np.cumsum(size))
            cols = []
            for x in (links * (found & (n == top_of[code // base])), links * n):
                run_sum = np.append(0, np.cumsum(x))
                cols.append(pa.array(run_sum[edge[1:]] - run_sum[edge[:-1]], pa.int64()))
            if not few:
                left = ~found
                held = np.append(0, np.cumsum(left))
                held = held[edge[1:]] - held[edge[:-1]]
                item = pa.StructArray.from_arrays([pa.array(code[left]), pa.array(links[left])], ["pair", "times"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), item))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, "n_best", "count_sum", *([] if few else ["rest"])])

    out = aligned.select(*keep, "pairs", "times").mapInArrow(run, ddl)
    if few:
        return out
    # The rarer pairs: each is in few documents, so no key of this join is hot.
    out = save_table(out, "alignment-weighed")
    high = counts.groupBy(F.floor(F.col("pair") / base).alias("a")).agg(F.max("n").alias("high"))
    rest = out.select("__row", F.inline("rest")).join(counts, "pair").withColumn("a", F.floor(F.col("pair") / base))
    rest = rest.join(F.broadcast(high), "a").groupBy("__row").agg(
        F.sum(F.when(F.col("n") == F.col("high"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    keep = [c for c in keep if c != "__row"]
    return out.join(rest, "__row", "left").select(
        *keep, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"))


def op13_alignment(docs: DataFrame, path_a: str, path_b: str, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: tokens, groups, links, links of highest count, sum of counts, digest of the groups."""
    aligned = save_table(align(docs, path_a, path_b, ["doc_id"]), "alignment")
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return weigh(aligned, len(encoders(path_a, path_b).b_bytes), cols, limit).select(*cols[:5], "n_best", "count_sum", "groups_sha256")
