"""Substring deduplication with a compressed FM-index per content shard.

A window is `window` consecutive words of one document. Every window picks its
anchor, the run of GRAM words with the least hash, leftmost among equals; equal
windows pick equal anchors. Neighbouring windows with one anchor form a
segment. Only segments whose anchor occurs at two places can hold a repeated
window, and all occurrences of a window meet in the shard of their anchor, so
each shard is indexed and searched by itself and the work grows with the text.

In a shard the distinct segments are one sequence. Its Burrows-Wheeler
transform is kept in a wavelet matrix; backward search over it, all segments in
lockstep, gives at each word the length of the longest match that occurs at
least twice. Windows within such a match are repeated.

Anchors with very many occurrences are not kept together: their segments are
cut into single windows, which fold and spread by their own hash.

Defined results: null and empty texts have no words; repeated rows repeat all
their windows; texts shorter than a window keep every word.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save_table
from .common import explode_rows, gram_hashes, map_rows, utf8, word_hashes

WINDOW, GRAM = 35, 12
#: Words of segments indexed together; an anchor is never divided.
SHARD_WORDS = 400_000
#: Occurrences beyond which an anchor's segments are cut into windows.
HOT_ANCHOR = 10_000


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return utf8(text).split()


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in every run of `width` values."""
    best, size = np.arange(len(g)), 1

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    while size * 2 <= width:
        best = merged(best[:-size], best[size:])
        size *= 2
    return merged(best[:len(g) - width + 1], best[width - size:]) if size < width else best


def segments(h: np.ndarray, starts: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(document, first window, windows, anchor) of each segment; `h` holds the words of all documents
    one after the other and `starts` where each begins, with the end of the last."""
    if len(h) < window:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    g = gram_hashes(h, gram)
    at = _least(g, window - gram + 1)
    n = len(at)
    doc = np.searchsorted(starts, np.arange(n), side="right") - 1
    inside = np.arange(n) + window <= starts[doc + 1]
    first = np.ones(n, bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first &= inside
    last = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True))
    begin = np.flatnonzero(first)
    return doc[begin], begin - starts[doc[begin]], last - begin + 1, g[at[begin]].view(np.int64)


class FMIndex:
    """Index of word sequences: wavelet matrix of the Burrows-Wheeler transform, lengths of common
    prefixes for shortening a match. Suffixes are ordered by their first 64 words, which is all
    that searches for up to 63 words need."""

    DEPTH = 64

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        n = int(sizes.sum() + len(sequences))
        text = np.zeros(n, np.int64)                       # 0 ends a sequence, words count from 1
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.concatenate(sequences) if sequences else []
        rank, width = text, 1
        order = np.argsort(rank, kind="stable")
        while width < self.DEPTH:
            nxt = np.zeros(n, np.int64)
            nxt[:n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, bool)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            width *= 2
            if fresh.all():
                break
        self.n = n
        self.sigma = int(text.max()) + 1 if n else 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self._lcp(text, order)
        self._wavelet(text[order - 1])

    def _lcp(self, text: np.ndarray, order: np.ndarray) -> None:
        """Common prefix of each row with the row before, at most DEPTH; 0 at both ends."""
        padded = np.concatenate([text, np.full(self.DEPTH, -1, np.int64)])
        lcp = np.zeros(self.n + 1, np.int16)
        live = np.arange(1, self.n)
        for d in range(self.DEPTH):
            a, b = padded[order[live] + d], padded[order[live - 1] + d]
            live = live[(a == b) & (a >= 0)]
            if not len(live):
                break
            lcp[live] = d + 1
        self.lcp = lcp
        self._borders: dict[int, np.ndarray] = {}

    def _wavelet(self, bwt: np.ndarray) -> None:
        bits = max(1, int(self.sigma - 1).bit_length())
        self.levels = []
        cur = bwt
        for level in reversed(range(bits)):
            bit = ((cur >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((level, packed, before, zeros))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.first = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, packed, before, zeros in self.levels:
            word = i >> 6
            ones = before[word] + np.bitwise_count(
                packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with the symbol, then what rows [lo, hi) start with."""
        base = self.less[symbol] - self.first[symbol]
        return base + self._descend(symbol, lo), base + self._descend(symbol, hi)

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest shorter prefix with more rows: (lo, hi, length)."""
        depth = np.maximum(self.lcp[lo], self.lcp[hi]).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        for d in np.unique(depth).tolist():
            at = depth == d
            if d == 0:
                lo[at], hi[at] = 0, self.n
                continue
            if d not in self._borders:
                self._borders[d] = np.flatnonzero(self.lcp < d).astype(np.int32)
            b = self._borders[d]
            lo[at] = b[np.searchsorted(b, lo[at], side="right") - 1]
            hi[at] = b[np.searchsorted(b, hi[at], side="left")]
        return lo, hi, depth

    def matches(self, queries: list[np.ndarray], count: int = 2, least: int = WINDOW) -> list[np.ndarray]:
        """For each query, at each word the length of the longest match from there that occurs `count`
        times; lengths that could no longer lead to one of `least` are left at 0."""
        sizes = np.array([len(q) for q in queries], np.int64)
        if not len(sizes):
            return []
        base = np.cumsum(sizes) - sizes
        flat = np.concatenate(queries)
        out = np.zeros(len(flat), np.int64)
        who = np.flatnonzero(sizes >= least)
        at = sizes[who] - 1
        lo, hi, depth = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64), np.zeros(len(who), np.int64)
        while len(who):
            a, b = self.extend(flat[base[who] + at], lo, hi)
            ok = b - a >= count
            lo, hi = np.where(ok, a, lo), np.where(ok, b, hi)
            depth = depth + ok
            out[(base[who] + at)[ok]] = depth[ok]
            lost = ~ok & (depth == 0)
            at = at - (ok | lost)
            short = ~ok & ~lost
            if short.any():
                lo[short], hi[short], depth[short] = self.shorten(lo[short], hi[short])
            keep = (at >= 0) & (depth + at + 1 >= least)
            who, at, lo, hi, depth = who[keep], at[keep], lo[keep], hi[keep], depth[keep]
        return np.split(out, base[1:])


def repeated(texts: list[str], single: list[bool], window: int) -> list[int]:
    """Bit mask of repeated windows of each segment of a shard; segments that occur more than once need no search."""
    words = [utf8(t).split(b" ") for t in texts]
    vocab: dict[bytes, int] = {}
    seqs = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in d], np.int64) for d in words]
    ask = [i for i, s in enumerate(single) if s]
    masks = [0 if s else (1 << (len(q) - window + 1)) - 1 for s, q in zip(single, seqs, strict=True)]
    if ask and len(seqs) > 1:
        for i, m in zip(ask, FMIndex(seqs).matches([seqs[i] for i in ask], 2, window), strict=True):
            masks[i] = sum(1 << int(p) for p in np.flatnonzero(m >= window))
    return masks


def _search(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words, route = 0, None

        def flush() -> pa.RecordBatch:
            masks = repeated([r[2] for r in held], [r[3] < 2 for r in held], window)
            rows = [(r[0], r[1], m) for r, m in zip(held, masks, strict=True) if m]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["s1", "s2", "mask"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("route", "s1", "s2", "words", "copies")), strict=True):
                if words >= SHARD_WORDS and row[0] != route:
                    yield flush()
                    held, words = [], 0
                route = row[0]
                held.append(row[1:])
                words += row[3].count(" ") + 1
        if held:
            yield flush()

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text) and found: (pos, mask) pairs, where bit i of the mask stands for a
    repeated window that starts at word pos + i. Documents without one are absent."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("text"))

    def anchors():
        def run(v: dict) -> list:
            words = [words_of(t) for t in v["text"]]
            starts = np.cumsum([0, *(len(w) for w in words)])
            doc, pos, n, anchor = segments(word_hashes([w for d in words for w in d]), starts, window, gram)
            ids = pa.array(v["doc_id"], pa.int64()).take(pa.array(doc))
            return [ids, np.array(v["h"], np.int64)[doc], pos * 64 + n, anchor]
        return run

    # Windows of a segment: at most window - gram + 1, so they fit the low 6 bits.
    places = explode_rows(keyed, anchors, ["doc_id", "h", "text"], {
        "doc_id": "long", "h": "long", "place": "long", "anchor": "long"})
    live = places.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    kept = places.join(live, "anchor").groupBy("doc_id", "h").agg(F.collect_list(
        F.struct("place", "anchor", (F.col("c") > HOT_ANCHOR).alias("hot"))).alias("kept"))
    same = [keyed["doc_id"].eqNullSafe(kept["doc_id"]), keyed["h"] == kept["h"]]
    rich = keyed.join(kept, same).select(keyed["doc_id"], keyed["h"], "text", "kept")

    def pieces():
        seen: set[tuple[int, int]] = set()

        def run(v: dict) -> list:
            cols: list[list] = [[] for _ in range(8)]
            for i, key, t, kept in zip(v["doc_id"], v["h"], v["text"], v["kept"], strict=True):
                words = words_of(t)
                marks = {}
                for k in kept:
                    marks.setdefault(k["place"], [k["anchor"], k["hot"], 0])[2] += 1
                found = []
                for place, (anchor, hot, copies) in marks.items():
                    pos, n = place >> 6, place & 63
                    if hot:
                        found += [(p, window, None, copies) for p in range(pos, pos + n)]
                    else:
                        found.append((pos, n + window - 1, anchor, copies))
                for pos, size, anchor, copies in found:
                    piece = b" ".join(words[pos:pos + size])
                    s = struct.unpack("<qq", hashlib.blake2b(piece, digest_size=16).digest())
                    row = (i, key, pos, copies, s[0] if anchor is None else anchor, *s,
                           None if s in seen else piece.decode("utf-8"))
                    seen.add(s)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                if len(seen) > 500_000:
                    seen.clear()
            return cols
        return run

    segs = explode_rows(rich, pieces, ["doc_id", "h", "text", "kept"], {
        "doc_id": "long", "h": "long", "pos": "long", "copies": "long", "route": "long", "s1": "long", "s2": "long",
        "words": "string"})
    segs = save_table(segs, "substring-segments")

    folded = segs.select("route", "s1", "s2", "words", "copies").repartition("route").groupBy("route", "s1", "s2").agg(
        F.max("words").alias("words"), F.sum("copies").alias("copies"))
    masks = folded.sortWithinPartitions("route").select("route", "s1", "s2", "words", "copies").mapInArrow(
        _search(window), "s1 long, s2 long, mask long")
    return segs.select("doc_id", "h", "pos", "s1", "s2").join(masks, ["s1", "s2"]).groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("pos", "mask")).alias("found"))


def without_repeats(docs: DataFrame, carry: list[str], window: int = WINDOW, text: str = "text") -> DataFrame:
    """`carry` columns with n_words, n_removed and kept, the words outside repeated windows."""
    found = repeated_windows(docs, window, text=text).select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("found").alias("__found"))
    hashed = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (hashed == F.col("__h")), "left")

    def make():
        def run(v: dict) -> list:
            total, removed, kept = [], [], []
            for t, found in zip(v[text], v["__found"], strict=True):
                words = words_of(t)
                gone = 0
                if found:
                    step = np.zeros(len(words) + 1, np.int64)
                    for f in found:
                        for i in range(f["mask"].bit_length()):
                            if f["mask"] >> i & 1:
                                step[f["pos"] + i] += 1
                                step[f["pos"] + i + window] -= 1
                    covered = np.cumsum(step[:-1]) > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                total.append(len(words) + gone)
                removed.append(gone)
                kept.append(b" ".join(words).decode("utf-8"))
            return [total, removed, kept]
        return run

    return map_rows(joined, make, [text, "__found"], carry, {"n_words": "long", "n_removed": "long", "kept": "string"}, text)


def op5_substrings(docs: DataFrame) -> DataFrame:
    """One row per document with its words, the number removed and the digest of the rest."""
    return without_repeats(docs.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
