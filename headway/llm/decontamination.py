"""Benchmark decontamination with a generalised suffix automaton over item words.

The items of one shard (a bounded number of characters) are broadcast as text
and each worker builds their automaton once; documents stream past it without
a shuffle. More shards mean more passes over the same rows, each adding its
spans, so the item table may be of any size.

Defined results: null or wordless texts have no words, no hits and are clean;
an item without words is never matched; a null item id is written "null";
repeated items count once per id; repeated documents are judged each.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ALNUM, map_rows, sha256, utf8

WINDOW = 13
#: Characters of items in one shard, on average: what one broadcast and one automaton may hold.
SHARD_CHARS = 1_000_000
SPANS = "array<struct<start:int,end:int>>"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: maximal runs of ASCII letters, digits and everything beyond ASCII."""
    return utf8(text).translate(LOWER_ALNUM).split()


class Automaton:
    """Generalised suffix automaton of item word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        pairs = set()
        self.least = window
        for key, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            pairs.update(zip(ids, ids[1:], strict=False))
            last = 0
            for c in ids:
                last = self._extend(last, c)
            self.least = min(self.least, len(ids))
        # `_extend` may later split a state; walk the finished automaton to place the items.
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.whole: dict[int, set[str]] = {}
        for key, words in items:
            s = 0
            ids = [self.vocab[w] for w in words]
            for c in ids:
                s = self.next[s][c]
                if len(ids) >= window:
                    self.whole.setdefault(s, set()).add(key)
            if words and len(words) < window:
                self.short.setdefault(s, []).append((len(words), key))
        self.kids: list[list[int]] = [[] for _ in self.len]
        for s, p in enumerate(self.link):
            if p >= 0:
                self.kids[p].append(s)
        # Nearest state on the suffix path, itself included, at which a short item ends.
        self.stop = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.stop[s] = s if s in self.short else (self.stop[self.link[s]] if s else -1)
        self.base = len(self.vocab) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self._items: dict[int, frozenset[str]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def items_at(self, s: int) -> frozenset[str]:
        """Items that hold the window-long suffix of what is matched in state `s`."""
        while self.len[self.link[s]] >= self.window:
            s = self.link[s]
        if s not in self._items:
            found, todo = set(), [s]
            while todo:
                t = todo.pop()
                found |= self.whole.get(t, set())
                todo += self.kids[t]
            self._items[s] = frozenset(found)
        return self._items[s]

    def stream(self, ids: list[int], at: int, spans: list[list[int]], items: set[str]) -> None:
        """Follow the longest match over `ids`, whose first word is number `at`; collect covered words."""
        s = n = 0
        nxt, link, length, window, stop = self.next, self.link, self.len, self.window, self.stop
        for i, c in enumerate(ids, at):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            else:
                n = 0
            best = 0
            if n >= window:
                best = window
                items |= self.items_at(s)
            u = stop[s]
            while u > 0:
                for m, key in self.short[u]:
                    if m <= n:
                        items.add(key)
                        best = max(best, m)
                u = stop[link[u]]
            if best:
                first = i + 1 - best
                while spans and spans[-1][1] >= first:      # merge with what overlaps or touches
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])

    def search(self, docs: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
        """Covered word spans and item ids of each document.

        Only stretches in which every pair of neighbours also occurs in an item
        can hold a window; the automaton reads those, the rest is skipped.
        """
        sizes = np.array([len(d) for d in docs], np.int64)
        out: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in docs]
        total = int(sizes.sum())
        if not total or not self.vocab:
            return out
        ids = np.fromiter(map(self.vocab.get, chain.from_iterable(docs), repeat(0)), np.int64, total)
        ends = np.cumsum(sizes)
        known = ids > 0
        joined = known[:-1] & known[1:]
        if self.least > 1:
            spot = np.flatnonzero(joined)
            code = ids[spot] * self.base + ids[spot + 1]
            k = np.searchsorted(self.pairs, code)
            k[k == len(self.pairs)] = 0
            joined[spot] = self.pairs[k] == code if len(self.pairs) else False
        borders = ends[:-1]
        joined[borders[(borders > 0) & (borders < total)] - 1] = False
        start = np.flatnonzero(np.concatenate([[True], ~joined]))
        stop = np.append(start[1:], total)
        keep = (stop - start >= self.least) & known[start]
        start, stop = start[keep], stop[keep]
        doc = np.searchsorted(ends, start, side="right")
        begin = ends - sizes
        for a, b, d in zip(start.tolist(), stop.tolist(), doc.tolist(), strict=True):
            self.stream(ids[a:b].tolist(), a - int(begin[d]), *out[d])
        return out


_BUILT: dict[str, Automaton] = {}


def _automaton(token: str, items: list[tuple[str, str]], window: int) -> Automaton:
    """The shard's automaton, built once per worker process; the last one is kept."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Automaton([(k, words_of(t)) for k, t in items], window)
    return _BUILT[token]


def cut(text: str, spans: list[list[int]], max_words: int, max_share: float) -> str:
    """The text without covered spans longer than `max_words`, or without any if their share is too large."""
    if not spans:
        return text
    marks = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    covered = sum(b - a for a, b in spans)
    drop = spans if covered >= max_share * len(marks) else [s for s in spans if s[1] - s[0] > max_words]
    out, at = [], 0
    for a, b in drop:
        out.append(text[at:marks[a][0]])
        at = marks[b - 1][1]
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, max_words: int = 50, max_share: float = 0.05,
               shard_chars: int = SHARD_CHARS, clean: bool = False) -> DataFrame:
    """`carry` columns with n_words, spans (word offsets), items (sorted ids) and, if asked, clean_text."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("k"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    items = items.withColumn("s", F.pmod(F.xxhash64("k", "t"), F.lit(shards)))
    results = {"n_words": "long", "spans": SPANS, "items": "array<string>"}
    keep = [c for c in carry if c not in results and c != "clean_text"]
    out = docs
    for k in range(shards):
        rows = [(r.k, r.t) for r in items.where(F.col("s") == k).sort("k", "t").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        token = sha256(repr((window, rows)))
        last = k == shards - 1

        def make(shared=shared, token=token, first=k == 0, last=last):
            sam = _automaton(token, shared.value, window)

            def run(v: dict) -> list:
                words = [words_of(t) for t in v[text]]
                n, spans, found, texts = [], [], [], []
                for i, (w, (got, ids)) in enumerate(zip(words, sam.search(words), strict=True)):
                    if not first:
                        ids |= set(v["items"][i])
                        got = _merge(got + [[s["start"], s["end"]] for s in v["spans"][i]])
                    n.append(len(w))
                    spans.append([{"start": a, "end": b} for a, b in got])
                    found.append(sorted(ids))
                    if clean and last:
                        texts.append(cut(v[text][i], got, max_words, max_share))
                return [n, spans, found, *([texts] if clean and last else [])]

            return run

        before = [] if k == 0 else ["spans", "items"]
        out = map_rows(out, make, [text, *before], list(dict.fromkeys(keep + ([] if last else [text]))),
                       results | ({"clean_text": "string"} if clean and last else {}), text)
    return out


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def judged(spans: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: at least a twentieth of the words are covered."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return spans.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with its words, hits, items and verdict."""
    return judged(find_spans(docs, benchmark, ["doc_id"])).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
