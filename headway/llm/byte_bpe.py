"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation is a small automaton over codepoint classes. Each class is a
function from state to state; the functions form a finite monoid, so the state
before every character is an associative scan over ids of its elements, done
for all texts of a slice at once. Token starts follow from the state, the class
and one character of look-ahead. The slices of bytes between starts go through
a cache of merged pieces; end offsets stay with the ids, so any id range can be
cut out of, or decoded back to, the bytes of its text.

Defined results: null and empty texts have no ids; repeated rows are encoded
each; a piece of any length is merged in O(n log n).
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, sha256

# Codepoint classes: letter, number, other, space, other white space, apostrophe before one
# or two letters of a contraction, border between texts.
LETTER, NUMBER, OTHER, SPACE, WHITE, SHORT1, SHORT2, BORDER = range(8)
# States: nothing open, in letters, in numbers, in others, after a space, after other white
# space, one or two letters of a contraction to come.
FREE, IN_L, IN_N, IN_O, AFTER_S, AFTER_W, LEFT1, LEFT2 = range(8)

# Code points with the White_Space property, letters of contractions.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

#: Distinct pieces in each of the two generations of the cache, some 250 bytes each, and bytes of text taken at a time.
CACHE_PIECES, SLICE = 120_000, 500_000
BLOCK = 256


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE_SPACE] = WHITE
    t[32] = SPACE
    return t


def _step(state: int, symbol: int) -> int:
    if symbol == BORDER:
        return FREE
    if symbol == LETTER:
        return {LEFT1: FREE, LEFT2: LEFT1}.get(state, IN_L)
    if symbol in (SHORT1, SHORT2):
        if state in (IN_O, AFTER_S):
            return IN_O
        return LEFT1 if symbol == SHORT1 else LEFT2
    return {NUMBER: IN_N, OTHER: IN_O, SPACE: AFTER_S, WHITE: AFTER_W}[symbol]


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray]:
    """(effect, product): effect[e, s] is the state e leads to from s, product[a, b] is a, then b.

    Elements 0 to 7 are the classes, 8 is the identity.
    """
    found = [tuple(_step(s, c) for s in range(8)) for c in range(8)] + [tuple(range(8))]
    index = {}
    for i, f in enumerate(found):
        index.setdefault(f, i)
    i = 0
    while i < len(found):
        for g in found[:8]:
            f = tuple(g[s] for s in found[i])
            if f not in index:
                index[f] = len(found)
                found.append(f)
        i += 1
    product = np.array([[index[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
    return np.array(found, np.uint8), product


def scan(symbols: np.ndarray) -> np.ndarray:
    """State before every position, by a blocked associative scan over monoid elements."""
    effect, product = monoid()
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    rows = -(-n // BLOCK)
    e = np.full(rows * BLOCK, 8, np.uint16)
    e[:n] = symbols
    e = np.ascontiguousarray(e.reshape(rows, BLOCK).T)      # one row per place in the block
    for j in range(1, BLOCK):                               # all blocks advance together
        e[j] = product[e[j - 1], e[j]]
    start = np.full(rows, FREE, np.uint8)
    if rows > 1:
        totals = e[-1]
        if rows <= BLOCK:
            s = FREE
            for k in range(1, rows):
                s = effect[totals[k - 1], s]
                start[k] = s
        else:
            start = _scan_elements(totals)
    out = np.empty((BLOCK, rows), np.uint8)
    out[0] = start
    out[1:] = effect[e[:-1], start[None, :]]
    return out.T.reshape(-1)[:n]


def _scan_elements(e: np.ndarray) -> np.ndarray:
    """State before each of some elements, which are block totals: the same scan one level up."""
    effect, product = monoid()
    n, rows = len(e), -(-len(e) // BLOCK)
    x = np.full(rows * BLOCK, 8, np.uint16)
    x[:n] = e
    x = np.ascontiguousarray(x.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        x[j] = product[x[j - 1], x[j]]
    start = np.full(rows, FREE, np.uint8)
    s = FREE
    for k in range(1, rows):
        s = effect[x[-1][k - 1], s]
        start[k] = s
    out = np.empty((BLOCK, rows), np.uint8)
    out[0] = start
    out[1:] = effect[x[:-1], start[None, :]]
    return out.T.reshape(-1)[:n]


@lru_cache(1)
def start_table() -> np.ndarray:
    """start[state, class, more]: whether a token begins here; `more`: the next character continues
    a run of white space or the text ends."""
    t = np.zeros((8, 8, 2), bool)
    for s in range(8):
        t[s, LETTER] = s not in (IN_L, LEFT1, LEFT2, AFTER_S)
        t[s, NUMBER] = s not in (IN_N, AFTER_S)
        for c in (OTHER, SHORT1, SHORT2):
            t[s, c] = s not in (IN_O, AFTER_S)
        for c in (SPACE, WHITE):
            t[s, c, 1] = s not in (AFTER_S, AFTER_W)
            t[s, c, 0] = True           # the last white space before a visible character stands alone
        t[s, BORDER] = True
    return t


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, piece starts, piece ends, number of pieces of each text)."""
    joined = "\0".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    cls = class_table()[code]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    borders = np.cumsum(sizes) - 1
    mark = np.flatnonzero(code == 39)
    if len(mark):
        pad = np.concatenate([code, np.zeros(2, np.uint32)])
        a, b = pad[mark + 1], pad[mark + 2]
        cls[mark[np.isin(a, [ord(c) for c in ONE_LETTER])]] = SHORT1
        two = np.zeros(len(mark), bool)
        for x, y in TWO_LETTERS:
            two |= (a == ord(x)) & (b == ord(y))
        cls[mark[two]] = SHORT2
    cls[borders] = BORDER
    state = scan(cls)
    white = (cls == SPACE) | (cls == WHITE) | (cls == BORDER)
    more = np.ones(len(cls), np.uint8)
    more[:-1] = white[1:]
    starts = np.flatnonzero(start_table()[state, cls, more])
    at = np.zeros(len(code) + 1, np.int64)
    np.cumsum(1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000), out=at[1:])
    ends = np.append(starts[1:], len(code))
    real = cls[starts] != BORDER
    owner = np.searchsorted(borders, starts[real])
    return joined.encode("utf-8", "replace"), at[starts[real]], at[ends[real]], np.bincount(owner, minlength=len(texts))


class Merger:
    """Merges the bytes of a piece by rank, lowest first, leftmost among equals, with a cache."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.length = np.zeros(max(self.bytes_of) + 1, np.int32)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self.pairs: dict[tuple[int, int], int] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self.decimal = [str(i) for i in range(len(self.length))]
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        if len(ids) > 200:
            return self._merge_long(ids)
        get, none = self.pairs.get, 1 << 30
        rank = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while rank:
            best = min(rank)
            if best == none:
                break
            i = rank.index(best)
            ids[i:i + 2] = [best]
            del rank[i]
            if i < len(rank):
                rank[i] = get((best, ids[i + 1]), none)
            if i:
                rank[i - 1] = get((ids[i - 1], best), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list."""
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))
                if (r := self.pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n and (q := self.pairs.get((ids[k], ids[nxt[k]]))) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[nxt[k]]))
        return [i for i in ids if i >= 0]

    def pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        out = list(map(cache.get, pieces))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    p = pieces[i]
                    if (x := cache.get(p)) is None:
                        x = older.get(p) or tuple(self.merge(p))
                        if len(p) <= 64:
                            cache[p] = x
                    out[i] = x
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        data, starts, ends, counts = split(texts)
        merged = self.pieces([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        edges = [0, *np.cumsum(counts).tolist()]
        return [list(chain.from_iterable(merged[a:b])) for a, b in zip(edges, edges[1:], strict=False)]

    def written(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))


@lru_cache(2)
def merger(path: str) -> Merger:
    """One merger per task and vocabulary: a worker process outlives its tasks, so they forget it in the end."""
    return Merger(path)


def encode(docs: DataFrame, path: str, carry: list[str], text: str = "text") -> DataFrame:
    """`carry` columns with n_tokens, ids and the end of each token in bytes of the text."""
    def make():
        m = merger(path)

        def run(v: dict) -> list:
            ids = m.encode(v[text])
            ends = [np.cumsum(m.length[d]).astype(np.int32) for d in ids]
            return [[len(d) for d in ids], pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
        run.done = merger.cache_clear
        return run

    return map_rows(docs, make, [text], carry, {"n_tokens": "long", "ids": "array<int>", "ends": "array<int>"}, text, SLICE)


def decode(encoded: DataFrame, path: str, carry: list[str]) -> DataFrame:
    """`carry` columns with the text that the column `ids` stands for; incomplete characters become U+FFFD."""
    ddl = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry), "text string"])

    def run(batches):
        m = merger(path)
        for b in batches:
            texts = [None if i is None else m.decode(i).decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string())], [*carry, "text"])

    return encoded.select(*carry, "ids").mapInArrow(run, ddl)


def op6_byte_bpe(docs: DataFrame, path: str) -> DataFrame:
    """One row per document with its token count, the digest of the ids and of the bytes they decode to."""
    def make():
        m = merger(path)

        def run(v: dict) -> list:
            n, ids, back = [], [], []
            for d in m.encode(v["text"]):
                n.append(len(d))
                ids.append(sha256(m.written(d)))
                back.append(sha256(m.decode(d)))
            return [n, ids, back]
        run.done = merger.cache_clear
        return run

    return map_rows(docs, make, ["text"], ["doc_id"],
                    {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, size=SLICE)
