"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens; a full piece is a
sequence by itself, the others are packed. Pieces are dealt by hash into blocks
of about BLOCK; a block is packed by several islands, each with a population of
groupings. Crossover injects whole well-filled bins of one parent into the
other, removes the bins that hold duplicates of their pieces and best-fits what
is displaced; mutation dissolves the emptiest bins. After every round the elite
of an island moves to its neighbour. A block whose best grouping has no more
bins than its tokens need is settled and evolves no further.

A block leaves less than a bin of waste if all goes well, so the loosest bins
of all blocks are dissolved and packed again, in fewer blocks, level by level
until one block is left. Each level holds a small fraction of the pieces of the
one before. Only piece numbers and lengths travel; every random choice comes
from the block, island and round, so a repeated task repeats its result.

Defined results: a null or empty text is one piece with the end id alone; null
and repeated ids and repeated rows are pieces of their own; an empty table has
no sequences.
"""

from __future__ import annotations

import gc
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save_table
from .common import release, slices

CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Distinct parts of words whose ids a task keeps, and bytes of text taken at a time.
CACHE_PARTS, SLICE = 500_000, 6_000_000
#: New words encoded behind one another.
GROUP = 500
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces per block, islands per block, rounds between which elites move.
BLOCK, ISLANDS, ROUNDS = 2048, 2, 2
#: Groupings per island, children per round, share of the bins that a crossover injects at most.
POPULATION, CHILDREN, INJECTED = 4, 12, 0.1
#: Least fill of a bin worth injecting, and the emptiest bins that a mutation or the next level dissolves.
WELL_FILLED, LOOSE = 0.999, 8


@lru_cache(1)
def _tokenizer(path: str):
    """The tokenizer, and for each id whether it ends a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True
    return t, ends


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.append(x, np.zeros(max(n - len(x), len(x)), x.dtype))


class WordIds:
    """Ids of whole texts from the ids of the parts of their words.

    The vocabulary drops white space and merges within words only, so each
    distinct word between ASCII spaces is looked up once a slice. Of a word of
    Latin letters with punctuation behind it the letters, in lower case, and the
    punctuation are encoded apart; any other word is one part.
    """

    def __init__(self, path: str):
        tokenizer, self.ends = _tokenizer(path)
        self.encode_batch = tokenizer.encode_batch_fast
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[str, int] = {"": 0}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)      # ids of each part
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _put(self, parts: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """New parts with their ids, one behind another."""
        first, n = len(self.parts), len(self.parts) + len(parts)
        self.start, self.size = (_room(x, n) for x in (self.start, self.size))
        self.start[first:n], self.size[first:n] = self.used + np.cumsum(size) - size, size
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.parts.update(zip(parts, range(first, n), strict=True))

    def _runs(self, letters: list[str]) -> None:
        """Encodes runs of letters, GROUP at a time behind one another: the last id of each ends a word."""
        groups = [letters[i:i + GROUP] for i in range(0, len(letters), GROUP)]
        for g, e in zip(groups, self.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            flat = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[flat])
            if len(last) == len(g):
                self._put(g, flat, np.diff(last, prepend=-1))

    def _numbers(self, parts: pa.Array, runs: bool) -> np.ndarray:
        """The number of each part; new ones are encoded."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self.parts
        fresh = [p for p in names if p not in known]
        if runs and (letters := [p for p in fresh if p.isalpha() and max(p) < "\u0100"]):
            self._runs(letters)
            fresh = [p for p in fresh if p not in known]
        if fresh:
            got = [e.ids for e in self.encode_batch(fresh, add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            self._put(fresh, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size)
        numbers = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        return numbers[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END; ids of each text with it)."""
        if len(self.parts) > CACHE_PARTS:
            self._clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        head = pc.utf8_rtrim(words, PUNCTUATION)
        latin = pc.and_(pc.utf8_is_alpha(head), pc.invert(pc.match_substring_regex(words, "[^\\x00-\\xFF]")))
        behind = pc.subtract(pc.utf8_length(words), pc.utf8_length(head)).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(latin.to_numpy(zero_copy_only=False) & (behind > 0))
        tails = np.zeros(len(words), np.int64)
        if len(cut):
            tails[cut] = self._numbers(pa.array([w[-n:] for w, n in zip(words.take(pa.array(cut)).to_pylist(), behind[cut].tolist(), strict=True)]), False)
        heads = self._numbers(pc.if_else(latin, pc.utf8_lower(head), words), True)
        part = np.stack([heads, tails])[:, coded.indices.to_numpy()].T.ravel()          # head, tail, head, tail, …
        size = self.size[part]
        edge = np.append(0, np.cumsum(size))
        last = 2 * np.cumsum(split.value_lengths().to_numpy())
        counts = np.diff(edge[last], prepend=0) + 1
        out = np.full(int(counts.sum()), END, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = self.ids[np.repeat(self.start[part] - edge[:-1], size) + np.arange(int(size.sum()))]
        return out, counts


def cut_pieces(docs: DataFrame, path: str, carry: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """`carry` columns, piece, start, length and ids_crc32 of every piece of every document."""
    results = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    carry = [c for c in carry if c not in results]
    src = docs.select(*dict.fromkeys([*carry, text]))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"{k} {v}" for k, v in results.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()        # nothing here makes cycles, and the caches are large; `release` turns it on again
        encoder = WordIds(path)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, counts = encoder.encode(part.column(text))
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, counts[row] - number * capacity)
                at = (np.cumsum(length) - length).tolist()
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(row)) for c in carry), pa.array(number, pa.int32()),
                     pa.array(number * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [*carry, *results])
        del encoder
        release(run)

    return src.mapInArrow(run, ddl)


# --- groupings of one block -----------------------------------------------------------


def best_fit(sizes: list[int], items: list[int], bin_of: np.ndarray, free: list[int], capacity: int) -> None:
    """Puts items, in order, each into the fullest bin with room, or a new one; `free` is the room of each bin."""
    span = 1 << 32
    room = sorted(f * span + b for b, f in enumerate(free))
    for i in items:
        s = sizes[i]
        k = bisect_left(room, s * span)
        if k < len(room):
            f, b = divmod(room.pop(k), span)
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        free[b] = f - s
        bin_of[i] = b
        insort(room, (f - s) * span + b)


def _rebuilt(sizes: np.ndarray, group: np.ndarray, keep: np.ndarray, items: np.ndarray, capacity: int) -> np.ndarray:
    """The groups marked `keep` (by group number), renumbered, with `items` best-fitted around them."""
    number = np.cumsum(keep) - 1
    bin_of = np.where(keep[group], number[group], -1)
    stay = bin_of >= 0
    free = (capacity - np.bincount(bin_of[stay], weights=sizes[stay], minlength=int(keep.sum()))).astype(np.int64).tolist()
    best_fit(sizes.tolist(), items.tolist(), bin_of, free, capacity)
    return bin_of


def crossover(rng: np.random.Generator, sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int) -> np.ndarray:
    """A child of `mother` that holds some whole well-filled bins of `father`.

    Bins of the mother with a piece of an injected bin go; their other pieces
    are best-fitted, largest first.
    """
    fill = np.bincount(father, weights=sizes)
    well = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(well):
        return mutate(rng, sizes, mother, capacity)
    chosen = rng.choice(well, int(rng.integers(1, max(2, int(INJECTED * len(fill))))), replace=True)
    injected = np.isin(father, chosen)
    bins = int(mother.max()) + 1
    keep = np.ones(bins + int(father.max()) + 1, bool)
    keep[mother[injected]] = False
    keep[bins:] = False
    keep[bins + chosen] = True
    group = np.where(injected, bins + father, mother)
    displaced = np.flatnonzero(~keep[group])
    return _rebuilt(sizes, group, keep, displaced, capacity)


def mutate(rng: np.random.Generator, sizes: np.ndarray, group: np.ndarray, capacity: int) -> np.ndarray:
    """Dissolves the emptiest bins and as many others; their pieces come back in a slightly shuffled order."""
    fill = np.bincount(group, weights=sizes)
    gone = np.union1d(np.argsort(fill, kind="stable")[:LOOSE], rng.integers(0, len(fill), LOOSE))
    keep = np.ones(len(fill), bool)
    keep[gone] = False
    items = np.flatnonzero(~keep[group])
    items = items[np.argsort(-sizes[items] * rng.uniform(0.8, 1.2, len(items)), kind="stable")]
    return _rebuilt(sizes, group, keep, items, capacity)


def cost(sizes: np.ndarray, group: np.ndarray) -> tuple[int, float]:
    """Bins, then how evenly they are filled: of two groupings with as many bins the one with fuller bins is better."""
    fill = np.bincount(group, weights=sizes)
    return len(fill), -float((fill * fill).sum())


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: list[int], capacity: int) -> list[np.ndarray]:
    """One round of an island: the best groupings, best first. Sizes are in descending order."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    if not population:
        first = np.zeros(len(sizes), np.int64)
        best_fit(sizes.tolist(), list(range(len(sizes))), first, [], capacity)
        population = [first]
        if cost(sizes, first)[0] > least:
            population += [mutate(rng, sizes, first, capacity) for _ in range(POPULATION - 1)]
    ranked = sorted(((cost(sizes, g), k, g) for k, g in enumerate(population)), key=lambda x: x[:2])
    for k in range(CHILDREN):
        if ranked[0][0][0] <= least:
            break
        i, j = (int(x) for x in rng.integers(0, len(ranked), 2))
        child = mutate(rng, sizes, ranked[i][2], capacity) if i == j else crossover(rng, sizes, ranked[i][2], ranked[j][2], capacity)
        ranked.append((cost(sizes, child), len(population) + k, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[:POPULATION]
    return [g for _, _, g in ranked]


# --- islands ---------------------------------------------------------------------------

_STATE = "block long, island int, keys array<long>, sizes array<int>, population array<array<int>>, settled boolean"


def _round(state: DataFrame, number: int, level: int, capacity: int) -> DataFrame:
    """Every island evolves on; settled blocks pass as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                sizes = np.array(r["sizes"], np.int64)
                groups = [np.array(g, np.int64) for g in r["population"]]
                if not r["settled"]:
                    groups = evolve(sizes, groups, [level, r["block"], r["island"], number], capacity)
                settled = int(groups[0].max()) + 1 <= -(-int(sizes.sum()) // capacity)
                row = [r["block"], r["island"], r["keys"], r["sizes"], [g.tolist() for g in groups[:1 if settled else None]], settled]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(row, (
                        pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.bool_()),
                        strict=True)], ["block", "island", "keys", "sizes", "population", "settled"])

    return state.mapInArrow(run, _STATE)


def _migrated(state: DataFrame) -> DataFrame:
    """Every island gets the elite of its neighbour; one island goes on for a settled block."""
    elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("population", F.lit(0)).alias("guest"))
    done = state.groupBy("block").agg(F.min(F.when(F.col("settled"), F.col("island"))).alias("winner"))
    with_guest = state.join(elite, ["block", "island"], "left").join(done, "block")
    return with_guest.where(F.col("winner").isNull() | (F.col("winner") == F.col("island"))).withColumn(
        "population", F.when(F.col("guest").isNull() | F.col("winner").isNotNull(), F.col("population")).otherwise(
            F.concat(F.array("guest"), "population"))).drop("guest", "winner")


def _packed(items: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """block, bin and key of every item (key, length), packed by blocks."""
    spark = items.sparkSession
    tasks = max(1, min(blocks * ISLANDS, max(4 * spark.sparkContext.defaultParallelism, blocks // 16)))
    ordered = F.sort_array(F.collect_list(F.struct("length", "key")), asc=False)
    # A block is bounded: keys are unique and dealt by hash.
    state = items.groupBy(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks)).alias("block")).agg(ordered.alias("x")).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.key").alias("keys"),
        F.col("x.length").cast("array<int>").alias("sizes"), F.array().cast("array<array<int>>").alias("population"),
        F.lit(False).alias("settled"))
    for k in range(ROUNDS):
        if k:
            state = _migrated(state)
        # Few bytes but much work: the number of tasks is set.
        state = save_table(_round(state.repartition(tasks, "block", "island"), k, level, capacity), "packing-islands")
        if not state.where(~F.col("settled")).limit(1).count():
            break
    best = state.groupBy("block").agg(F.min_by(F.struct("keys", "sizes", F.get("population", F.lit(0)).alias("group")), F.struct(
        F.array_max(F.get("population", F.lit(0))), "island")).alias("b"))
    return best.select("block", F.explode(F.arrays_zip("b.keys", "b.sizes", "b.group")).alias("i")).select(
        "block", F.col("i.group").alias("bin"), F.col("i.keys").alias("key"), F.col("i.sizes").cast("long").alias("length"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """key, sequence_id and offset of every item (unique key, length up to `capacity`)."""
    items = items.select("key", "length")
    done = [items.where(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items = items.where(F.col("length") < capacity)
    level = 0
    while (n := items.count()) > 0:
        blocks = -(-n // BLOCK)
        packed = save_table(_packed(items, blocks, level, capacity), "packing-level")
        bins = packed.groupBy("block", "bin").agg(
            F.sum("length").alias("fill"), F.min("key").alias("sequence_id"), F.sort_array(F.collect_list(F.struct("key", "length"))).alias("x"))
        loose = None
        if blocks > 1:      # bins per block are few, so this window is small
            rank = F.row_number().over(Window.partitionBy("block").orderBy("fill", "bin"))
            bins = save_table(bins.withColumn("loose", rank <= LOOSE), "packing-bins")
            loose = bins.where("loose").select(F.inline("x"))
            bins = bins.where(~F.col("loose"))
        before = F.aggregate(F.slice("x", 1, F.col("i")), F.lit(0).cast("long"), lambda a, s: a + s["length"])
        done.append(bins.select("sequence_id", "x", F.posexplode("x").alias("i", "item")).select(
            F.col("item.key").alias("key"), "sequence_id", before.alias("offset")))
        if loose is None:
            break
        items = save_table(loose, "packing-loose")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str, carry: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """`carry` columns, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    pieces = cut_pieces(docs, path, carry, text, capacity)
    pieces = save_table(pieces.withColumn("__key", F.monotonically_increasing_id()), "packing-pieces")
    placed = pack(pieces.select(F.col("__key").alias("key"), "length"), capacity).withColumnRenamed("key", "__key")
    keep = [c for c in pieces.columns if c not in ("__key", "sequence_id", "offset")]
    return pieces.select("__key", *keep).join(placed, "__key").select(*keep, "sequence_id", "offset")


def op11_packing(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return pack_documents(docs, path, ["doc_id"])
