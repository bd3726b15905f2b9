"""N-gram Jaccard join with token-combination prefixes, exact at the given threshold.

Tokens are 64-bit hashes of word shingles, ordered by value. Two sets with a
Jaccard similarity of at least t differ from each other in at most n - tn of
the n tokens of either, so their prefixes of n - tn + l tokens share l tokens
or more (l of the smaller set). That allows, without losing a pair:

* a document is a candidate only if l tokens of its prefix occur elsewhere;
* rare tokens are indexed alone; frequent ones only as pairs of two tokens of
  the same hash group, with fewer groups than l, so that l shared frequent
  tokens always put two of them into one group.

Equal sets fold to one set first. Documents that share an entry of the index
are verified against one hub of that entry, never pairwise; only what is then
in different components yet shares an entry is compared pair by pair.

Defined results: texts without words have an empty set, no links and
themselves as component; fewer words than a shingle form one token; repeated
rows are copies of each other; a null id never names a component unless all
its members have null ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.streets import components
from ..session import release_shuffles, save_table
from .common import LOWER, gram_hashes, map_rows, mix, utf8, word_hashes

SHINGLE = 5
#: Documents per token beyond which it counts as frequent.
FREQUENT = 64
#: Extra shared tokens that the extended prefix asks for: one per SMALL of a small set, beyond BASE one per LARGE.
SMALL, BASE, LARGE = 6, 8, 25
#: Rows of two numbers up to which the documents to drop, or those whose sets are compared, are broadcast.
BROADCAST_ROWS = 1_000_000
#: Rounds in which candidates without enough shared tokens among candidates are dropped.
PRUNINGS = 2
#: Members of a hub per block: beyond it the pairs of a hub are dealt out by pairs of blocks.
BLOCK = 2048
#: Buckets of the two histograms that are compared before whole sets are.
BUCKETS, FINE = 64, 256


def shingle_sets(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [utf8(t).translate(LOWER).split() for t in texts]
    flat = word_hashes([w for d in words for w in d])
    grams = gram_hashes(flat, k)
    out, at = [], 0
    for d in words:
        n = len(d)
        if n >= k:
            out.append(np.unique(grams[at:at + n - k + 1]))
        else:
            out.append(gram_hashes(flat[at:at + n], n, n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def text_hash(text: str) -> Column:
    """Hash of a text; null is an empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def extra(n):
    """Tokens that the extended prefixes of two sets are sure to share; `n` is the smaller size."""
    return 1 + min(n // SMALL, BASE + n // LARGE)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of the extended prefix of a set of n."""
    return n - -(-percent * n // 100) + extra(n)


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set; equal sets have equal ids."""
    x = mix(np.array([len(s)], np.uint64)) + mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(x).view(np.int64)[0])


def folded(docs: DataFrame, percent: int, k: int, text: str = "text") -> DataFrame:
    """doc_id, h, sid and n of each document, and the extended prefix of its set.

    The only pass over all texts. Sets met again in a task leave the prefix out.
    """
    def make():
        seen: set[int] = set()

        def run(v: dict) -> list:
            sids, sizes, prefixes = [], [], []
            for s in shingle_sets(v[text], k):
                i = set_id(s)
                new = len(s) and i not in seen
                if new:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(i)
                sids.append(i)
                sizes.append(len(s))
                prefixes.append(s[:prefix_length(len(s), percent)].view(np.int64) if new else None)
            return [sids, sizes, prefixes]
        return run

    return map_rows(docs, make, [text], ["doc_id", "h"], {"sid": "long", "n": "int", "prefix": "array<long>"}, text)


def groups_of(n: int) -> int:
    """Hash groups for frequent tokens of a set of n: a power of two below `extra(n)`, 0 for single tokens."""
    return 0 if extra(n) < 2 else 1 << ((extra(n) - 1).bit_length() - 1)


def entries(rare: list[int], frequent: list[int], n: int, percent: int) -> list[int]:
    """Index entries of a candidate: rare tokens, and pairs of frequent tokens of a group.

    A partner may have any size that the threshold allows, so the pairs are
    formed for the group count of the set's own size and of the least partner's.
    """
    out = list(rare)
    f = np.sort(np.array(frequent, np.int64)).view(np.uint64)
    for g in {groups_of(n), groups_of(-(-percent * n // 100))}:
        if g == 0:
            out += f.view(np.int64).tolist()
            continue
        home = f & np.uint64(g - 1)
        for h in np.unique(home):
            t = f[home == h]
            a, b = np.triu_indices(len(t), 1)
            out += mix(mix(t[a] + np.uint64(g)) ^ t[b]).view(np.int64).tolist()
    return out


def _index(candidates: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500).to_pydict()
                keys, sids, sizes = [], [], []
                for sid, n, r, f in zip(part["sid"], part["n"], part["rare"], part["frequent"], strict=True):
                    e = entries(r, f, n, percent)
                    keys += e
                    sids += [sid] * len(e)
                    sizes += [n] * len(e)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32())],
                        ["key", "sid", "n"])

    return candidates.select("sid", "n", "rare", "frequent").mapInArrow(run, "key long, sid long, n int")


def _extra(n: Column) -> Column:
    """`extra` as a column."""
    return 1 + F.least(F.floor(n / SMALL), BASE + F.floor(n / LARGE))


def _least(percent: int) -> Column:
    """Prefix tokens that a set of n must share with any partner, the smallest included."""
    return _extra(F.ceil(F.col("n") * percent / 100))


def _band(percent: int) -> Column:
    """Sizes fall into bands as wide as the threshold allows: a partner's band is the own or a neighbour."""
    return F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("int")


def _pruned(candidates: DataFrame, percent: int) -> DataFrame:
    """Drops tokens that no other candidate of a possible size has, then candidates that keep too few."""
    rows = candidates.select("sid", "rep", "n", _band(percent).alias("band"), F.inline("shared"))
    seen = rows.groupBy("token", "band").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    near = seen.select("token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "lo", "hi")
    near = near.groupBy("token", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi")
    kept = rows.join(near.select("token", "band"), ["token", "band"], "left_semi")
    return kept.groupBy("sid", "rep", "n").agg(F.collect_list(F.struct("token", "often")).alias("shared")).where(
        F.size("shared") >= _least(percent))


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def histogram(s: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Tokens of a set by hash bucket, at most 127 each."""
    return np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 127).astype(np.int8)


def _close(x: Column, y: Column, n: Column, percent: int) -> Column:
    """Whether histograms still allow the similarity of sets that have n tokens together.

    Histograms differ by no more than the sets do, and with similarity t
    n(1 - t) / (1 + t) tokens are in one set only.
    """
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda a, d: a + d)
    return apart * (100 + percent) <= n * (100 - percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough; sets travel only for pairs with close histograms."""
    a = sets.select(F.col("sid").alias("u"), F.col("fine").alias("x"), F.size("tokens").alias("nx"))
    b = sets.select(F.col("sid").alias("v"), F.col("fine").alias("y"), F.size("tokens").alias("ny"))
    close = pairs.join(a, "u").join(b, "v").where(
        _close(F.col("x"), F.col("y"), F.col("nx") + F.col("ny"), percent)).select("u", "v")
    a = sets.select(F.col("sid").alias("u"), F.col("tokens").alias("x"))
    b = sets.select(F.col("sid").alias("v"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return close.join(a, "u").join(b, "v").where(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("u", "v")


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share a hub and may be similar, each once.

    `members`: hub, sid, n, hist, fine, component. Whatever shares an index entry
    shares its hub; a pair is met once per hub, not once per entry, and only
    with sizes and histograms that allow the similarity.
    """
    mixed = members.groupBy("hub").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where(
        "a != b").select("hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # Members fall into blocks by hash; a pair is met under the pair of its blocks, so a large hub becomes many join keys.
    rows = members.join(mixed, "hub").withColumn("band", _band(percent))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    left = rows.select("hub", "band", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"),
                       F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"),
                       F.col("hist").alias("x"), F.col("fine").alias("fx"))
    right = rows.select("hub", F.expr("sequence(0, block)").alias("is"), F.col("block").alias("j"),
                        F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("sid").alias("v"),
                        F.col("n").alias("nv"), F.col("component").alias("cv"), F.col("hist").alias("y"), F.col("fine").alias("fy"))
    right = right.withColumn("i", F.explode("is")).drop("is")
    once = (F.col("i") < F.col("j")) | (F.col("u") < F.col("v"))
    return left.join(right, ["hub", "band", "i", "j"]).where(
        (F.col("cu") != F.col("cv")) & once & _near_size(F.col("nu"), F.col("nv"), percent)
        & _close(F.col("x"), F.col("y"), F.col("nu") + F.col("nv"), percent)
        & _close(F.col("fx"), F.col("fy"), F.col("nu") + F.col("nv"), percent)).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_components(docs: DataFrame, percent: int = 80, k: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, group and component_id, the least doc_id reachable over links.

    `group` tells components apart even where ids repeat; it is null for an empty set.
    """
    docs = docs.select("doc_id", text, text_hash(text).alias("h"))
    fold = save_table(folded(docs, percent, k, text), "jaccard-sets")
    sets = fold.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    rows = fold.where("prefix is not null").select("sid", F.explode("prefix").alias("token"))

    # Tokens of at least two sets; the counts combine before the shuffle.
    live = rows.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("df"))
    live = live.where("lo != hi").select("token", (F.col("df") > FREQUENT).alias("often"))
    shared = rows.join(live, "token").groupBy("sid").agg(F.collect_set(F.struct("token", "often")).alias("shared"))
    candidates = save_table(shared.join(sets, "sid").where(F.size("shared") >= _least(percent)), "jaccard-candidates")
    for _ in range(PRUNINGS):
        candidates = save_table(_pruned(candidates, percent), "jaccard-candidates")
    release_shuffles(docs.sparkSession)      # all prefix tokens went through them

    def of(often: bool) -> Column:
        return F.transform(F.filter("shared", lambda x: x["often"] == often), lambda x: x["token"])

    candidates = candidates.select("sid", "rep", "n", of(False).alias("rare"), of(True).alias("frequent"))

    chosen = candidates.select("rep", "sid").distinct()
    if chosen.count() <= BROADCAST_ROWS:      # then texts need no shuffle
        chosen = F.broadcast(chosen)
    full = docs.drop("h").join(chosen, docs["doc_id"].eqNullSafe(chosen["rep"]))

    def tokens():
        def run(v: dict) -> list:
            found = shingle_sets(v[text], k)
            # An id may be repeated with another text; only the text the set came from counts.
            return [[i if set_id(s) == i else None for i, s in zip(v["sid"], found, strict=True)],
                    [s.view(np.int64) for s in found], [histogram(s) for s in found], [histogram(s, FINE) for s in found]]
        return run

    full = map_rows(full, tokens, [text, "sid"], [], {"sid": "long", "tokens": "array<long>", "hist": "array<tinyint>", "fine": "array<tinyint>"}, text)
    full = save_table(full.where("sid is not null"), "jaccard-tokens")

    index = _index(candidates, percent)
    hubs = index.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("hi"), F.min_by("n", "sid").alias("hub_n"))
    star = index.join(hubs.where("hub != hi"), "key").where("sid != hub").groupBy("hub", "sid").agg(
        F.count("*").alias("c"), F.max("n").alias("n"), F.max("hub_n").alias("hub_n"))
    star = save_table(star, "jaccard-hubs")

    # First every set against the hub it shares most entries with, then against its other hubs,
    # then whatever is still in different components but shares a hub.
    possible = star.where(_near_size(F.col("n"), F.col("hub_n"), percent)).select(
        F.col("hub").alias("u"), F.col("sid").alias("v"), "c")
    best = possible.groupBy("v").agg(F.max_by("u", F.struct("c", "u")).alias("u")).select("u", "v")
    links = save_table(verified(best, full, percent), "jaccard-links")
    nodes = candidates.select(F.col("sid").alias("node"))

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        a = label.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        b = label.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        return pairs.join(a, "u").join(b, "v").where("cu != cv").select("u", "v")

    label = save_table(components(links, nodes), "jaccard-components")
    rest = apart(possible.select("u", "v"), label).join(best, ["u", "v"], "left_anti")
    links = links.unionByName(save_table(verified(rest, full, percent), "jaccard-links"))
    label = save_table(components(links, nodes), "jaccard-components")

    members = star.select("hub", "sid", "n").unionByName(star.select("hub", F.col("hub").alias("sid"), F.col("hub_n").alias("n")).distinct())
    members = members.join(label.withColumnRenamed("node", "sid"), "sid").join(full.select("sid", "hist", "fine"), "sid")
    rest = across(members, percent).join(possible.select("u", "v"), ["u", "v"], "left_anti")
    links = links.unionByName(save_table(verified(rest, full, percent), "jaccard-links"))
    label = components(links, nodes)

    # Names of components: the least doc_id of any member's copies.
    name = sets.join(label.withColumnRenamed("node", "sid"), "sid").groupBy("component").agg(F.min("rep").alias("name"))
    names = label.join(name, "component").select(F.col("node").alias("sid"), F.col("component").alias("group"), "name")
    copies = sets.select("sid", "rep").join(names, "sid", "left").select(
        "sid", "rep", "name", F.coalesce("group", "sid").alias("group"))
    return fold.drop("prefix").join(copies, "sid", "left").select(
        "doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "group",
        F.coalesce("name", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, k: int = SHINGLE, text: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the document with the least id.

    A null id counts as the largest. Of texts with the same id in one component
    the one with the least hash stays, of repeated rows one; texts without words
    have no copies, so of them only repeated rows go. An id that names two unlike
    texts keeps both.
    """
    rows = save_table(similar_components(docs, percent, k, text).select("doc_id", "h", "group"), "jaccard-kept")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("h").alias("h")))
    named = rows.where("group is not null").groupBy("group").agg(first.alias("f")).select("f.id", "f.h")
    empty = rows.where("group is null").select(F.col("doc_id").alias("id"), "h").distinct()
    stay = named.unionByName(empty).select(F.col("id").alias("__id"), F.col("h").alias("__h"))
    every = rows.select("doc_id", "h").distinct()
    gone = every.join(stay, every["doc_id"].eqNullSafe(F.col("__id")) & (every["h"] == F.col("__h")), "left_anti")
    gone = save_table(gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")), "jaccard-gone")
    if gone.count() <= BROADCAST_ROWS:      # then texts need no shuffle
        gone = F.broadcast(gone)
    kept = docs.withColumn("__hash", text_hash(text))
    kept = kept.join(gone, kept["doc_id"].eqNullSafe(F.col("__id")) & (kept["__hash"] == F.col("__h")), "left_anti")
    # Repeated rows are rare; only where there are any are the texts shuffled once more.
    if rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__hash"])
    return kept.drop("__hash")


def op8_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document with the size of its set and its component."""
    return similar_components(docs).drop("h", "group")
