"""I-Match fingerprints in DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon. A
document's distinct lexicon terms, sorted, are hashed as a whole and once for
each of SUBSETS randomised lexicon subsets; the fingerprint is the list of
those hashes. Both ends of the band are shares of the documents, so the lexicon
has at most (mean distinct terms) / LEAST_SHARE terms, however large the corpus;
it travels as a constant hash table, looked up in constant time per term.

Defined results: null and empty texts, and texts without a lexicon term, have
the hash of the text itself in place of the whole and no subset hashes; repeated
rows are fingerprinted each; rows with a null doc_id come first in the order of
ids, equal ids in the order of their text hashes; a lone document follows itself.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of documents a lexicon term occurs in, at least and at most: inverse document frequencies of 3.0 to 6.9.
LEAST_SHARE, MOST_SHARE = 1 / 1000, 1 / 20
#: Randomised subsets, and the share of the lexicon in each.
SUBSETS, SUBSET_SHARE = 24, 48
#: Documents per bucket of neighbours, ranges of ids found by quantiles, buckets up to which their first rows are broadcast.
BUCKET_DOCS, MAX_RANGES, BROADCAST_BUCKETS = 4_096, 1_000, 100_000


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    words = F.split(F.lower(text), "[\\x00-/:-@\\[-`{-\\x7f]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[int]:
    """Hashes of the terms within the band, sorted."""
    n = docs.count()
    df = docs.select(F.explode(term_hashes(F.col(text))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = df.where(F.col("df").between(max(2, math.ceil(least * n)), max(2, math.floor(most * n))))
    return sorted(r.t for r in band.select("t").collect())


def lookup_table(terms: list[int]) -> tuple[Column, int]:
    """(constant array of slots, number of slots): a term is in the slot its low bits name."""
    size = 1 << max(4, len(terms).bit_length())
    slots: list[list[int]] = [[] for _ in range(size)]
    for t in terms:
        slots[t & (size - 1)].append(t)
    return F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>"), size


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, table: tuple[Column, int], subsets: int = SUBSETS, share: int = SUBSET_SHARE) -> Column:
    """Array of hashes: the whole, then one per subset, empty where a subset holds none of the terms."""
    slots, size = table
    kept = F.sort_array(F.filter(term_hashes(text), lambda t: F.array_contains(
        F.get(slots, t.bitwiseAND(F.lit(size - 1)).cast("int")), t)))

    def whole(k: Column) -> Column:
        return F.when(F.size(k) == 0, F.concat(F.lit("t"), F.substring(F.sha2(text, 256), 1, 16))).otherwise(
            F.lower(F.hex(F.xxhash64(k))))

    def homes(k: Column) -> Column:
        # A term's home among `share` places is its subset; the places beyond `subsets` stand for none.
        return F.filter(F.transform(k, lambda t: F.struct(t.alias("t"), F.pmod(F.xxhash64(t, F.lit(1)), F.lit(share)).alias("j"))),
                        lambda x: x["j"] < subsets)

    def part(p: Column) -> Column:
        return F.when(F.size(p) > 0, F.lower(F.hex(F.xxhash64(F.transform(p, lambda x: x["t"]))))).otherwise(F.lit(""))

    def parts(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda j: _let(F.filter(h, lambda x: x["j"] == j), part))

    return _let(kept, lambda k: F.concat(F.array(whole(k)), _let(homes(k), parts)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes among those that either has; 1 for equal fingerprints."""
    both = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 2, SUBSETS)
    same = F.size(F.filter(both, lambda x: (x["a"] == x["b"]) & (x["a"] != "")))
    some = F.size(F.filter(both, lambda x: (x["a"] != "") | (x["b"] != "")))
    return F.when(a == b, F.lit(1.0)).when(some == 0, F.lit(0.0)).otherwise(same / some)


def with_next(docs: DataFrame, columns: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row with `columns` of the next one by id as next_<column>; the last is followed by the first.

    Ids are cut into quantile ranges and these evenly into buckets of about
    BUCKET_DOCS rows, so texts are shuffled once, by bucket. The last row of a
    bucket takes the first row of the next bucket that has any.
    """
    docs = docs.withColumn("__k", F.coalesce(F.col(order), F.lit(-(1 << 63)).cast("long"))).withColumn("__h", F.xxhash64(text))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // BUCKET_DOCS))
    cuts = docs.agg(F.percentile_approx(
        "__k", [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first().c if ranges > 1 else []
    ends = docs.agg(F.min(order), F.max(order)).first() if n else (0, 0)
    low, high = ends[0] or 0, (ends[1] or 0) + 1
    edges = [low, *sorted(set(cuts or [])), high]
    per = max(1, n // (ranges * BUCKET_DOCS))
    q = F.size(F.filter(F.lit(edges[1:-1]).cast("array<bigint>") if len(edges) > 2 else F.array().cast("array<bigint>"),
                        lambda c: c <= F.col("__k")))
    start = F.get(F.lit(edges).cast("array<bigint>"), q)
    width = F.get(F.lit([max(1, b - a) for a, b in zip(edges, edges[1:], strict=False)]).cast("array<bigint>"), q)
    sub = F.least(F.greatest(F.floor((F.col("__k").cast("double") - start) * per / width), F.lit(0)), F.lit(per - 1))
    docs = docs.withColumn("__q", q).withColumn("__b", q.cast("long") * per + sub)

    firsts = docs.groupBy("__q", "__b").agg(F.min("__k").alias("__k"))
    in_range = Window.partitionBy("__q").orderBy("__b")
    over = Window.orderBy("__q")                                       # one row per range, MAX_RANGES at most
    heads = firsts.groupBy("__q").agg(F.min("__b").alias("head"))
    heads = heads.select("__q", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("beyond"))
    follow = firsts.withColumn("nb", F.lead("__b").over(in_range)).join(heads, "__q").select(
        F.col("__b").alias("before"), F.coalesce("nb", "beyond").alias("__b"))
    marks = firsts.select(F.col("__b").alias("fb"), F.col("__k").alias("fk"))
    if ranges * per <= BROADCAST_BUCKETS:
        marks = F.broadcast(marks)
    row = F.struct(*(F.col(c).alias(c) for c in columns))
    first_rows = docs.join(marks, (F.col("__b") == F.col("fb")) & (F.col("__k") == F.col("fk"))).groupBy("__b").agg(
        F.min_by(row, F.col("__h")).alias("beyond_row"))
    beyond = follow.join(first_rows, "__b").select(F.col("before").alias("__b"), "beyond_row")

    by_id = Window.partitionBy("__b").orderBy("__k", "__h")
    out = docs.select("*", F.lead(F.lit(True)).over(by_id).alias("__more"), *(
        F.lead(c).over(by_id).alias(f"__next_{c}") for c in columns)).join(beyond, "__b")
    return out.select(*(c for c in docs.columns if not c.startswith("__")), *(
        F.when(F.col("__more"), F.col(f"__next_{c}")).otherwise(F.col("beyond_row")[c]).alias(f"next_{c}") for c in columns))


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and both likenesses."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = lookup_table(lexicon(docs))
    rows = with_next(docs.withColumn("fp", fingerprint(F.col("text"), table)), ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = rows.withColumn("efp", fingerprint(F.col("edited"), table))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.array_join("fp", "-").alias("fingerprint"), F.array_join("efp", "-").alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
