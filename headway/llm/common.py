"""Shared helpers: whole texts through Arrow in bounded slices, digests, word hashes.

Every operator reads only the columns it names. A null text is an empty text,
a null id is kept as it is, repeated rows are separate rows, and where an
input column has the name of a result column the result replaces it.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text held as Python objects or numpy arrays at a time (a longer text stands alone).
SLICE_CHARS = 2_000_000

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<tinyint>": pa.list_(pa.int8()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
}

#: A-Z to a-z, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As LOWER; ASCII other than letters and digits become spaces.
LOWER_ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates, which Spark cannot hold either, become '?'."""
    return text.encode("utf-8", "replace")


def sha256(data: bytes | str) -> str:
    """Lowercase hex digest."""
    return hashlib.sha256(data if isinstance(data, bytes) else utf8(data)).hexdigest()


def slices(batch: pa.RecordBatch, column: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `size` (SLICE_CHARS) bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // (size or SLICE_CHARS), prepend=0)) if len(sizes) else []
    edges = [0, *(int(c) for c in cut if c), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def release(fn: Callable) -> None:
    """What a task leaves in its reused worker process: caches go (`fn.done`), freed memory returns to the system."""
    if done := getattr(fn, "done", None):
        done()
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # glibc keeps what numpy has freed
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list]], read_cols: list[str], carry: list[str],
             results: dict[str, str], text: str = "text", size: int | None = None) -> DataFrame:
    """Add columns computed by Python, a bounded slice of rows (`size` bytes of text) at a time, without a shuffle.

    `make()` runs once per task and returns a function from {column: list} to one
    list (or Arrow array) per result column; an attribute `done` of it is called at the end.
    """
    carry = [c for c in carry if c not in results]
    cols = list(dict.fromkeys([*carry, *read_cols]))
    src = df.select(*cols)
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"`{k}` {v}" for k, v in results.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, text, size):
                values = {c: part.column(c).to_pylist() for c in read_cols}
                values[text] = ["" if t is None else t for t in values[text]]
                out = [v if isinstance(v, pa.Array) else pa.array(v, ARROW[t])
                       for v, t in zip(fn(values), results.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *out], [*carry, *results])
        release(fn)

    return src.mapInArrow(run, ddl)


def explode_rows(df: DataFrame, make: Callable[[], Callable[[dict], list]], read_cols: list[str],
                 results: dict[str, str], text: str = "text") -> DataFrame:
    """Like `map_rows`, for functions that return any number of rows as equally long columns."""
    ddl = ", ".join(f"`{k}` {v}" for k, v in results.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, text):
                values = {c: part.column(c).to_pylist() for c in read_cols}
                values[text] = ["" if t is None else t for t in values[text]]
                out = [v if isinstance(v, pa.Array) else pa.array(v, ARROW[t])
                       for v, t in zip(fn(values), results.values(), strict=True)]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays(out, list(results))
        release(fn)

    return df.select(*dict.fromkeys(read_cols)).mapInArrow(run, ddl)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A fixed 64-bit hash of each word, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    a = np.empty(len(words), dtype=object)
    a[:] = words
    return pd.util.hash_array(a, categorize=False)


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = (out ^ h[j:j + m]) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        out ^= out >> np.uint64(29)
    return mix(out)
