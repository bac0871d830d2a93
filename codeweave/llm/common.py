"""Helpers the corpus operators share: Arrow buffers as numpy arrays, word hashes, keyed splits, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
PIECE = 1 << 18
#: Longer texts are no training rows of the classifiers, which bring whole texts of a bounded number of rows to the driver.
TRAINING_BYTES = 1 << 16

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * _MULT) | U64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 4096), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[str(base)] = have
    return have


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every row, and the rows' offsets in these."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last[:-1] &= ~ink[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lowered: a polynomial over random values of the bytes, finalized."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + PIECE))
        low = starts[i]
        piece = data[low : ends[j - 1]]
        value = _BYTE[LOWER[piece]] * _power(_BASE, len(piece))[: len(piece)]
        total = np.cumsum(value, dtype=U64)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e - 1] - total[s] + value[s]) * _power(_INVERSE, len(piece))[s] + (e - s).astype(U64)
        i = j
    return mix64(out)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; row borders are the caller's affair."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _MULT + words[j : n + j]
    return mix64(h)


def short_shingle(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer than k words."""
    h = U64(0x51ED270B + len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = h * _MULT + w
    return mix64(np.array([h], U64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; empty for a row without words."""
    starts, ends, at = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = shingles(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield short_shingle(words[a:b])
        else:
            yield np.zeros(0, U64)


#: What operators keep in a worker across tasks, by operator; the next other operator there drops it.
kept: dict[str, dict] = {}


def starts(operator: str) -> None:
    """Say which operator runs in this worker now: what others kept is dropped, so that their memory doesn't add up."""
    dropped = [name for name, cache in kept.items() if name != operator and cache]
    for name in dropped:
        kept[name].clear()
    if dropped:
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, and its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Tables written inside send at most ``rows`` rows of text to a worker at once; the session's setting is put back at the end.

    Without it a batch ends at the session's limit of bytes (64 MB by default).
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    before = conf.get(key)
    if not 0 < int(before) <= rows:
        conf.set(key, str(rows))
    try:
        yield
    finally:
        conf.set(key, before)


def in_small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that writes tables of its own, all of them in small batches; its first argument is a table."""

    @wraps(f)
    def run(docs: DataFrame, *more, **named) -> DataFrame:
        with small_batches(docs.sparkSession):
            return f(docs, *more, **named)

    return run


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20, operator: str = "") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text, or one row; gives memory back after each batch.

    operator: whose ``kept`` values stay in the worker.
    """
    starts(operator)
    for batch in batches:
        give_back()
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    give_back()


def keyed_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the splits of the contracts."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def drawn(rows: DataFrame, sample: int, group: str) -> DataFrame:
    """The distinct (doc_id, group) of rows with the smallest hashes of doc_id, at most ``sample`` a group; groups are few.

    Rows whose hash is far beyond what a group's count lets through are dropped where they are read, so about four times the sample is
    ranked, whatever the table holds.
    """
    hashed = rows.select("doc_id", group, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("_hash"))
    counts = rows.groupBy(group).agg(F.count("*").cast("double").alias("_rows"))
    near = hashed.join(F.broadcast(counts), group).where(F.col("_hash") * F.col("_rows") < 4.0 * sample * (1 << 31)).select("doc_id", group, "_hash").distinct()
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_hash", "doc_id")))
    return ranked.where(F.col("_rank") <= sample).select("doc_id", group)


def fits(df: DataFrame, most: int) -> bool:
    """Whether df has at most ``most`` rows; reads no more than one row over."""
    return df.limit(most + 1).count() <= most


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
