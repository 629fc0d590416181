"""What the text operators share: lineage cuts, samples, text blocks, words and hashes in numpy."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.operators.settle import settled


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    return settled(df)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def bounded_sample(df: DataFrame, key: str, rows: int, *content: str) -> DataFrame:
    """About ``rows`` distinct rows at most, chosen by a hash of ``key`` and ``content``: the same ones on every run, spread over the whole table."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 32))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key, *content), F.lit(1 << 32)) < share)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; once they end, the worker process, which the next task takes over, gives the memory it no longer uses back to the system."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has one
    if trim:
        trim(0)


def text_blocks(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row: the rows, their UTF-8 bytes and each row's offsets. Nulls are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Bytes of words: digits, lower-case letters and all bytes of characters past ASCII.
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: A-Z become a-z; other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true places that cross no row's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    borders = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[borders] = False
    after[borders - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(len(data), _STEP, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers, out=total[1:])
    back = np.full(len(data), _BACK, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    h = (total[ends] - total[starts]) * back[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the rows in ``data``: row, hash and start. A-Z count as a-z."""
    low = LOWER[data]
    starts, ends = runs(WORD_BYTES[low], offsets)
    return np.searchsorted(offsets, starts, "right") - 1, hashes(low, starts, ends), starts
