"""What the operators of this subpackage share: bytes of a column, words, hashes, scratch tables.

Work inside a task is done on whole Arrow batches with numpy. A batch is cut into pieces of about
``PIECE`` bytes of text (a longer text is a piece of its own), so that memory follows the piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from agorametrics.session import shared_dir

PIECE = 8 << 20

#: Bytes of words: digits, letters and everything outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def release(*frames: DataFrame) -> None:
    """Give back the space of stored frames that nothing will read any more: each becomes an empty table."""
    for df in frames:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(df.stored_at)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [s if s.lower() not in taken else f"{s}_{uuid.uuid4().hex[:8]}" for s in stems]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each have about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    # a worker waits for its next task with what Arrow still holds
    pa.default_memory_pool().release_unused()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each starts (one more for the end). Null counts as empty."""
    if column.null_count:
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset:].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; runs never cross texts."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < mask.size)]
    before[inner] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def packed(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind=None) -> pa.Array:
    """The runs as an Arrow array."""
    at = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.Array.from_buffers(kind or pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[mask])])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a well-known finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: int, _kept: dict = {}) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, as every piece needs them."""
    have = _kept.get(base)
    if have is None or have.size < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _kept[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of each run of bytes, the same in every task."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(lengths.max())
    at = ragged(np.zeros(len(starts), np.int64), lengths)
    values = (data[ragged(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(longest, base)[at]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def put(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch with more columns, typed as ``schema`` says."""
    arrays = [columns[f.name] if f.name in columns else batch.column(batch.schema.get_field_index(f.name)) for f in schema]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def short(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2 ** 35 in seven bits a byte, low ones first, and how many bytes each takes."""
    numbers = numbers.astype(np.int64)
    size = np.ones(numbers.size, np.int64)
    for k in range(1, 5):
        size += numbers >= 1 << 7 * k
    out = np.empty(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = numbers[some] >> 7 * k & 0x7F | np.where(size[some] > k + 1, 0x80, 0)
    return out, size


def long(data: np.ndarray) -> np.ndarray:
    """The numbers that ``short`` wrote."""
    if not data.size:
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(data.size) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << 7 * place, first)
