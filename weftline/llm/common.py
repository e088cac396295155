"""Shared pieces: packed rows, and vectorised word hashing on Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import BATCH_ROWS, BROADCAST_BYTES, BROADCAST_ROWS, bounded_batches, bounded_broadcast, fits_broadcast, quoted, release  # noqa: F401
from ..storage import written as materialize  # noqa: F401

#: Bytes of text that numpy works on at a time; a longer single text is one chunk.
CHUNK_BYTES = 1 << 20


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one struct column _row, beside the columns in more: whatever docs' columns are called, they don't clash."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), *more)


def unpacked(rows: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """The columns of a packed table, and those in more."""
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns], *more)


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col):
    """64-bit identity of a text; never null."""
    return F.xxhash64(col)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (n + 1, from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together (or one row)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def _byte_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE, _BYTES = _space_table(), _byte_table()
_MULT = np.uint64(0x5851F42D4C957F2D)


def word_bounds(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run of bytes outside breaks, within one row), and the index of each row's first word (n + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~breaks[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    cut = offs[offs < len(data)]
    before[cut] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    cut = offs[offs > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.cumprod(np.full(int(lens.max()), _MULT, np.uint64))
    values = _BYTES[data[at + np.repeat(starts, lens)]] * powers[at]
    return mix64(np.add.reduceat(values, first) + lens.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries; len(words) - k + 1 of them, over row bounds too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = words[:n].copy()
    for j in range(1, k):
        g *= _MULT
        g += words[j : n + j]
    return mix64(g)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span words[start:end]."""
    powers = np.cumprod(np.full(len(words) + 1, _MULT, np.uint64))
    inverse = np.cumprod(np.full(len(words) + 1, np.uint64(pow(int(_MULT), -1, 1 << 64)), np.uint64))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, in one array."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


#: CRC-32 of short ASCII strings in DuckDB's SQL: the polynomial's table as a one-row table t, and the checksum of an expression.
CRC_TABLE = f"t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END) AS c FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"


def crc_sql(text: str) -> str:
    """The checksum of an expression's text, null for null."""
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend({0xFFFFFFFF}, list_transform(regexp_extract_all(CAST({text} AS VARCHAR), '.'), lambda h: CAST(ascii(h) AS BIGINT))), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), {0xFFFFFFFF}) END"
