"""Sharding (2): a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..N-1 by a distributed sort on (id, size, checksum, MD5 of the text); the keyed permutation maps a
number to a place, and shard and slot follow from the place alone: shard = place mod n, slot = place div n. Shards
differ by one row at most, slots are gapless, and place(number) can be computed (and inverted) anywhere. Only the numbers
go through Python; texts stay in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, packed, text_or_empty, unpacked

SHARDS, KEY = 8, 20240607
ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    """a * b >= n, as close to square and to n as may be: few numbers lie outside 0..n-1."""
    a = max(1, int(np.sqrt(n)))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def _round_key(key: int, r: int) -> int:
    return (key * 0x9E3779B97F4A7C15 + (r + 1) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(x.astype(np.uint64) + np.uint64(_round_key(key, r)))


def _once(x: np.ndarray, a: int, b: int, key: int) -> np.ndarray:
    """One pass of an alternating Feistel network on Z_a x Z_b."""
    left, right = x // b, x % b
    for r in range(ROUNDS):
        if r % 2:
            right = (right + (_round(left, key, r) % np.uint64(b)).astype(np.int64)) % b
        else:
            left = (left + (_round(right, key, r) % np.uint64(a)).astype(np.int64)) % a
    return left * b + right


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each row number under a bijection of 0..n-1; walks the cycle while a value lies outside."""
    if n <= 1:
        return np.zeros_like(x)
    a, b = _halves(n)
    out = _once(np.asarray(x, np.int64), a, b, key)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = _once(out[far], a, b, key)
    return out


def _unpass(x: np.ndarray, a: int, b: int, key: int) -> np.ndarray:
    left, right = x // b, x % b
    for r in reversed(range(ROUNDS)):
        if r % 2:
            right = (right - (_round(left, key, r) % np.uint64(b)).astype(np.int64)) % b
        else:
            left = (left - (_round(right, key, r) % np.uint64(a)).astype(np.int64)) % a
    return left * b + right


def invert(y: np.ndarray, n: int, key: int) -> np.ndarray:
    """The row number at each place: the inverse of permute."""
    if n <= 1:
        return np.zeros_like(y)
    a, b = _halves(n)
    out = _unpass(np.asarray(y, np.int64), a, b, key)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = _unpass(out[far], a, b, key)
    return out


def number_rows(rows: DataFrame, order: list[str], tag: str = "numbered") -> tuple[DataFrame, int]:
    """rows with a global number _number (0..N-1) by order, and N. One range exchange; only a count per partition reaches the driver.

    Rows that are equal in order are interchangeable: the partition they come from (the same whenever it is worked out again)
    is the last key of the exchange, so that a row that stands there very often is dealt over several tasks.
    """
    spark = rows.sparkSession
    mid = F.monotonically_increasing_id()
    keys = [F.col(c).asc_nulls_last() for c in order]
    sorted_rows = rows.withColumn("_tie", F.spark_partition_id()).repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys).drop("_tie")
    local = materialize(sorted_rows.withColumn("_mid", mid), tag)
    part = F.shiftright("_mid", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in local.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    numbered = local.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row for each partition written
    return numbered.withColumn("_number", F.col("_start") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_start"), total


def _placed(rows: DataFrame, key: int, id_col: Column, text: Column) -> DataFrame:
    """_row, if there, _id, size, text_crc32, text_md5 and the place under the permutation of each row."""
    base = rows.select(*[c for c in rows.columns if c == "_row"], id_col.alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"))
    numbered, n = number_rows(base, ["_id", "size", "text_crc32", "text_md5"], "shard-rows")

    @F.arrow_udf("long")
    def place(numbers: pa.Array) -> pa.Array:
        return pa.array(permute(numbers.to_numpy(zero_copy_only=False), n, key), pa.int64())

    return numbered.withColumn("place", place(F.col("_number")))


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes + 1), text_crc32, text_md5 (names the group of equal texts), law 'rows', shard, slot, grown_shard (null).

    A null text counts as empty; texts of any length are hashed whole. Rows that are equal in id and text are
    interchangeable, other ties don't exist; null ids come last. An empty table gives an empty result. Other columns,
    whatever their names, are left out.
    """
    body = text_or_empty(text_col)
    placed = _placed(docs.select(F.col(id_col).alias("_doc"), body.alias("_text")), key, F.col("_doc"), F.col("_text"))
    at = _shard_of(shards)
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "text_md5", F.lit("rows").alias("law"), *at, F.lit(None).cast("int").alias("grown_shard"))


def _shard_of(shards: int) -> list[Column]:
    return [(F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").cast("long").alias("slot")]


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard and slot (which replace columns of these names); all other columns stay, whatever their names. See assign_shards for nulls, ties and repeats."""
    rows = packed(docs, F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"))
    placed = _placed(rows, key, F.col("_doc"), F.col("_text"))
    return unpacked(placed, [c for c in docs.columns if c not in ("shard", "slot")], *_shard_of(shards))


def _oracle(key: int = KEY, shards: int = SHARDS) -> str:
    """The result in DuckDB's SQL: CRC-32 by its polynomial, and the network's steps as queries one inside the other."""
    def wide(x: object) -> str:
        return f"CAST({x} AS UHUGEINT)"

    wrap, mult = wide(f"'{1 << 64}'"), wide(f"'{0xD6E8FEB86659FD93}'")
    rounds, left, right = [], "l", "r"
    for r in range(ROUNDS):
        odd = r % 2
        mixed, other, size = (left, right, "sb") if odd else (right, left, "sa")
        key_of = wide(f"'{_round_key(key, r)}'")
        rounds += [f"CAST(({wide(mixed)} + {key_of}) % {wrap} AS UBIGINT) AS a{r}"]
        rounds += [f"CAST(({wide(f'xor(a{r}, a{r} >> 32)')} * {mult}) % {wrap} AS UBIGINT) AS b{r}"]
        rounds += [f"CAST(({wide(f'xor(b{r}, b{r} >> 32)')} * {mult}) % {wrap} AS UBIGINT) AS c{r}"]
        rounds += [f"({other} + CAST(xor(c{r}, c{r} >> 32) % CAST({size} AS UBIGINT) AS BIGINT)) % {size} AS x{r}"]
        left, right = (left, f"x{r}") if odd else (f"x{r}", right)
    steps = "(SELECT *, place // sb AS l, place % sb AS r FROM w WHERE n > 1 AND (NOT walked OR place >= n))"
    for one in rounds:
        steps = f"(SELECT *, {one} FROM {steps})"
    return f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END) AS c FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
d AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend({0xFFFFFFFF}, b), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), {0xFFFFFFFF}) AS text_crc32, md5(text) AS text_md5 FROM d, t),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32, text_md5) - 1 AS number, count(*) OVER () AS n FROM c),
s AS (SELECT *, CAST(greatest(1, ceil(sqrt(n))) AS BIGINT) AS sa, CAST(greatest(1, ceil(n / greatest(1, ceil(sqrt(n))))) AS BIGINT) AS sb FROM n),
w(number, n, sa, sb, place, walked) AS (SELECT number, n, sa, sb, number, false FROM s
  UNION ALL SELECT number, n, sa, sb, {left} * sb + {right}, true FROM {steps})
SELECT doc_id, size, text_crc32, text_md5, 'rows' AS law, CAST(place % {shards} AS INTEGER) AS shard, CAST(place // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN (SELECT number, place FROM w WHERE place < n AND (walked OR n = 1)) USING (number)
"""


ORACLE = _oracle()
