"""Document fingerprints (6): locally consistent parsing by deterministic coin tossing.

Each level collapses runs, tosses coins (a symbol's label is the place and value of the lowest bit in which it differs from
its left neighbour, three times over, down to six labels) and cuts where labels peak; a block's name is the hash of its
symbols. Names and cuts depend on a few neighbours only, so equal substrings get equal names in their interior wherever
they stand. Level 0 works on UTF-8 bytes with small tables, later levels on 64-bit names. A fingerprint is a MinHash of the
names of LEVEL (phrases of some 15 bytes): SLOTS bytes, as hex.

Texts are put in id order once by a range exchange; each partition pairs its rows with the next, and the few pairs that
straddle partitions are joined afterwards by partition number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, materialize, mix64, strings, text_key, text_or_empty

LEVEL, SLOTS = 3, 128
_MULT = np.uint64(0x5851F42D4C957F2D)


def _toss_table(n: int) -> np.ndarray:
    """Label of (left, own): twice the lowest bit in which they differ, plus own's value of it; 0 where they are equal."""
    left, own = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    x = left ^ own
    low = np.where(x > 0, np.log2(np.maximum(x & -x, 1)), 0).astype(int)
    return np.where(x > 0, 2 * low + (own >> low & 1), 0).astype(np.uint8).ravel()


_T256, _T128, _T16, _T8 = (_toss_table(n) for n in (256, 128, 16, 8))
_BYTE_NAMES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _again(label: np.ndarray, first: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Labels of labels; a row's first keeps the value that stands for a left end."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = label[first] ^ 1
    return table[left.astype(np.uint16) * np.uint16(width) + label]


def _cuts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of blocks: each row's first symbol, and strict peaks of the label within a row."""
    peak = np.zeros(len(label), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[first[1:] - 1] = False
    peak[first] = True
    return np.flatnonzero(peak)


def _named(names: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    lens = np.diff(np.append(cuts, len(names)))
    at = np.arange(len(names)) - np.repeat(cuts, lens)
    powers = np.cumprod(np.full(int(lens.max()), _MULT, np.uint64))
    return mix64(np.add.reduceat(names * powers[at], cuts) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _collapse(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs, their lengths, and the rows' bounds among runs."""
    new = np.empty(len(symbols), bool)
    new[0], new[1:] = True, symbols[1:] != symbols[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(symbols))), np.searchsorted(at, bounds)


def phrases(data: np.ndarray, offs: np.ndarray, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Names of the given level and each row's first (n + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    at, run, bounds = _collapse(data, offs)
    own = data[at]
    first = bounds[:-1][np.diff(bounds) > 0]
    label = _again(_again(_again(own, first, _T256, 256), first, _T16, 16), first, _T8, 8)
    cuts = _cuts(label, first)
    names = _named(_BYTE_NAMES[own] + run.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB), cuts)
    bounds = np.searchsorted(cuts, bounds)
    for _ in range(level - 1):
        at, run, bounds = _collapse(names, bounds)
        own = names[at]
        first = bounds[:-1][np.diff(bounds) > 0]
        left = np.empty_like(own)
        left[1:] = own[:-1]
        left[first] = ~own[first]
        x = own ^ left
        low = np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.uint64)
        label = (np.uint64(2) * low + (own >> low & np.uint64(1))).astype(np.uint8)
        label = _again(_again(_again(label, first, _T128, 128), first, _T16, 16), first, _T8, 8)
        cuts = _cuts(label, first)
        names = _named(np.where(run > 1, mix64(own + run.astype(np.uint64)), own), cuts)
        bounds = np.searchsorted(cuts, bounds)
    return names, bounds


_ODD = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n x SLOTS bytes; rows of empty texts are zero (see hex_of)."""
    names, bounds = phrases(data, offs)
    n = len(offs) - 1
    out = np.zeros((n, SLOTS), np.uint8)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        starts = bounds[:-1][full]
        for k, odd in enumerate(_ODD):
            x = names * odd
            low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
            out[full, k] = (mix64(low) >> np.uint64(56)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the phrase sets, corrected for slots that agree by chance; 1 for two empty texts, 0 for one."""
    same = (a == b).mean(axis=1)
    est = np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), est)


def hex_of(sig: np.ndarray, empty: np.ndarray) -> list[str]:
    """Hex of each signature; an empty text's fingerprint is the empty string."""
    return ["" if e else row.tobytes().hex() for row, e in zip(sig, empty, strict=True)]


def _signed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = [signatures(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
    return (np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.uint8)), np.diff(offs) == 0


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row: the plain operator, a map.

    Null texts count as empty; repeated rows give as many rows; an empty table gives an empty result; other columns, whatever
    their names, are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column(1))
            parts = [signatures(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
            sig = np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hex_of(sig, np.diff(offs) == 0), pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edit(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = ["kind", "part", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]


def _pairs(ids: pa.Array, texts: list[str], following: list[str], sig: np.ndarray, next_sig: np.ndarray, part: int) -> pa.RecordBatch:
    """Result rows of texts with their next texts."""
    made = [edit(a, b).encode() for a, b in zip(texts, following, strict=True)]
    edited, edited_empty = _signed(made)
    empty = np.array([not t for t in texts], bool)
    next_empty = np.array([not t for t in following], bool)
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in made], pa.string()),
            pa.array(hex_of(sig, empty), pa.string()), pa.array(hex_of(edited, edited_empty), pa.string()), pa.array(likeness(sig, edited, empty, edited_empty)), pa.array(likeness(sig, next_sig, empty, next_empty)), pa.nulls(n, pa.string()),
        ],
        names=_FIELDS,
    )


def _edge(kind: int, part: int, id_: pa.Array, text: str) -> pa.RecordBatch:
    null = pa.nulls(1, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), id_, pa.nulls(1, pa.int64()), null, null, null, pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([text], pa.string())], names=_FIELDS)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against its edit with, and the text of, the next row in id order (after the last: the first).

    Null texts are empty; texts of any length are read whole; null ids come last; rows equal in id follow by the hash of
    their text; a single row is its own next; an empty table gives an empty result; other columns, whatever their names, are
    left out.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text"), text_key(body).alias("key"), F.spark_partition_id().alias("tie"))
    order = [F.col("id").asc_nulls_last(), F.col("key").asc(), F.col("tie").asc()]  # equal rows are interchangeable, and dealt out by the partition they come from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept = None  # the last row so far: id, text, signature
        for batch in batches:
            for i in range(0, len(batch), 1000):
                ids = batch.column(0).slice(i, 1000)
                texts = batch.column(1).slice(i, 1000).to_pylist()
                sig, _ = _signed([t.encode() for t in texts])
                if kept is None:
                    yield _edge(1, part, ids.slice(0, 1), texts[0])
                else:
                    ids, texts, sig = pa.concat_arrays([kept[0], ids]), [kept[1], *texts], np.concatenate([kept[2], sig])
                if len(texts) > 1:
                    yield _pairs(ids.slice(0, len(texts) - 1), texts[:-1], texts[1:], sig[:-1], sig[1:], part)
                kept = ids.slice(len(texts) - 1, 1), texts[-1], sig[-1:]
        if kept is not None:
            yield _edge(2, part, kept[0], kept[1])

    schema = f"kind int, part int, id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(ordered.select("id", "text").mapInArrow(run, schema), "fingerprints")
    parts = sorted(r[0] for r in made.where("kind = 1").select("part").collect())  # a number per partition
    turn = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, following int")
    lasts = made.where("kind = 2").select("part", "id", "text").join(F.broadcast(turn), "part")
    firsts = made.where("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                yield _pairs(batch.column(0), texts, following, _signed([t.encode() for t in texts])[0], _signed([t.encode() for t in following])[0], -1)

    rest = lasts.join(firsts, "following").select("id", "text", "next_text").mapInArrow(finish, schema)
    return made.where("kind = 0").union(rest).select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
