"""MinHash near-dedup (8): improved consistent weighted sampling over TF-IDF word shingles, banded, verified.

Texts that are equal collapse to one key first. A shingle's weight is its count in the text times an inverse document
frequency between 1 and 2, which falls with the logarithm of the share of all texts that hold the shingle: 2 below one text
in RARE, 1 where all do. So much as texts differ in how common their shingles are, two texts of unweighted similarity s
have a weighted one of s / (2 - s) at least, and what links pairs by either similarity finds its candidates by the weighted
one alone. Frequencies of all documents are counted in a count-min sketch, whose error is a share of all texts that hangs
on the length of texts and not on their number: nothing that is broadcast grows with the corpus.

Each text gets SAMPLES consistent weighted samples (Ioffe 2010): two texts agree in one with their weighted Jaccard
similarity. Bands of ROWS samples name buckets. In a bucket first only the least key is compared with the others. Buckets
that lie in more than one class after that are finished whole: all their members, linked ones too, are dealt into blocks,
and members of different classes are compared, block by block; only blocks of one and the same class are left out. So each
pair of texts that share a bucket is compared or lies in one class, and no cap drops a candidate; what leaves a block is a
forest of links, never its pairs. A pair is linked if its exact weighted Jaccard similarity, or that of the unweighted
shingle counts, reaches the bound; links form classes as connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_broadcast, chunks, gram_hashes, materialize, mix64, packed, release, span_hashes, spread, strings, text_key, text_or_empty, unpacked, word_bounds, word_hashes
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 18, 5
#: Rows and bytes of shingles of a block, on average; two blocks are compared at a time.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: In the first round, pairs whose samples agree by less than the least weighted similarity of a link less this aren't verified: four standard errors of 90 samples.
MARGIN = 0.2
#: Shingles that less than one text in so many holds weigh most.
RARE = 1024
#: The document-frequency sketch: rows of counters, and how many there are in a row.
SKETCH_ROWS, SKETCH = 2, 1 << 19
#: Counters that travel together.
_SKETCH_PART = 1 << 13
_TABLE = 1 << 12
#: Shingles that are sampled at a time.
_BLOCK = 1 << 14
#: Shingles of a block that are multiplied at a time.
_COLUMNS = 1 << 11


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's runs of size words, by row, with repeats; a text of fewer words, but not none, is one shingle."""
    ws, we, bounds = word_bounds(data, offs)
    words = word_hashes(data, ws, we)
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    grams = gram_hashes(words, size)
    starts = np.repeat(bounds[:-1], count) + spread(count)
    short = n[row] < size
    out = np.zeros(len(row), np.uint64)
    out[~short] = grams[starts[~short]]
    if short.any():
        out[short] = span_hashes(words, starts[short], bounds[1:][row[short]])
    return (out >> np.uint64(32)).astype(np.uint32), row


def counted(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, their rows and counts, by row and hash."""
    both, count = np.unique(row.astype(np.uint64) << np.uint64(32) | hashes, return_counts=True)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64), count


def places(hashes: np.ndarray) -> list[np.ndarray]:
    """A shingle's counter in each row of the sketch."""
    wide = mix64(hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [(wide >> np.uint64(32 * k) & np.uint64(SKETCH - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]


def levels(counts: np.ndarray, rows: int) -> np.ndarray:
    """255 times the share of the way from common to rare, for each counter of the sketch: one byte each."""
    way = np.log((rows + 1) / (counts + 1)) / np.log(RARE)
    return np.rint(255 * np.clip(way, 0, 1)).astype(np.uint8)


def weights_of(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Inverse document frequency, 1 to 2, of each shingle: the least of its counters counts."""
    most = sketch[0][(at := places(hashes))[0]]
    for k in range(1, SKETCH_ROWS):
        most = np.maximum(most, sketch[k][at[k]])
    return 1 + most.astype(np.float32) / 255


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part of the sketch: the sums of its rows' counters. A task holds one sketch at most."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            held[part] = held.get(part, 0) + np.frombuffer(raw.as_buffer(), np.int64)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([0] * len(held)), pa.array([h.tobytes() for h in held.values()], pa.binary())], names=["part", "task", "counts"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The sketch of all texts as levels(). Each task sends a sketch, in parts that are added up in two steps; the driver holds one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, task = np.zeros((SKETCH_ROWS, SKETCH), np.int64), 0, 0
        for batch in batches:
            data, offs = strings(batch.column(0))
            rows += len(batch)
            task = batch.column(1)[0].as_py() if len(batch) else task
            for i, j in chunks(offs):
                h, _, _ = counted(*shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                for k, at in enumerate(places(h)):
                    total[k] += np.bincount(at, minlength=SKETCH)
        if rows:
            parts = total.reshape(-1, _SKETCH_PART)
            some = np.flatnonzero(parts.any(axis=1))
            raw = [np.array([rows]).tobytes(), *(parts[k].tobytes() for k in some)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()]), pa.array([task] * len(raw)), pa.array(raw, pa.binary())], names=["part", "task", "counts"])

    fields = "part long, task long, counts binary"
    made = texts.select("text", F.spark_partition_id().cast("long").alias("task")).mapInArrow(count, fields)
    added = made.repartition("part", F.pmod("task", F.lit(64))).mapInArrow(_add_up, fields).repartition("part").mapInArrow(_add_up, fields)
    counts, rows = np.zeros((SKETCH_ROWS * SKETCH // _SKETCH_PART, _SKETCH_PART), np.int64), 0
    for r in added.collect():
        if r.part < 0:
            rows = int(np.frombuffer(r.counts, np.int64)[0])
        else:
            counts[r.part] = np.frombuffer(r.counts, np.int64)
    return levels(counts.reshape(SKETCH_ROWS, SKETCH), rows)


def _tables() -> tuple[np.ndarray, ...]:
    rng = np.random.Generator(np.random.PCG64(8))
    r = rng.gamma(2.0, size=_TABLE).astype(np.float32)
    return r, (1 / r).astype(np.float32), np.log(rng.gamma(2.0, size=_TABLE)).astype(np.float32), rng.random(_TABLE).astype(np.float32), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_R, _R_INVERSE, _LOG_C, _B, _ODD = _tables()


def weighted_samples(hashes: np.ndarray, row: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n x SAMPLES consistent samples of each row's weighted set (0 for an empty row); hashes by row."""
    out = np.zeros((n, len(_ODD)), np.uint32)
    if not len(hashes):
        return out
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    full = row[first]
    wide = mix64(hashes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    logs = np.log(weights).astype(np.float32)
    mask = np.uint64(_TABLE - 1)
    ends = np.append(first[1:], len(hashes))
    lo = 0
    while lo < len(first):  # some rows at a time, so that the work stays in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + _BLOCK, "right")))
        part = slice(first[lo], ends[hi - 1])
        w, lg, at = wide[part], logs[part], first[lo:hi] - first[lo]
        for k, odd in enumerate(_ODD):
            x = (w * odd) >> np.uint64(28)
            i = (x & mask).astype(np.intp)
            r, b = _R[i], _B[(x >> np.uint64(12) & mask).astype(np.intp)]
            t = np.floor(lg * _R_INVERSE[i] + b)
            value = _LOG_C[(x >> np.uint64(24) & mask).astype(np.intp)] - r * (t - b) - r
            bits = value.view(np.uint32)
            rank = bits ^ ((bits >> np.uint32(31)) * np.uint32(0x7FFFFFFF) | np.uint32(0x80000000))
            name = (x ^ t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
            out[full[lo:hi], k] = (np.minimum.reduceat(rank.astype(np.uint64) << np.uint64(32) | name, at) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lo = hi
    return out


def _signatures(sketch: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column(1))
            for i, j in chunks(offs):
                h, row, tf = counted(*shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                samples = weighted_samples(h, row, tf * weights_of(h, sketch), j - i)
                bands = gram_hashes(samples.ravel().astype(np.uint64), ROWS)[:: ROWS].reshape(j - i, BANDS)
                bands = mix64(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                some = np.bincount(row, minlength=j - i) > 0
                ends = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel()))
                each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(samples.shape[1] * 4), j - i, [None, pa.py_buffer(samples.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists, each], names=["key", "doc", "bands", "samples"])

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the sorted shingle hashes of one row of each text."""
    for batch in batches:
        doc, carrier = batch.column(0), batch.column(1)
        own = batch.filter(pc.or_(pc.fill_null(pc.equal(doc, carrier), False), pc.and_(doc.is_null(), carrier.is_null())))
        if not len(own):
            continue
        data, offs = strings(own.column(3))
        for i, j in chunks(offs):
            h, row = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            order = np.argsort(row.astype(np.uint64) << np.uint64(32) | h, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=j - i))).astype(np.int32) * 4
            body = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h[order].tobytes())])
            yield pa.RecordBatch.from_arrays([own.column(2).slice(i, j - i), body], names=["key", "body"])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32), np.repeat(np.arange(len(column)), np.diff(offs) // 4)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and unweighted Jaccard similarity of n pairs of shingle lists (hashes, pair number): lesser counts over greater counts; 1 for two empty lists."""
    ha, ra, ca = counted(*a)
    hb, rb, cb = counted(*b)
    ka, kb = ra.astype(np.uint64) << np.uint64(32) | ha, rb.astype(np.uint64) << np.uint64(32) | hb
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(ca[ia], cb[ib]).astype(float)
    out = []
    for wa, wb in ((weights_of(ha, sketch).astype(float), weights_of(hb, sketch).astype(float)), (np.ones(len(ha)), np.ones(len(hb)))):
        low = np.bincount(ra[ia], both * wa[ia], n)
        high = np.bincount(ra, ca * wa, n) + np.bincount(rb, cb * wb, n) - low
        out.append(np.where(high > 0, low / np.where(high > 0, high, 1), 1.0))
    return out[0], out[1]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose samples agree often enough for a verification to be worth while."""
    for batch in batches:
        one, other = (_unpack(batch.column(k))[0].reshape(len(batch), -1) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((one == other).mean(axis=1))], names=["key", "centre", "share"])


def _verify(sketch: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                sim, plain = similarities(_unpack(batch.column(2)), _unpack(batch.column(3)), len(batch), sketch)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim), pa.array(np.maximum(sim, plain) >= least)], names=["a", "b", "sim", "near"])

    return run


def _both_ends(edges: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """key, centre and the column's value of either."""
    left = edges.join(of.select("key", F.col(column).alias("one")), "key")
    return left.join(of.select(F.col("key").alias("centre"), F.col(column).alias("other")), "centre").select("key", "centre", "one", "other")


def near_pairs(hashes: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, sketch: np.ndarray, least: float) -> np.ndarray:
    """Whether the texts left[i] and right[j] (rows of the sorted shingle hashes) reach the similarity, for all i and j.

    The least of two counts is the number of t with both counts t or more: items (shingle, t) of one weight turn the sums into
    products of 0-1 matrices. Items of one text add to its own sum only.
    """
    n = int(max(left.max(), right.max())) + 1
    start = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(hashes) else np.zeros(0, bool))
    t = np.arange(len(hashes)) - np.repeat(start, np.diff(np.append(start, len(hashes))))
    own = np.bincount(row, weights_of(hashes, sketch).astype(float), n)
    size = np.bincount(row, minlength=n).astype(float)
    items, col, count = np.unique(t.astype(np.uint64) << np.uint64(32) | hashes, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[col] > 1)
    keep = keep[np.argsort(col[keep], kind="stable")]
    shared = np.flatnonzero(count > 1)
    at = np.searchsorted(shared, col[keep])
    weight = weights_of((items[shared] & np.uint64(0xFFFFFFFF)).astype(np.uint32), sketch).astype(float)
    low, both = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    for i in range(0, len(shared), _COLUMNS):
        j = min(i + _COLUMNS, len(shared))
        lo, hi = np.searchsorted(at, [i, j])
        held = np.zeros((n, j - i))
        held[row[keep[lo:hi]], at[lo:hi] - i] = 1
        one, other = held[left], held[right].T
        low += (one * weight[i:j]) @ other
        both += one @ other
    out = np.zeros(low.shape, bool)
    for part, whole in ((low, own), (both, size)):
        high = whole[left][:, None] + whole[right][None, :] - part
        out |= np.where(high > 0, part / np.where(high > 0, high, 1), 1.0) >= least
    return out


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
    """Of the near pairs (left[i], right[j]) as many as join the classes (of all rows) that they join together."""
    now, out = np.unique(classes, return_inverse=True)[1], []
    for i in np.flatnonzero((near & (now[left][:, None] != now[right][None, :])).any(axis=1)):
        to = right[near[i]]
        roots, first = np.unique(now[to], return_index=True)
        mine = now[left[i]]
        fresh = roots != mine
        if fresh.any():
            out += [(int(left[i]), int(to[k])) for k in first[fresh]]
            now[np.isin(now, roots)] = mine
    return out


def _finish(sketch: np.ndarray, least: float):
    """Links a, b between the classes of each unit's two blocks (or of its one block); rows by unit."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        side, classes = rows.column(1).to_numpy(), rows.column(3).to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        if not len(left) or len(np.unique(classes)) < 2:
            return None
        found = np.array(forest(near_pairs(*_unpack(rows.column(4)), left, right, sketch, least), left, right, classes), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(found[:, k])) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = [], None
        for batch in batches:
            if not len(batch):
                continue
            units = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, units[1:] != units[:-1])), len(units))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and units[i] != unit:
                    if (out := links(held)) is not None:
                        yield out
                    held = []
                unit = units[i]
                held.append(batch.slice(i, j - i))
        if held and (out := links(held)) is not None:
            yield out

    return run


def _unsettled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, key, class of all members of the buckets that lie in more than one class so far; in a bucket of two the pair has been compared."""
    marked = members.join(groups.select(F.col("node").alias("key"), "component"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("c"))
    mixed = marked.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2")
    mixed = materialize(mixed.select("bucket"), "mixed")
    out = materialize(marked.join(bounded_broadcast(mixed), "bucket", "left_semi"), "unsettled", F.count(F.lit(1)).alias("n"))
    release(mixed)
    return out


def _more_links(members: DataFrame, bodies: DataFrame, sketch: np.ndarray, least: float) -> DataFrame:
    """a, b: links that join the classes of members (bucket, key, c) that belong together.

    Each bucket's members are dealt into blocks; each two blocks of a bucket, or one with itself, are a unit of work. A class
    that fills a block has blocks of its own, which don't meet each other; other classes of a bucket share blocks.
    """
    sized = members.join(bodies.select("key", F.length("body").alias("size")), "key")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    classes = sized.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    classes = materialize(classes.withColumn("alone", parts > 1).withColumn("of", F.when(parts > 1, F.col("c")).otherwise(0)), "block-classes")
    pools = classes.groupBy("bucket", "alone", "of").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    pools = materialize(pools.select("bucket", "alone", "of", parts.alias("parts")), "block-pools")
    name = lambda k: F.xxhash64("bucket", "alone", "of", k).alias("block")
    dealt = members.join(bounded_broadcast(classes.select("bucket", "c", "alone", "of")), ["bucket", "c"]).join(bounded_broadcast(pools), ["bucket", "alone", "of"])
    dealt = dealt.select("key", "c", name(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    blocks = pools.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", "alone", "of", name(F.col("k")))
    blocks = materialize(blocks, "blocks")
    others = blocks.select("bucket", F.col("alone").alias("alone_"), F.col("of").alias("of_"), F.col("block").alias("other"))
    two = blocks.join(others, "bucket").where("block <= other and not (alone and alone_ and of = of_)").select("block", "other", F.monotonically_increasing_id().alias("unit"))
    ends = F.when(F.col("block") == F.col("other"), F.array(F.struct(F.lit(0).alias("side"), "block"))).otherwise(F.array(F.struct(F.lit(0).alias("side"), "block"), F.struct(F.lit(1).alias("side"), F.col("other").alias("block"))))
    places = materialize(two.select("unit", F.inline(ends)), "units")
    placed = materialize(dealt.join(places, "block").select("unit", "side", "key", "c"), "placed")
    # a fixed number of partitions, the units dealt round: the work grows with the square of a block's rows, not with the bytes by which AQE merges
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = placed.join(bodies, "key").select("unit", "side", "key", "c", "body").repartitionById(n, F.pmod("unit", F.lit(n)).cast("int")).sortWithinPartitions("unit")
    out = materialize(units.mapInArrow(_finish(sketch, least), "a long, b long"), "more-links", F.count(F.lit(1)).alias("n"))
    release(classes, pools, blocks, places, placed)
    return out


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, key (64-bit hash of the text), class_key for every row: rows of equal or linked texts share class_key.

    Null texts count as empty. Texts without words are alike only if equal; texts of fewer words than a shingle are one
    shingle; texts of any length are compared whole. Repeated rows and ids, and null ids, keep a row each; other columns,
    whatever their names, are left out; an empty table gives an empty result.
    """
    bounded_batches(docs)
    body = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("doc"), body.alias("text"), text_key(body).alias("key"))
    sketch = document_frequencies(texts)
    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.select("key", "text", "doc").mapInArrow(_signatures(sketch), f"key long, doc {kind}, bands array<long>, samples binary")
    signed = materialize(made.groupBy("key").agg(F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.min("doc").alias("carrier")), "signatures")
    likely = similarity / (2 - similarity) - MARGIN
    members = signed.select("key", F.explode("bands").alias("bucket"))
    # the least key first, so that the buckets of one group agree; written first, so that the join's exchanges are its own and AQE can split a hot bucket
    centres = materialize(members.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n"), "centres")
    pairs = materialize(members.join(centres, "bucket").where("key <> centre"), "pairs")
    edges = materialize(pairs.select("key", "centre").distinct(), "edges", F.count(F.lit(1)).alias("n"))
    found = texts.select("doc", "key")
    if not edges.measured["n"]:
        release(signed, centres, pairs, edges)
        return found.withColumn("class_key", F.col("key"))
    ends = materialize(edges.select("key").union(edges.select(F.col("centre").alias("key"))).distinct(), "ends")
    marked = _both_ends(edges, signed.select("key", "samples").join(bounded_broadcast(ends), "key"), "samples")
    worth = materialize(marked.mapInArrow(_likely, "key long, centre long, share double").where(F.col("share") >= likely).select("key", "centre"), "likely")
    wanted = materialize(ends.join(signed.select("key", "carrier"), "key"), "wanted")
    some = texts.join(bounded_broadcast(wanted), "key").select("doc", "carrier", "key", "text")
    bodies = materialize(some.mapInArrow(_bodies, "key long, body binary").distinct(), "shingles")
    judged = materialize(_both_ends(worth, bodies, "body").mapInArrow(_verify(sketch, similarity), "a long, b long, sim double, near boolean"), "judged")
    groups = materialize(components(judged.where("near").select("a", "b")), "groups")
    centres_too = pairs.select("bucket", "key").union(pairs.select("bucket", F.col("centre").alias("key")).distinct())
    left = _unsettled(centres_too, groups)
    release(signed, centres, pairs, edges, ends, worth, wanted, judged)
    if left.measured["n"]:
        more = _more_links(left, bodies, sketch, similarity)
        if more.measured["n"]:
            # classes so far enter as stars, so that only new links are worked on
            groups = materialize(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "groups")
        release(more)
    release(left, bodies)
    return found.join(bounded_broadcast(groups.withColumnRenamed("node", "key")), "key", "left").select("doc", "key", F.coalesce("component", "key").alias("class_key"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the class's least id; null if all its ids are null), class_size: one row per input row. See near_classes for special cases."""
    rows = materialize(near_classes(docs, similarity, id_col, text_col), "classes")
    least = materialize(rows.groupBy("class_key").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size")), "class-ids")
    return rows.join(bounded_broadcast(least), "class_key").select(F.col("doc").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the least id (null last), then the least text key; all columns kept, whatever their names.

    Of rows equal in id and text one stays. See near_classes for nulls, empty texts and the like. Texts of rows without a
    near copy never leave their place if the list of rows that go is small enough to be broadcast.
    """
    rows = materialize(near_classes(docs, similarity, id_col, text_col), "classes")
    best = rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "key")).alias("w"), F.count("*").alias("size")).where("size > 1")
    best = materialize(best, "winners")
    several = rows.join(bounded_broadcast(best), "class_key").select("doc", "key", (F.col("doc").eqNullSafe(F.col("w.doc")) & (F.col("key") == F.col("w.key"))).alias("best"), "class_key")
    several = materialize(several, "copies", F.count_if(F.col("best")).alias("best"))
    go = materialize(several.where("not best").select(F.col("doc").alias("_doc"), F.col("key").alias("_key")).distinct(), "go")
    own = packed(docs, text_key(text_or_empty(text_col)).alias("_own"), F.col(id_col).alias("_id"))
    kept = own.join(bounded_broadcast(go), (F.col("_own") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_doc")), "left_anti")
    if several.measured["best"] > best.count():
        kept = kept.dropDuplicates(["_id", "_own"])
    return unpacked(kept, docs.columns)
