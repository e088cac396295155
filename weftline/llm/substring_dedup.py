"""Substring dedup (1): prefix-partitioned suffix trees over word sequences; deep nodes give the repeats.

A suffix that can start a repeat of `window` words is filed under a prefix that ends with the least word 8-gram among its
first `window` words (by hash, leftmost of equals), so that equal windows always meet under one prefix and neighbouring
suffixes share their words: a run of consecutive starts under one 8-gram occurrence is kept as one piece, the words of all
its windows. Prefixes that occur once hold no repeat and go first, by counting. Pieces that are equal as a whole are
repeats without any tree. For the rest, prefix groups of a bounded size meet in a task, which builds the suffix tree of
each batch of groups as a sorted suffix array with its LCPs: nodes of `window` words' depth with two leaves or more are
repeats. A group over the bound takes the longest prefix, all `window` words, and so needs a count only.

Every exchange on a prefix is pre-aggregated, or one of a join whose two sides are written tables, so that AQE splits a hot
key: a passage, or a text, in a third of all documents is never gathered into one task. Texts are known by a 64-bit hash and
a checksum together, and cross the network twice: those that need a tree to meet their list of pieces, all to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_broadcast, chunks, gram_hashes, materialize, release, span_hashes, spread, strings, text_key, text_or_empty, word_bounds, word_hashes

GRAM = 8
#: Distinct pieces under one prefix that a task may gather; more take the longest prefix. A resource bound: results don't depend on it.
GROUP_PIECES = 800
#: Suffixes for which a task builds one tree, of many groups.
TREE_SUFFIXES = 150_000
_POS_BITS = np.uint64(28)
_WORD_BYTES = 6
#: A text's identity, and the columns of a piece.
KEY = ["key", "crc"]
_PIECE = "key long, crc int, loc long"


def pieces(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share the least 8-gram: first and last start, row, and that gram's hash.

    words: hashes of the words of all rows; bounds: index of each row's first word (n + 1).
    """
    none = np.zeros(0, np.int64)
    n = len(words) - window + 1
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(words, GRAM)
    keyed = (grams >> _POS_BITS << _POS_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, least, reach = window - GRAM + 1, keyed, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
    lens = np.diff(bounds)
    count = np.maximum(lens - window + 1, 0)
    starts = np.repeat(bounds[:-1], count) + spread(count)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(lens)), count)
    at = at[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], row[first], grams[at[first]]


def subtree(words: np.ndarray, group: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix tree of the suffixes at starts, one tree a group, down to depth: leaves in order, and the common prefix of each with the leaf before it (0 across groups).

    All suffixes have depth words at least. Ranks of doubled prefixes order the suffixes, as when a suffix array is built;
    runs of leaves with common prefixes of depth are the leaves below one deep internal node.
    """
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    reach = 1
    while reach * 2 <= depth:
        r = ranks[-1]
        pair = r[: len(r) - reach] * np.int64(len(words) + 1) + r[reach:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        reach *= 2
    top = ranks[-1]
    order = np.lexsort((top[starts + depth - reach], top[starts], group))
    a, b = starts[order][:-1], starts[order][1:]
    common, alive = np.zeros(len(order), np.int64), np.flatnonzero(group[order][1:] == group[order][:-1])
    a, b, at = a[alive], b[alive], np.zeros(len(alive), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step, r = 1 << level, ranks[level]
        fits = at + step <= depth
        same = np.zeros(len(at), bool)
        same[fits] = r[a[fits] + at[fits]] == r[b[fits] + at[fits]]
        at[same] += step
        if level == len(ranks) - 1:  # depth less twice this step may need it once more, or the steps below
            same = (at == step) & (r[a + depth - step] == r[b + depth - step])
            at[same] = depth
    common[1:][alive] = at
    return order, common


def repeated_leaves(order: np.ndarray, common: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, whether a node at least depth deep holds it and weight 2 in all."""
    node = np.cumsum(common < depth) - 1
    total = np.bincount(node, weights=weight[order])
    out = np.zeros(len(order), bool)
    out[order] = total[node] >= 2
    return out


def _starts_of(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return loc >> 8, loc & 255


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column(2))
            keys, crcs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in chunks(offs):
                part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ws, we, bounds = word_bounds(part, po)
                words = word_hashes(part, ws, we)
                first, last, row, gram = pieces(words, bounds, window)
                if len(first):
                    sig = span_hashes(words, first, last + window)
                    loc = (first - bounds[row]) << 8 | (last - first)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(keys[i:j][row]), pa.array(crcs[i:j][row]), pa.array(loc)], names=["h", "sig", "key", "crc", "loc"])

    return scan


def _extract(window: int):
    """The words of each piece that needs a tree; each window's hash where the longest prefix is taken.

    Rows equal in id and text have the same pieces: a task gives them once.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, text in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if text not in seen:
                    seen.add(text)
                    new.append(i)
            if len(new) < len(batch):
                batch = batch.take(pa.array(new, pa.int32()))
            keys, crcs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = strings(batch.column(2))
            lists = batch.column(3)
            for i, j in chunks(offs):
                part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ws, we, bounds = word_bounds(part, po)
                words = word_hashes(part, ws, we)
                wanted = lists.slice(i, j - i)
                flat, counts = wanted.flatten(), wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(j - i), counts)
                h, c, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("h", "c", "hot"))
                loc = flat.field("loc").to_numpy(zero_copy_only=False)
                first, more = _starts_of(loc)
                first = first + bounds[row]
                for is_hot in (False, True):
                    at = np.flatnonzero(hot == is_hot)
                    if not len(at):
                        continue
                    if is_hot:
                        per = more[at] + 1
                        s = np.repeat(first[at], per) + spread(per)
                        owner = np.repeat(at, per)
                        wh = span_hashes(words, s, s + window)
                        yield _rows(h[owner], keys[i:j][row[owner]], crcs[i:j][row[owner]], s - bounds[row[owner]] << 8, c[owner], None, wh)
                    else:
                        lens = more[at] + window
                        taken = words[np.repeat(first[at], lens) + spread(lens)]
                        raw = np.ascontiguousarray(taken.view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES]).tobytes()
                        ends = np.append(0, np.cumsum(lens)) * _WORD_BYTES
                        body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                        yield _rows(h[at], keys[i:j][row[at]], crcs[i:j][row[at]], loc[at], c[at], body, None)

    return extract


def _rows(h, key, crc, loc, c, body, wh) -> pa.RecordBatch:
    n = len(h)
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(key), pa.array(crc), pa.array(loc), pa.array(c.astype(np.int64)), body if body is not None else pa.nulls(n, pa.binary()), pa.array(wh.view(np.int64)) if wh is not None else pa.nulls(n, pa.int64())],
        names=["h", "key", "crc", "loc", "c", "body", "wh"],
    )


def _trees(window: int):
    """Rows come ordered by h. Whole groups are put together until a tree's worth of suffixes is there."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        h, key, crc, loc, c = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        raw = rows.column(5)
        offs = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        flat = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(-1, _WORD_BYTES)
        words = np.zeros((len(flat), 8), np.uint8)
        words[:, :_WORD_BYTES] = flat
        words = words.view(np.uint64)[:, 0]
        base = (offs[:-1] - offs[0]) // _WORD_BYTES
        _, once = np.unique(np.stack([h, key, crc, loc]), axis=1, return_index=True)  # rows equal in id and text bring the same piece
        once.sort()
        first, more = _starts_of(loc[once])
        per = more + 1
        inside = spread(per)
        owner = np.repeat(once, per)
        starts = base[owner] + inside
        order, common = subtree(words, h[owner], starts, window)
        hit = repeated_leaves(order, common, c[owner].astype(float), window) & (c[owner] == 1)
        at = np.flatnonzero(hit)
        if not len(at):
            return None
        out = (loc[owner[at]] >> 8) + inside[at]
        return pa.RecordBatch.from_arrays([pa.array(key[owner[at]]), pa.array(crc[owner[at]]), pa.array(out << 8)], names=["key", "crc", "loc"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size * 12 < TREE_SUFFIXES:
                continue
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            h = whole.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
            if cut and (out := solve(whole.slice(0, cut))) is not None:
                yield out
            kept, size = [whole.slice(cut)], len(whole) - cut
        if size and (out := solve(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])) is not None:
            yield out

    return trees


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """texts: doc, text, key, crc. key, crc, hits: by text, starts (loc >> 8) to (loc >> 8) + (loc & 255) of repeated windows."""
    # scanned once for the counts and once for the join: reading the texts again costs less than to write and read all their pieces
    found = texts.select(*KEY, "text").mapInArrow(_scan(window), f"h long, sig long, {_PIECE}")
    often = found.groupBy("h").agg(F.count("*").alias("c"), F.min("sig").alias("a"), F.max("sig").alias("b")).where("c > 1").select("h", (F.col("a") != F.col("b")).alias("mixed"))
    # written first, so that the join's exchanges are its own and AQE can split them where a gram is hot
    often = materialize(often, "often")
    shared = materialize(found.join(often, "h"), "pieces")
    release(often)
    equal = shared.where("not mixed").select(*KEY, "loc")
    mixed = shared.where("mixed")
    kinds = materialize(mixed.groupBy("h", "sig").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "loc")).alias("at")), "kinds")
    many = materialize(kinds.where("c > 1").select("h", "sig"), "many")
    copies = mixed.join(bounded_broadcast(many), ["h", "sig"], "left_semi").select(*KEY, "loc")
    hot = materialize(kinds.groupBy("h").count().where(F.col("count") > GROUP_PIECES).select("h", F.lit(True).alias("hot")), "hot", F.count(F.lit(1)).alias("n"))
    any_hot = bool(hot.measured["n"])
    wanted = kinds.select("h", F.least("c", F.lit(2)).alias("c"), "at.*")
    wanted = wanted.join(bounded_broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else wanted.withColumn("hot", F.lit(False))
    # one row, of the least id, speaks for equal texts; its id is part of the join's key, so that other copies are spread
    carriers = texts.groupBy(*KEY).agg(F.min("doc").alias("carrier"))
    lists = materialize(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("h", "loc", "c", "hot")).alias("need")).join(carriers, KEY), "lists")
    on = [F.col(f"t.{k}") == F.col(f"l.{k}") for k in KEY] + [F.col("t.doc").eqNullSafe(F.col("l.carrier"))]
    joined = texts.alias("t").join(lists.alias("l").hint("shuffle_hash"), on).select(*[f"t.{k}" for k in KEY], "t.text", "l.need")
    bodies = joined.mapInArrow(_extract(window), f"h long, {_PIECE}, c long, body binary, wh long")
    tables = [shared, kinds, many, hot, lists]
    if any_hot:
        bodies = materialize(bodies, "bodies")
        tables.append(bodies)
    deep = bodies.where("body is not null").repartition("h").sortWithinPartitions("h").select("h", *KEY, "loc", "c", "body").mapInArrow(_trees(window), _PIECE)
    out = equal.union(copies).union(deep)
    if any_hot:
        longest = bodies.where("body is null").select("h", "wh", *KEY, "loc", "c").distinct()
        again = materialize(longest.groupBy("h", "wh").agg(F.sum("c").alias("n")).where("n > 1").select("h", "wh"), "again")
        tables.append(again)
        out = out.union(longest.where("c = 1").join(bounded_broadcast(again), ["h", "wh"], "left_semi").select(*KEY, "loc"))
    hits = materialize(out.distinct().groupBy(*KEY).agg(F.collect_list("loc").alias("hits")), "hits")
    release(*tables)
    return hits


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column(1))
            hits = batch.column(2)
            for i, j in chunks(offs):
                part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ws, we, bounds = word_bounds(part, po)
                lists = hits.slice(i, j - i)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                first, more = _starts_of(flat)
                first = first + np.repeat(bounds[:-1], counts)
                delta = np.zeros(len(ws) + 1, np.int64)
                np.add.at(delta, first, 1)
                np.add.at(delta, first + more + window, -1)
                gone = np.cumsum(delta[:-1]) > 0
                n_words = np.diff(bounds)
                removed = np.append(0, np.cumsum(gone))
                n_removed = removed[bounds[1:]] - removed[bounds[:-1]]
                # kept words joined by one space: each kept word with the space after it, last space cut off
                keep = np.flatnonzero(~gone)
                lens = we[keep] - ws[keep]
                out = np.full(int(lens.sum()) + len(keep), 0x20, np.uint8)
                to = np.cumsum(lens + 1) - lens - 1
                inner = spread(lens)
                out[np.repeat(to, lens) + inner] = part[np.repeat(ws[keep], lens) + inner]
                kept_before = np.append(0, np.cumsum(~gone))[bounds]
                ends = np.append(to, len(out))
                cuts_from, cuts_to = ends[kept_before[:-1]], ends[kept_before[1:]]
                raw = out.tobytes()
                texts = [raw[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(cuts_from, cuts_to, strict=True)]
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                run_start, run_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans = [[] for _ in range(j - i)]
                if len(run_start):
                    rows = np.searchsorted(bounds, run_start, "right") - 1
                    for r, a, b in zip(rows, run_start, run_end, strict=True):
                        while a < b:  # a run may go on into the next row
                            stop = min(b, bounds[r + 1])
                            if a < stop:
                                spans[r].append({"start": int(a - bounds[r]), "end": int(stop - bounds[r])})
                            a, r = stop, r + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.string())],
                    names=["doc", "n_words", "n_removed", "removed_spans", "kept_text"],
                )

    return cut


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, removed_spans (word positions, end exclusive), kept_text (kept words joined by one space): one row per input row.

    A word goes if a window of `window` words over it occurs anywhere else, in any row or at another place of its own.
    Null texts count as empty; texts under `window` words lose nothing; repeated rows count as copies of each other; null
    and repeated ids are allowed; texts of any length are read whole; other columns, whatever their names, are left out. An
    empty table gives an empty result.
    """
    if not GRAM <= window <= 128:
        raise ValueError(f"window must be {GRAM} to 128 words")
    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("doc"), body.alias("text"), text_key(body).alias("key"), (F.crc32(body) - F.lit(1 << 31)).cast("int").alias("crc"))
    joined = texts.join(repeated_windows(texts, window).hint("shuffle_hash"), KEY, "left").select("doc", "text", "hits")
    out = joined.mapInArrow(_cut(window), f"doc {kind}, n_words long, n_removed long, removed_spans array<struct<start: long, end: long>>, kept_text string")
    return out.withColumnRenamed("doc", id_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
n AS (SELECT row, list(id ORDER BY k) AS w FROM (SELECT row, k, dense_rank() OVER (ORDER BY word) AS id FROM p) GROUP BY row),
g AS (SELECT row, i, w[i:i + 34] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM n WHERE len(w) >= 35)),
m AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
x AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS k FROM g JOIN m USING (g)),
k AS (SELECT row, count(x.k) AS gone, string_agg(word, ' ' ORDER BY p.k) FILTER (x.k IS NULL) AS kept FROM p LEFT JOIN x USING (row, k) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)
"""
