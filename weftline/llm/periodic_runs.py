"""Periodic runs of words (13): longest previous factors, their blocks, extensions at block borders, and copies.

A run is a stretch of words with smallest period q, at least LEAST_REPEATS * q (and LEAST_WORDS) long, that no neighbouring word extends.
The words of the texts of a chunk are ranked by prefix doubling (each text has symbols of its own, so that none matches another);
the rank tables give the suffix array and longest common extensions of any two places, forward and back. With the next smaller
places before and after it in suffix order, each place gets its longest previous factor and where that stands, and from these
the text's blocks: each is a word not seen before, or as long a factor as stands earlier too.

A run that reaches a border of blocks is found there: one side of the border has at least two of its periods. To the right
these lie in the block (period up to half its length), and to the left a run can't reach a period beyond the block before, as
that block would then have been longer; so the periods to try at all borders are fewer than 1.5 times the words. A run within a
block stands at the block's source too, and is copied from there, text by text and block by block, from buckets by start.

A map: no exchange, texts on their own, memory for a chunk (a longer text is one chunk) of some 100 bytes a word.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, bounded_batches, chunks, crc_sql, spread, strings, text_or_empty

LEAST_WORDS, LEAST_REPEATS = 6, 4
Runs = list[tuple[int, int, int]]


def doubling_ranks(symbols: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: of the 2**k symbols from i on (fewer at the end, stop[i], of i's text) among all, equal where they are equal; the last table has no ties. Each has -1 behind its end."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.append(True, symbols[order][1:] != symbols[order][:-1]) if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tables, width = [rank], 1
    live = order[~(head & np.append(head[1:], True))] if n else order
    while len(live):
        rank = rank.copy()
        then = live + width
        second = np.where(then < stop[live], rank[np.minimum(then, n)].astype(np.int64) + 1, 0)
        both = rank[live].astype(np.int64) * (n + 1) + second
        by = np.argsort(both, kind="stable")
        live, both = live[by], both[by]
        old = rank[live]
        place = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        head = np.append(True, both[1:] != both[:-1])
        rank[live] = old + (np.maximum.accumulate(np.where(head, place, 0)) - group)
        live = live[~(head & np.append(head[1:], True))]
        tables.append(rank)
        width *= 2
    return tables


def extend(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from places i and j on are equal."""
    n, i, j = len(tables[0]) - 1, i.copy(), j.copy()
    first = i.copy()
    for k in range(len(tables) - 1, -1, -1):
        same = (tables[k][i] == tables[k][j]) & (i < n) & (j < n)
        i[same] += 1 << k
        j[same] += 1 << k
    return i - first


def extend_back(tables: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before places i and j are equal; i < j."""
    i, j = i.copy(), j.copy()
    first = i.copy()
    for k in range(len(tables) - 1, -1, -1):
        low, high = i - (1 << k), j - (1 << k)
        same = (low >= 0) & (tables[k][np.maximum(low, 0)] == tables[k][np.maximum(high, 0)])
        i[same], j[same] = low[same], high[same]
    return first - i


def _smaller_before(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each within its group (groups start at head), or -1: pointers past larger values are followed side by side."""
    at = np.arange(len(values)) - 1
    at[head] = -1
    live = np.flatnonzero(at >= 0)
    while len(live):
        live = live[values[at[live]] > values[live]]
        at[live] = at[at[live]]
        live = live[at[live] >= 0]
    return at


def previous_factors(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Length and place of the longest factor at each place that also begins earlier (0 and -1 for none)."""
    n = len(tables[0]) - 1
    suffixes = np.empty(n, np.int64)
    suffixes[tables[-1][:n]] = np.arange(n)
    symbol = tables[0][suffixes]
    head = np.append(True, symbol[1:] != symbol[:-1]) if n else np.zeros(0, bool)
    tail = np.append(head[1:], True) if n else head
    length, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (_smaller_before(suffixes, head), n - 1 - _smaller_before(suffixes[::-1], tail[::-1])[::-1]):
        has = np.flatnonzero((near >= 0) & (near < n))
        here, there = suffixes[has], suffixes[near[has]]
        found = extend(tables, here, there)
        more = found > length[here]
        length[here[more]], place[here[more]] = found[more], there[more]
    return length, place


def _at_borders(tables: list[np.ndarray], starts: np.ndarray, lens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs that reach a border of blocks; first: which blocks begin a text. The smallest period of each stretch."""
    word, n = tables[0], len(tables[0]) - 1
    half = np.where(first, 0, lens // 2)
    at, p = np.repeat(starts, half), spread(half) + 1
    fits = word[at] == word[np.minimum(at + p, n)]
    at, p = at[fits], p[fits]
    right = at - extend_back(tables, at, at + p), at + p + extend(tables, at, at + p), p
    before = np.maximum(lens - 1, 0)  # borders at the ends of blocks, those of texts too
    at, p = np.repeat(starts + lens, before), spread(before) + 1
    fits = word[at - 1] == word[at - 1 - p]
    at, p = at[fits], p[fits]
    left = at - p - extend_back(tables, at - p, at), at + extend(tables, at - p, at), p
    start, end, period = (np.concatenate(x) for x in zip(right, left, strict=True))
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_REPEATS * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    return start[new], end[new], period[new]


def _copied(found: Runs, blocks: list[tuple[int, int, int]]) -> Runs:
    """found (start, end, period) and the copies of runs that lie within a block's source, without touching its ends; blocks: start, length, source."""
    bucket: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for s, e, p in found:
        bucket[s].add((e, p))
    order = sorted(bucket)
    for start, length, source in blocks:
        k = bisect_right(order, source)
        while k < len(order) and order[k] + LEAST_WORDS < source + length:
            for e, p in tuple(bucket[order[k]]):
                if e < source + length:
                    s = order[k] + start - source
                    if s not in bucket:
                        insort(order, s)
                    bucket[s].add((e + start - source, p))
            k += 1
    return [(s, e, p) for s in order for e, p in sorted(bucket[s], key=lambda x: x[1])]


def find_runs(texts: list[list[bytes]]) -> list[Runs]:
    """(start, length, period) of each text's runs, by start, then period; texts are lists of words."""
    n_words = np.array([len(t) for t in texts], np.int64)
    bounds = np.append(0, np.cumsum(n_words))
    parts, base = [], 0
    for t in texts:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        parts.append(np.fromiter(map(number.__getitem__, t), np.int64, len(t)) + base)
        base += len(number)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    tables = doubling_ranks(symbols, np.repeat(bounds[1:], n_words))
    length, place = previous_factors(tables)
    follow, starts, i = (np.arange(len(symbols)) + np.maximum(length, 1)).tolist(), [], 0
    while i < len(follow):
        starts.append(i)
        i = follow[i]
    starts = np.array(starts, np.int64)
    lens = np.diff(np.append(starts, len(symbols)))
    start, end, period = _at_borders(tables, starts, lens, np.isin(starts, bounds))
    text_of = np.searchsorted(bounds, start, "right") - 1
    out: list[Runs] = [[] for _ in texts]
    for i in np.unique(text_of).tolist():
        lo, hi = np.searchsorted(starts, bounds[i : i + 2])
        inner = lo + np.flatnonzero(lens[lo:hi] >= LEAST_WORDS + 2)
        mine = slice(*np.searchsorted(text_of, [i, i + 1]))
        runs = _copied(list(zip(start[mine].tolist(), end[mine].tolist(), period[mine].tolist(), strict=True)), list(zip(starts[inner].tolist(), lens[inner].tolist(), place[starts[inner]].tolist(), strict=True)))
        out[i] = [(s - int(bounds[i]), e - s, p) for s, e, p in runs]
    return out


def collapse(words: list[bytes], runs: Runs) -> bytes:
    """The words, joined by one space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(change).tolist(), strict=False) if not d])


_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: Column | str = "text", out_col: str = "periodic") -> DataFrame:
    """docs with out_col (replaced if it is there): a struct of n_words, runs (start, length, period; by start, then period) and collapsed, the text's words without the repeats.

    Words are what stands between ASCII white space. A null or empty text has no words; texts of any length are searched
    whole, all runs are given. All rows and columns stay as they are, repeated ones too; an empty table gives an empty result.
    """
    bounded_batches(docs)

    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def search(column: pa.Array) -> pa.Array:
        data, offs = strings(column)
        counts, runs, collapsed = [], [], []
        for i, j in chunks(offs):
            words = [data[a:b].tobytes().split() for a, b in pairwise(offs[i : j + 1].tolist())]
            found = find_runs(words)
            counts += map(len, words)
            runs += found
            collapsed += [collapse(w, r).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]
        flat = np.array([r for one in runs for r in one], np.int64).reshape(-1, 3)
        cuts = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_TYPE)))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.string())], names=["n_words", "runs", "collapsed"])

    body = text_or_empty(text) if isinstance(text, str) else F.coalesce(text.cast("string"), F.lit(""))
    return docs.withColumn(out_col, search(body))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, then that of the least period. Null for none."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(better(a, r), r).otherwise(a))


def words_of(text: Column) -> Column:
    """The text's words, an array."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_period(words: Column, start: Column, period: Column) -> Column:
    """words, an array, as a text; from place start on the period words that stand there are repeated to the end."""
    n = F.size(words)
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), start), again), F.lit(1), n), " ")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of docs; a tenth of the texts, told by the checksum of the id, repeats a stretch of words to its end (a null id: never)."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    return rows.select(id_col, F.when(F.col("a").isNotNull(), with_period(F.col("words"), F.col("a"), F.col("p"))).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame, id_col: str = "doc_id", col: str = "periodic") -> DataFrame:
    """id, n_runs, the most repeated run's start, length, period and exponent_milli, and digests of all runs and of the collapsed text."""
    runs = F.col(col)["runs"]
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select(id_col, F.size(runs).cast("long").alias("n_runs"), most_repeated(runs).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col(col)["collapsed"], 256).alias("collapsed_sha256"))
    return best.select(id_col, "n_runs", "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Runs as stretches in which groups of five words stand again at one distance; a run's equal stretch has five words at least.
ORACLE = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {crc_sql("doc_id")} AS h FROM documents, t),
l AS (SELECT r, doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
a AS (SELECT *, CAST(len(words) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN g % len(words) END AS a FROM l),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
i AS (SELECT *, unnest(range(n)) AS i FROM p),
w AS (SELECT r, n, i, words[CAST(1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS BIGINT)] AS w FROM i),
g AS (SELECT r, n, i, w, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram, i + 5 <= n AS whole FROM w),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.gram = y.gram AND x.whole AND y.whole AND y.i > x.i),
o AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
s AS (SELECT r, min(i) AS start, max(i) + 5 - min(i) + q AS length, q FROM o GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
best AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS body FROM (SELECT w.r, w.i, w.w FROM w ANTI JOIN dropped ON dropped.r = w.r AND dropped.i = w.i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
