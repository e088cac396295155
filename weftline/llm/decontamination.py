"""Benchmark decontamination (4): a broadcast hash set of benchmark word windows, scanned against every document window.

DataFrame functions only. One pass generates the word positions of a document inside whole-stage codegen and probes each
position's next few words against the broadcast set of the windows' leads; where a lead fits, the windows that start there
are hashed and probed against the broadcast windows, and the words themselves are compared. Hits are kept per distinct text
(hash, checksum, length), so copies share them, and meet the documents again by that key.

A benchmark whose windows don't fit a broadcast meets the documents' windows by a shuffle of narrow rows (text key, position,
hash); the words that verify a hit are fetched afterwards, by text. Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, bounded_broadcast, fits_broadcast, materialize, packed, text_or_empty, unpacked

#: Words of a window that are probed first.
LEAD = 3
#: Bytes that part words once A-Z are lower-cased: all of ASCII but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2", "k3"]


def words_of(text: Column) -> Column:
    """Normalised words, in order. Pure ASCII takes the fast lower()."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAKS), "")


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.crc32(text).alias("k2"), F.octet_length(text).alias("k3")]


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """len, words, hash, items: each distinct window with the items that hold it; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    first = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    cut = first.select("item", F.slice("w", F.col("i"), window).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))
    return cut.select(F.size("words").alias("len"), "words", F.xxhash64("words").alias("hash"), "items")


def _lead(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, at + k) for k in range(n)])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """k1, k2, k3 (a text's key), pos (0-based word), len, items: each benchmark window in each distinct text."""
    grams = materialize(benchmark_windows(benchmark, window, item_col), "windows")
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # window values at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, k3 int, pos int, len int, items array<string>")
    body = text_or_empty(text_col)
    texts = docs.select(*_keys(body), words_of(body).alias("w"))
    every = texts.where(F.size("w") >= lengths[0]).select(*KEY, "w", F.explode(F.sequence(F.lit(0), F.size("w") - lengths[0])).alias("pos"))
    room = F.size("w") - F.col("pos")
    all_lengths = F.array(*[F.lit(n) for n in lengths])
    if not fits_broadcast(grams, rows, size):
        narrow = every.select(*KEY, "w", "pos", F.explode(all_lengths).alias("len")).where(room >= F.col("len"))
        narrow = narrow.select(*KEY, "pos", "len", F.xxhash64(F.slice("w", F.col("pos") + 1, F.col("len"))).alias("hash"))
        met = narrow.distinct().join(grams.select("hash", "len", "words", "items"), ["hash", "len"])
        found = materialize(met.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "len", "words", "items")).alias("same")), "candidates")
        hit = texts.join(bounded_broadcast(found), KEY).select(*KEY, "w", F.explode("same").alias("s")).where(F.slice("w", F.col("s.pos") + 1, F.col("s.len")) == F.col("s.words"))
        return hit.select(*KEY, "s.pos", "s.len", "s.items").distinct()
    probe = every
    wide = F.lit(False)
    open_ = []
    for n in sorted({min(n, LEAD) for n in lengths}):
        leads = grams.where(F.least("len", F.lit(LEAD)) == n).select(F.xxhash64(F.lit(n), *[F.col("words")[k] for k in range(n)]).alias(f"lead{n}")).distinct().withColumn(f"on{n}", F.lit(True))
        probe = probe.withColumn(f"lead{n}", _lead(F.col("w"), F.col("pos"), n)).join(F.broadcast(leads), f"lead{n}", "left")  # no more rows than grams, which fit
        wide = wide | F.col(f"on{n}").isNotNull()
        open_.append((n, F.col(f"on{n}").isNotNull()))
    fits = F.filter(all_lengths, lambda n: (n <= room) & F.coalesce(*[F.when(F.least(n, F.lit(LEAD)) == k, on) for k, on in open_]))
    some = probe.where(wide).select(*KEY, "w", "pos", F.explode(fits).alias("len"))
    hashed = some.withColumn("hash", F.xxhash64(F.slice("w", F.col("pos") + 1, F.col("len"))))
    side = grams.groupBy("hash").agg(F.collect_list(F.struct("words", "len", "items")).alias("same"))
    hit = hashed.join(F.broadcast(side), "hash").select(*KEY, "pos", "len", F.slice("w", F.col("pos") + 1, F.col("len")).alias("own"), F.explode("same").alias("s"))
    return hit.where((F.col("s.len") == F.col("len")) & (F.col("own") == F.col("s.words"))).select(*KEY, "pos", "len", "s.items").distinct()


def hit_lists(hits: DataFrame) -> DataFrame:
    """One row per text with hits: spans (ascending, disjoint, end exclusive), n_hit, items (sorted as strings)."""
    hits = materialize(hits, "places")
    ends = hits.groupBy(*KEY, "pos").agg(F.max(F.col("pos") + F.col("len")).alias("end"))
    so_far = Window.partitionBy(*KEY).orderBy("pos")
    reach = F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ends.withColumn("fresh", F.when(reach >= F.col("pos"), 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy(*KEY, "run").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    items = hits.select(*KEY, F.explode("items").alias("item")).distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return spans.join(items, KEY, "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items, spans, contaminated (n_hit > 0 and share * n_hit >= n_words): one row per document.

    Null texts and null items have no words; a null item id is never listed; repeated rows and ids are judged each; texts
    of any length are scanned whole; other columns are left out; empty tables give empty results.
    """
    lists = materialize(hit_lists(find_hits(docs, benchmark, window, text_col, item_col)), "hits")
    body = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("_id"), *_keys(body), F.size(words_of(body)).cast("long").alias("n_words"))
    out = base.join(bounded_broadcast(lists), KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "spans", ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def _beside(docs: DataFrame, lists: DataFrame, text_col: str) -> DataFrame:
    """docs packed, their text as _body, and the columns of lists (materialised) where the text is in there."""
    body = text_or_empty(text_col)
    own = packed(docs, *[c.alias(f"_o{i}") for i, c in enumerate(_keys(body))], body.alias("_body"))
    side = bounded_broadcast(lists.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(KEY)], *[c for c in lists.columns if c not in KEY]))
    return own.join(side, [F.col(f"_o{i}") == F.col(f"_k{i}") for i in range(len(KEY))], "left")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the contaminated documents (see judge), all columns kept, whatever their names.

    A null or empty text has no words and stays; repeated rows stay or go together; empty tables on either side drop nothing.
    """
    lists = materialize(hit_lists(find_hits(docs, benchmark, window, text_col, item_col)).select(*KEY, "n_hit"), "hits")
    joined = _beside(docs, lists, text_col)
    return unpacked(joined.where(F.col("n_hit").isNull() | (F.col("n_hit") * share < F.size(words_of(F.col("_body"))))), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs whose text lost its hit words: texts with hits come back as their other normalised words joined by a space, the rest as they are.

    What is left is not searched again: words that come to stand side by side may make a window anew. Null texts stay null;
    repeated rows are treated alike; all columns are kept, whatever their names; empty tables on either side change nothing.
    """
    lists = materialize(hit_lists(find_hits(docs, benchmark, window, text_col, item_col)).select(*KEY, "spans"), "hits")
    joined = _beside(docs, lists, text_col)
    kept = F.array_join(F.filter(words_of(F.col("_body")), lambda w, i: ~F.exists(F.col("spans"), lambda s: (i >= s["start"]) & (i < s["end"]))), " ")
    return joined.select(*[(F.when(F.col("spans").isNull(), F.col("_row").getField(c)).otherwise(kept) if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 13) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM g),
p AS (SELECT row, i, n, w[i:i + n - 1] AS g FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT row, item_id, i, n FROM p JOIN g USING (g)),
c AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""
