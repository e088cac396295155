"""Seeded samples, allocations and mixtures, fixed-size chunks, greedy candidates.

Samples rank rows by sha1 of seed, key and id: the same rows for the same seed, whatever the partitioning. Where a key's
sample may be large, no task sorts the key: counts per bin of the draws say in which bin the sample ends, bins below are
taken whole, and only that bin is put in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nonblank, normalize_space, pack_sentences, speaks
from ..storage import bounded_broadcast, written

#: Bins of a key's draws: the first three digits of their hashes.
BIN_DIGITS = 3


def draw(seed: int, *parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sample_keep_order(df: DataFrame, n: int | None, seed: int, id_col: str, order: str = "_ord") -> DataFrame:
    """n rows in their order; None, 0 or too many give all."""
    if not n:
        return df.orderBy(order)
    return df.withColumn("_draw", draw(seed, F.col(id_col))).orderBy("_draw", order).limit(n).drop("_draw").orderBy(order)


def sample_per_key(df: DataFrame, n: int | None, seed: int, keys: Sequence[str], id_col: str) -> DataFrame:
    """n rows of each key (WindowGroupLimit cuts each partition before the exchange); None or 0 give all."""
    if not n:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", id_col))
    return df.withColumn("_draw", draw(seed, *[F.col(k) for k in keys], F.col(id_col))).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_draw", "_rank")


def least_draws(rows: DataFrame, limits: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """rows (with _draw) of the keys in limits (keys, _limit): each key's _limit least draws, ties by id; all for a null limit."""
    binned = rows.withColumn("_bin", F.conv(F.substring("_draw", 1, BIN_DIGITS), 16, 10).cast("int"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = counts.withColumn("_upto", upto).join(bounded_broadcast(limits.where("_limit is not null")), list(keys))
    ends = run.where(F.col("_upto") > F.col("_limit")).groupBy(*keys).agg(F.min_by(F.struct("_bin", (F.col("_limit") - F.col("_upto") + F.col("_n")).alias("_left")), "_bin").alias("_end"))
    cut = written(limits.select(*keys).join(ends, list(keys), "left"), "sample-cuts")
    marked = binned.join(bounded_broadcast(cut), list(keys))
    whole = marked.where(F.col("_end").isNull() | (F.col("_bin") < F.col("_end._bin")))
    last = marked.where((F.col("_bin") == F.col("_end._bin")) & (F.col("_end._left") > 0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", id_col))
    some = last.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_end._left")).drop("_rank")
    return whole.unionByName(some).drop("_bin", "_end", "_draw")


def sample_lines(df: DataFrame, n: int | None, seed: int, id_col: str) -> DataFrame:
    """n rows in drawn order; None, negative or too many give all, shuffled; 0 gives none."""
    if n == 0:
        return df.limit(0)
    drawn = df.withColumn("_draw", draw(seed, F.col(id_col))).orderBy("_draw", id_col)
    return (drawn if n is None or n < 0 else drawn.limit(n)).drop("_draw")


def shuffle(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """All rows in drawn order: a range exchange, no single task."""
    return df.withColumn("_draw", draw(seed, F.col(id_col))).orderBy("_draw", id_col).drop("_draw")


def allocate(lengths: Sequence[int], weights: Sequence[float], total: int) -> list[int]:
    """Counts in proportion to weights, none above its length, that come to total (or to all there is).

    Floors first; while they exceed total the largest gives one up; while they fall short, rounds of one more for each that
    has room. Whole rounds are added at once, so this takes no loop over total.
    """
    if len(lengths) != len(weights):
        raise ValueError("a weight for each length is needed")
    if total <= 0:
        raise ValueError("total must be positive")
    if sum(weights) <= 0:
        raise ValueError("weights must come to more than 0")
    share = [w / sum(weights) for w in weights]
    counts = [min(n, max(0, int(total * s))) for n, s in zip(lengths, share, strict=True)]
    while sum(counts) > total and max(counts) > 0:
        counts[counts.index(max(counts))] -= 1
    while (short := total - sum(counts)) > 0 and (open_ := [i for i, n in enumerate(lengths) if counts[i] < n]):
        step = min(short // len(open_), min(lengths[i] - counts[i] for i in open_))
        for i in open_ if step else open_[:short]:
            counts[i] += max(step, 1)
    return counts


def weighted_mixture(pools: DataFrame, weights: Mapping[str, float], total: int, seed: int, pool_col: str, id_col: str) -> DataFrame:
    """Rows of named pools in proportion to weights, total in all (allocate), in drawn order. Pools are counted once."""
    known = {r[0]: r[1] for r in pools.where(F.col(pool_col).isin(*weights)).groupBy(pool_col).count().collect()}
    order = list(weights)
    counts = dict(zip(order, allocate([known.get(p, 0) for p in order], [weights[p] for p in order], total), strict=True))
    limits = pools.sparkSession.createDataFrame([(p, counts[p]) for p in order], f"`{pool_col}` string, _limit long")
    drawn = pools.where(F.col(pool_col).isin(*order)).withColumn("_draw", draw(seed, F.col(pool_col), F.col(id_col)))
    return shuffle(least_draws(drawn, limits, [pool_col], id_col), seed + 1, id_col)


def direction_mixture(rows: DataFrame, configs: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Rows (src_lang, tgt_lang, source, …) up to each direction's and source's limit.

    configs: src_lang, tgt_lang, source, enabled, limit (null or negative: all; 0: none). Disabled sources give nothing.
    """
    keys = ["src_lang", "tgt_lang", "source"]
    active = configs.where(F.coalesce("enabled", F.lit(True)) & (F.col("limit").isNull() | (F.col("limit") != 0)))
    limits = active.select(*keys, F.when(F.col("limit") > 0, F.col("limit")).cast("long").alias("_limit"))
    drawn = rows.withColumn("_draw", draw(seed, *[F.col(k) for k in keys], F.col(id_col)))
    return least_draws(drawn, limits, keys, id_col).select(*rows.columns)


def mixture_manifest(mixed: DataFrame, configs: DataFrame) -> DataFrame:
    """src_lang, tgt_lang, num_rows and source_counts (configured sources without rows count 0)."""
    counts = mixed.groupBy("src_lang", "tgt_lang", "source").agg(F.count("*").alias("n"))
    every = configs.select("src_lang", "tgt_lang", "source").distinct().join(counts, ["src_lang", "tgt_lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    entries = F.array_sort(F.collect_list(F.struct("source", "n")))
    return every.groupBy("src_lang", "tgt_lang").agg(F.sum("n").alias("num_rows"), F.map_from_entries(entries).alias("source_counts"))


def numbered(rows: DataFrame, keys: Sequence[str], order: str = "_ord") -> DataFrame:
    """rows with _n, their number (from 0) within their key by order.

    A range exchange on keys and order, so that a large key lies in many partitions; numbers within a partition are set off by
    the counts of the partitions before. Null keys are keys like others.
    """
    placed = rows.repartitionByRange(*[F.col(k) for k in keys], F.col(order)).sortWithinPartitions(*keys, order).withColumn("_at", F.monotonically_increasing_id())
    local = written(placed.withColumn("_part", F.shiftright("_at", 33).cast("int")), "numbered")
    runs = local.groupBy(*keys, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_off"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(bounded_broadcast(runs), same).withColumn("_n", F.col("_at") + F.col("_off")).select(*rows.columns, "_n")


def chunked(rows: DataFrame, size: int, keys: Sequence[str], order: str = "_ord") -> DataFrame:
    """keys, chunk, src_lines, tgt_lines, n: size consecutive rows (input, output) of a key, the last chunk as it comes."""
    parts = numbered(rows, keys, order).withColumn("chunk", F.floor(F.col("_n") / size).cast("long")).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "input", "output"))).alias("r"))
    return parts.select(*keys, "chunk", F.col("r.input").alias("src_lines"), F.col("r.output").alias("tgt_lines"), F.size("r").cast("long").alias("n"))


def permuted(lines: Column, seed: int, key: Column) -> Column:
    """The lines in a drawn order that isn't their own; null for fewer than two."""
    indexed = F.transform(lines, lambda x, i: F.struct(draw(seed, key, i).alias("d"), i.alias("i"), x.alias("x")))
    drawn = F.array_sort(indexed)
    same = F.forall(F.transform(drawn, lambda s, i: s["i"] == i), lambda b: b)
    turned = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), F.slice(lines, 1, 1))
    return F.when(F.size(lines) >= 2, F.when(same, turned).otherwise(F.transform(drawn, lambda s: s["x"])))


def draft_refine(chunks: DataFrame, instruction: str, draft: Column) -> DataFrame:
    """Alpaca rows from chunks: source paragraph and draft in the input, the true paragraph as output; without a draft a chunk goes."""
    made = chunks.withColumn("_draft", draft).where("_draft is not null")
    text = F.concat(F.lit("Source paragraph:\n"), F.array_join("src_lines", "\n"), F.lit("\n\nInitial translation:\n"), F.array_join("_draft", "\n"), F.lit("\n"))
    return made.select(*[c for c in chunks.columns if c not in ("src_lines", "tgt_lines", "n")], F.lit(instruction).alias("instruction"), text.alias("input"), F.array_join("tgt_lines", "\n").alias("output"))


def candidates(docs: DataFrame, lang: Column, min_chars: int = 20, max_chars: int = 600, order: str = "_ord", check_script: bool = True) -> DataFrame:
    """_ord, lang, pos, text, hash: the pieces of each document that are long enough and in their language's script, in order."""
    pieces = docs.select(F.col(order).alias("_ord"), lang.alias("lang"), F.posexplode(pack_sentences(F.col("text"), max_chars)).alias("pos", "text"))
    good = pieces.where(F.length("text") >= min_chars)
    if check_script:
        good = good.where(speaks(F.col("text"), F.col("lang")))
    return good.withColumn("hash", F.sha1("text"))


#: Candidates that one task of greedy_sources puts in order.
RANGE_ROWS = 200_000


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows lang, _at, pos, hash, taken (in order): the first of each lang and _at that isn't taken, by earlier ones here neither."""
    mine: set[tuple[str, str]] = set()
    last = None
    for batch in batches:
        keep = []
        for i, (lang, order, hash_, taken) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "_at", "hash", "taken")), strict=True)):
            if not taken and (lang, order) != last and (lang, hash_) not in mine:
                mine.add((lang, hash_))
                last = lang, order
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def greedy_sources(found: DataFrame, range_rows: int | None = None, rounds: list[int] | None = None) -> DataFrame:
    """greedy_choices with their texts."""
    return with_texts(*greedy_choices(found, range_rows, rounds))


def with_texts(pieces: DataFrame, choices: DataFrame) -> DataFrame:
    """lang, _ord, pos, hash, text of choices. Pieces of a document that stands there twice may be the same; one is given."""
    return pieces.join(choices, ["lang", "_ord", "pos", "hash"], "left_semi").dropDuplicates(["lang", "_ord"])


def greedy_choices(found: DataFrame, range_rows: int | None = None, rounds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pieces, and those chosen (lang, _ord, pos, hash): at most one candidate a document, no hash twice in a language, as a pass in order would choose. rounds: gets what each round worked out anew.

    A document whose first candidate no other has is settled at once, and of the others only the candidates up to the first
    that is theirs alone matter. These fall into ranges of documents, in order; a task passes over a range. Then each range's
    choices are held against those of the ranges before: where an earlier range has taken, or no longer takes, one of its
    candidates, it is passed over again. With nothing to change, each range has seen what the ones before it take, so all is
    as one pass would choose. Long chains of documents that turn each other away lie within a range; rounds are as many as
    such chains cross ranges, never more than there are ranges, and each works on the ranges that change. Texts are written where
    they are made, and move once, to the choices.
    """
    pieces = written(found.select("lang", "_ord", "pos", "hash", "text"), "pieces")
    doc, key, slot = ["lang", "_ord"], ["lang", "hash"], F.struct("pos", "hash")
    slots = pieces.select(*doc, "pos", "hash")
    often = written(slots.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.lit(True).alias("shared")), "shared-hashes")
    marked = slots.join(bounded_broadcast(often), key, "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    ends = marked.groupBy(*doc).agg(F.min(slot).alias("first"), F.min(F.when(~F.col("shared"), slot)).alias("own"))
    settled = F.col("first").eqNullSafe(F.col("own"))
    wanted = marked.join(ends, doc).where(F.col("own").isNull() | (slot <= F.col("own"))).select(*doc, "pos", "hash", "shared", settled.alias("settled"))
    marked = written(wanted, "marked", F.count_if(~F.col("settled")).alias("n"))
    ranges = max(1, -(-marked.measured["n"] // (range_rows or RANGE_ROWS)))
    order = [F.col("lang").asc(), F.col("_ord").asc()]
    open_ = marked.where("not settled").drop("settled")
    placed = open_.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    asked = written(placed.withColumn("_at", F.dense_rank().over(Window.partitionBy("part").orderBy(*order))), "asked", F.max("part").alias("last"))
    parts = (asked.measured["last"] or 0) + 1
    fields = f"part int, lang string, _at int, pos {slots.schema['pos'].dataType.simpleString()}, hash string, shared boolean"

    def passed(rows: DataFrame) -> DataFrame:
        """What the ranges of rows choose."""
        inside = rows.select("part", "lang", "_at", "pos", "hash", "shared", "taken").repartition(parts, "part").sortWithinPartitions("part", "_at", "pos", "hash")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, group in _runs(batches, "part"):
                yield from _choose(group)

        return inside.mapInArrow(each, f"{fields}, taken boolean").select("part", "lang", "_at", "pos", "hash", "shared")

    chosen = written(passed(asked.withColumn("taken", F.lit(False))), "chosen")
    against = asked.select("part", *key).limit(0)  # what each range knew to be taken, when it last chose
    log = [parts]
    while parts > 1:
        takers = chosen.where("shared").groupBy(*key).agg(F.min("part").alias("first"))
        now = written(asked.where("shared").select("part", *key).distinct().join(takers, key).where("first < part").select("part", *key), "taken-before")
        changed = now.select("part", *key).exceptAll(against).select("part").union(against.exceptAll(now).select("part")).distinct()
        changed = written(changed, "changed-ranges", F.count(F.lit(1)).alias("n"))
        if not changed.measured["n"]:
            break
        log.append(changed.measured["n"])
        again = asked.join(bounded_broadcast(changed), "part", "left_semi").join(now.withColumn("taken", F.lit(True)), ["part", *key], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        stay = chosen.join(bounded_broadcast(changed), "part", "left_anti")
        chosen, against = written(stay.unionByName(passed(again)), "chosen"), now
    if rounds is not None:
        rounds.extend(log)
    picked = asked.join(chosen.select("part", "_at", "pos", "hash"), ["part", "_at", "pos", "hash"], "left_semi").select(*doc, "pos", "hash")
    choices = marked.where("settled").select(*doc, "pos", "hash").unionByName(picked).dropDuplicates(doc)
    return pieces, written(choices, "choices")


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Stretches of rows of one value of column (rows come ordered by it), each as its batches; a stretch must be used up before the next."""
    rest = iter(batches)
    batch = next(rest, None)
    while batch is not None:
        if not len(batch):
            batch = next(rest, None)
            continue
        value = batch.column(column)[0]

        def stretch() -> Iterator[pa.RecordBatch]:
            nonlocal batch
            while batch is not None:
                own = pc.sum(pc.equal(batch.column(column), value)).as_py() or 0
                if own:
                    yield batch.slice(0, own)
                if own < len(batch):
                    batch = batch.slice(own)
                    return
                batch = next(rest, None)

        yield value.as_py(), stretch()


def fill_quota(sources: DataFrame, done: DataFrame, n: int, keys: Sequence[str] = ("lang",)) -> DataFrame:
    """The first n sources of each key whose hash isn't done yet."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_ord"))
    fresh = sources.join(done.select(F.col("source_hash").alias("hash")), "hash", "left_anti")
    return fresh.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def weighted_union(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables, tagged by part and keeping each part's order; blank lines (value) are dropped."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(i))
        if "value" in part.columns:
            tagged = tagged.where(nonblank(F.col("value")).isNotNull())
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def presence(rows: DataFrame, n: int, least_chars: int, good: Column, shown: int = 5, order: str = "_ord") -> DataFrame:
    """rows_seen, rows_passing, pass_ratio and samples over the first n rows with enough text; samples are cut to 400 characters."""
    seen = rows.withColumn("text", normalize_space(F.col("text"))).where(F.length("text") >= least_chars).orderBy(order).limit(n).withColumn("_good", good)
    first = F.array_sort(F.collect_list(F.when(F.col("_good"), F.struct(F.col(order).alias("o"), F.substring("text", 1, 400).alias("t")))))
    out = seen.agg(F.count("*").alias("rows_seen"), F.count_if("_good").alias("rows_passing"), F.slice(first, 1, shown).alias("s"))
    return out.select("rows_seen", "rows_passing", F.when(F.col("rows_seen") > 0, F.col("rows_passing") / F.col("rows_seen")).otherwise(0.0).alias("pass_ratio"), F.col("s.t").alias("samples"))
