"""Mixing sources to target weights (10): Pareto order sampling after certain whole copies. DataFrame functions only.

Each source gets a target in words: its weight's share of the mix, stopped at `cap` times its size, the excess shared
again by weight until none is above (water filling). A document's expected copies are its
source's target over its size, times its preference. The whole part is certain; the rest is an inclusion probability p,
and documents of a source rank by random odds over inclusion odds, u / (1 - u) : p / (1 - p), ascending. The first ranks
that fill the source's remaining words are taken, and one further document that closes the gap best.

No source is ever sorted as a whole: ranks fall into BINS bins, sums by bin name the bin where the words run out, that bin
is divided again, LEVELS times in all, and only the rows of the last bin are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, packed, release, text_or_empty, unpacked
from .sharding import number_rows

SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
BINS, LEVELS = 256, 3
#: Columns that mix adds.
ADDED = ("_size", "_source_size", "_target", "_copies")
#: Bits of a document's draw: the first of an MD5 of seed, id and text, which SQL engines agree on.
DRAW_BITS = 60


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space: each, with the spaces behind it, becomes one character. No word is cut out as a string."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(SPACES)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], factor: float, cap: float) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds weight and target; sources by code point, null last, take the weights in turn.

    Sources are numbered by a range exchange, and the level to which they are filled is found by sums over them: each round
    gives what the sources that are full leave over to the rest, and only two sums reach the driver. So sources may be many.
    """
    numbered, n = number_rows(sizes.select("source", "source_size"), ["source"], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_number") % len(weights)).cast("int") + 1)
    plan = materialize(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("_full")), "mix-weights")
    budget = float(factor) * (plan.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while n:
        full = F.col("_full") < F.lit(level) * F.col("weight") if closed >= 0 else F.lit(False)
        count, taken, left = plan.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_full"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if count == closed:
            break
        level, closed = ((budget - taken) / left if left else float("inf")), count
    return plan.select("source", "source_size", "weight", F.least(F.lit(level) * F.col("weight"), F.col("_full")).alias("target"))


def _ranked(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Expected copies, their whole part, and the rank statistic (0 to 1, null where nothing is left to chance)."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source")
    expected = F.least(F.lit(float(cap)), F.when(F.col("preferred") > 0, F.col("target") * F.col("pref") / F.col("preferred")).otherwise(F.lit(0.0)))
    whole = F.floor(F.col("_expected") + 1e-9).cast("long")
    chance = F.greatest(F.col("_expected") - F.col("whole"), F.lit(0.0))
    u = (F.shiftright("draw", DRAW_BITS - 52).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (F.col("_chance") / (1 - F.col("_chance")))
    out = joined.withColumn("_expected", expected).withColumn("whole", whole).withColumn("_chance", chance)
    return out.withColumn("rank", F.when((F.col("_chance") > 1e-9) & (F.col("size") > 0), odds / (1 + odds))).drop("_expected", "_chance")


def _crossing(sums: DataFrame, by: str, need: str) -> DataFrame:
    """sums: _source, by, words, need. The first bin of each source at which the running sum reaches need, and the sum before it."""
    run = Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = sums.withColumn("_sum", F.sum("words").over(run)).where(F.col("_sum") >= F.col(need))
    first = total.groupBy("_source").agg(F.min_by(F.struct(F.col(by), (F.col(need) - F.col("_sum") + F.col("words")).alias("left")), by).alias("x"))
    return first.select("_source", f"x.{by}", F.col("x.left").alias("left"))


def cuts(base: DataFrame, weights: Sequence[float], factor: float, cap: float) -> DataFrame:
    """One row a source: target, preferred words, the rank below which a document gets one copy more, and the draw of one further document."""
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("pref")).alias("preferred"))
    sizes = materialize(sums, "mix-sizes")
    plan = targets(sizes.select("source", "source_size"), weights, factor, cap).withColumnRenamed("source", "_source")
    plan = plan.join(sizes.select(F.col("source").alias("_s"), "preferred"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = materialize(plan.withColumn("_null", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit(""))), "mix-plan")
    side = bounded_broadcast(plan.select("_source", "target", "preferred"))
    # a source's key from here on is a struct, so that null compares as a value
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    rows = materialize(_ranked(base, side, cap).select(key.alias("_source"), "size", "draw", "whole", "rank", "target"), "mix-ranked")
    need = materialize(rows.groupBy("_source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("need")), "mix-need")
    need = bounded_broadcast(need)
    chance = rows.where("rank is not null")
    # the bin in which the words run out, that bin's bins, and so on: each level reads what the one before left
    rest, left = chance.withColumns({"_at": F.col("rank"), "_from": F.lit(0.0)}), need
    for level in range(1, LEVELS + 1):
        rest = rest.withColumn("_bin", F.floor(F.col("_at") * BINS).cast("int"))
        sums = rest.groupBy("_source", "_bin").agg(F.sum("size").alias("words")).join(left, "_source")
        cut = bounded_broadcast(materialize(_crossing(sums, "_bin", "need"), f"mix-cut{level}"))
        rest = rest.join(cut.select("_source", "_bin"), ["_source", "_bin"])
        rest = rest.withColumns({"_at": F.col("_at") * BINS - F.col("_bin"), "_from": F.col("_from") + F.col("_bin") / F.lit(float(BINS**level))}).drop("_bin")
        left = cut.select("_source", F.col("left").alias("need"))
    # of the last bin, rows that are drawn together as one
    last = rest.groupBy("_source", "rank", "draw", "_from").agg(F.sum("size").alias("words")).join(left, "_source")
    last = last.withColumn("_sum", F.sum("words").over(Window.partitionBy("_source").orderBy("rank", "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = last.groupBy("_source").agg(F.coalesce(F.min(F.when(F.col("_sum") > F.col("need"), F.col("rank"))), F.first("_from") + 1 / float(BINS**LEVELS)).alias("cut"))
    limit = need.join(over, "_source", "left").select("_source", "need", F.when(F.col("need") <= 0, F.lit(0.0)).otherwise(F.coalesce("cut", F.lit(2.0))).alias("cut"))
    limit = materialize(limit, "mix-limit")
    near = chance.join(bounded_broadcast(limit), "_source")
    below = near.groupBy("_source").agg(F.first("need").alias("need"), F.sum(F.when(F.col("rank") < F.col("cut"), F.col("size")).otherwise(0)).alias("got"))
    gap = materialize(below.select("_source", (F.col("need") - F.col("got")).alias("gap")).where("gap > 0"), "mix-gap")
    spare = near.where("rank >= cut").join(bounded_broadcast(gap), "_source")
    off = F.abs(F.col("size") - F.col("gap"))
    best = spare.where(off < F.col("gap")).groupBy("_source").agg(F.min_by("draw", F.struct(off, "rank", "draw")).alias("extra"))
    out = limit.join(materialize(best, "mix-extra"), "_source", "left").select("_source", "cut", "extra")
    named = plan.withColumn("_key", F.struct(F.col("_null").alias("n"), F.col("_name").alias("s")))
    out = named.join(out, F.col("_key") == out["_source"], "left").select(plan["_source"], "source_size", "target", "preferred", "cut", "extra")
    return materialize(out, "mix-cuts")


def copy_draw(draw: Column, copy: Column) -> Column:
    """The draw of a copy (0, 1, ...) of a row: its own for the first, one of draw and number for the others."""
    other = F.conv(F.substring(F.md5(F.concat_ws("|", draw, copy)), 1, DRAW_BITS // 4), 16, 10).cast("long")
    return F.when(copy == 0, draw).otherwise(other)


def _beside(rows: DataFrame, repeats: DataFrame, how: str) -> DataFrame:
    """rows whose source and draw are (left_semi) or aren't (left_anti) among repeats."""
    keys = bounded_broadcast(repeats.select(F.col("source").alias("_s"), F.col("draw").alias("_d")))
    return rows.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (F.col("draw") == F.col("_d")), how)


def number_copies(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows of repeats' sources and draws, with copy: 0, 1, ... without gaps among rows of one source and draw.

    Rows are numbered within the partition in which they are written, and set off by the counts of the partitions before: no
    task gets more of a row's copies than a partition had.
    """
    many = _beside(rows, repeats, "left_semi")
    written = materialize(many.withColumn("_mid", F.monotonically_increasing_id()), "mix-repeated")
    written = written.withColumn("_part", F.shiftright("_mid", 33).cast("int"))
    key = ["source", "draw", "_part"]
    before = Window.partitionBy("source", "draw").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(written.groupBy(*key).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))), "mix-offsets")
    counts = bounded_broadcast(counts.select(F.col("source").alias("_s"), F.col("draw").alias("_d"), F.col("_part").alias("_p"), "_before"))
    local = written.withColumn("_local", F.row_number().over(Window.partitionBy(*key).orderBy("_mid")) - 1)
    found = local.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("draw") == F.col("_d")) & (F.col("_part") == F.col("_p")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_local")).alias("copy"))


def _mixed(docs: DataFrame, weights: Sequence[float], factor: float, cap: float, seed: int, id_col: str, source_col: str, text_col: str, preference_col: str | None) -> DataFrame:
    """docs packed, with size, source_size, target and copies."""
    body = text_or_empty(text_col)
    pref = F.greatest(F.coalesce(F.col(preference_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if preference_col else F.lit(1.0)
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), body)
    measures = {
        "source": F.col(source_col).cast("string"), "size": word_count(body),
        "draw": F.conv(F.substring(F.md5(named), 1, DRAW_BITS // 4), 16, 10).cast("long"), "pref": pref,
    }
    rows = packed(docs, *[c.alias(n) for n, c in measures.items()])
    base = materialize(rows.drop("_row"), "mix-base")
    repeats = materialize(base.groupBy("source", "draw").count().where("count > 1").drop("count"), "mix-repeats", F.count(F.lit(1)).alias("n"))
    numbered = None
    if repeats.measured["n"]:
        release(base)
        numbered = materialize(number_copies(rows, repeats), "mix-copies")
        rows = _beside(rows, repeats, "left_anti").unionByName(numbered.withColumn("draw", copy_draw(F.col("draw"), F.col("copy"))).drop("copy"))
        base = materialize(rows.drop("_row"), "mix-base")
    marks = bounded_broadcast(cuts(base, weights, factor, cap))
    release(base)
    ranked = _ranked(rows, marks, cap)
    copies = F.col("whole") + F.when((F.col("rank") < F.col("cut")) | (F.col("rank").isNotNull() & (F.col("draw") == F.col("extra"))), 1).otherwise(0)
    return ranked.select("_row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", preference_col: str | None = None) -> DataFrame:
    """docs with _size, _source_size, _target and _copies (0 and up to cap); all input columns stay, whatever their names, but for these four.

    A null text has size 0; a null source is a source of its own, last in turn; a null or negative preference counts as 0
    (never taken); texts of any length are counted whole. Rows equal in source, id and text are numbered and each drawn on its
    own, and which of them is taken is open; ranks that tie fall together. An empty table gives an empty result. The draws
    hang on seed, id, text and those numbers only, so reruns and other partitionings agree.
    """
    mixed = _mixed(docs, weights, factor, cap, seed, id_col, source_col, text_col, preference_col)
    return unpacked(mixed, [c for c in docs.columns if c not in ADDED], *[F.col(c.removeprefix("_")).alias(c) for c in ADDED])


def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", preference_col: str | None = None) -> DataFrame:
    """docs as often as mix() takes them, none up to cap times: all columns, whatever their names, in their order. See mix for nulls, ties and repeats."""
    mixed = _mixed(docs, weights, factor, cap, seed, id_col, source_col, text_col, preference_col)
    taken = mixed.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpacked(taken, docs.columns)


ORACLE = r"""
WITH RECURSIVE o AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS draw, row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1 AS again FROM documents),
d AS (SELECT doc_id, source, size, CASE WHEN again = 0 THEN draw ELSE CAST('0x' || substr(md5(draw || '|' || again), 1, 15) AS BIGINT) END AS draw FROM o),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS weight FROM d GROUP BY source),
-- shares of 150 % of all, and again of what is above twice a source's size, until none is above
f(step, open_, rest) AS (SELECT 0, list(struct_pack(s := source, w := weight, m := 2.0::DOUBLE * source_size)), 1.5::DOUBLE * sum(source_size) FROM s
  UNION ALL SELECT step + 1, list_filter(open_, lambda x: x.m >= rest * x.w / list_sum(list_transform(open_, lambda y: y.w))), rest - list_sum(list_transform(list_filter(open_, lambda x: x.m < rest * x.w / list_sum(list_transform(open_, lambda y: y.w))), lambda x: x.m))
  FROM f WHERE len(list_filter(open_, lambda x: x.m < rest * x.w / list_sum(list_transform(open_, lambda y: y.w)))) > 0),
e AS (SELECT rest / list_sum(list_transform(open_, lambda y: y.w)) AS level FROM f ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, least(coalesce(level, 'inf'::DOUBLE) * weight, 2.0::DOUBLE * source_size) AS target FROM s, e),
p AS (SELECT doc_id, size, d.source, source_size, target, draw, CASE WHEN source_size > 0 THEN least(2.0, target / source_size) ELSE 0.0 END AS x, CAST(floor(x + 1e-9) AS BIGINT) AS whole, greatest(x - whole, 0.0) AS p, ((draw >> 8)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN p > 1e-9 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds, odds / (1 + odds) AS rank FROM p),
n AS (SELECT source, first(target) - sum(size * whole) AS need FROM r GROUP BY source),
c AS (SELECT r.*, need, sum(size) OVER (PARTITION BY r.source ORDER BY rank, draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source WHERE rank IS NOT NULL),
k AS (SELECT source, CASE WHEN first(need) <= 0 THEN 0.0 ELSE coalesce(min(rank) FILTER (run > need), 2.0) END AS cut, first(need) AS need FROM c GROUP BY source),
g AS (SELECT c.*, cut, need - coalesce(sum(size) FILTER (rank < cut) OVER (PARTITION BY c.source), 0) AS gap FROM (SELECT * EXCLUDE (need), need FROM c) c JOIN (SELECT source, cut FROM k) k ON c.source IS NOT DISTINCT FROM k.source),
b AS (SELECT source, min_by(draw, struct_pack(o := abs(size - gap), r := rank, d := draw)) AS extra FROM g WHERE rank >= cut AND gap > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN rank < cut OR draw = extra AND rank IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM r LEFT JOIN (SELECT source, cut FROM k) k ON r.source IS NOT DISTINCT FROM k.source LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
