"""Cohort retention (11): activity bit vectors per client, from salted partial ORs.

A client's start is the earliest click of one kind; later clicks fall into periods counted from it. Each client's activity in
a state is a bit vector of periods, held as 64-bit blocks (so that any number of periods fits), with a sparse vector of cents
beside it: the cents of the bits that are set. Clicks of a client with more than one of HOT_SHARE of all clicks are dealt over
SALTS salts; partial vectors are made per client and salt where the join has put the rows, and only they are exchanged again:
masks are ORed and cents added bit by bit, per client and state. The set bits are then exploded and counted by cohort.

Nothing that grows with the input goes through one task, the driver or a broadcast: the only broadcast is the list of hot
clients, at most HOT_SHARE rows as each has more than that part of all clicks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_TABLE, crc_sql, materialize, quoted

HOT_SHARE, SALTS, BITS = 512, 256, 64


def _comparable(clicks: DataFrame, used: Sequence[str]) -> list[Column]:
    """All columns by position; long values of columns that the operator doesn't read as their MD5, so that rows stay narrow in the exchange."""
    named = [F.col(quoted(f.name)) if f.name in used or not isinstance(f.dataType, T.StringType | T.BinaryType) else F.unhex(F.md5(F.col(quoted(f.name)).cast("binary"))) for f in clicks.schema.fields]
    return [c.alias(f.name if f.name in used else f"_other{i}") for i, (c, f) in enumerate(zip(named, clicks.schema.fields, strict=True))]


def _cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null, NaN and infinite values count 0."""
    scaled = F.floor(F.lit(100) * value.cast("double") + F.lit(0.5))
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf")), F.lit(0)).otherwise(scaled).cast("long")


def known_clicks(clicks: DataFrame, cutoffs: Sequence[str | None], arrival: Column, start_kind: str = "signup", id_col: str = "click_id", client_col: str = "client_id", ts_col: str = "ts", arrived_col: str = "arrived_at", kind_col: str = "kind", value_col: str = "value") -> DataFrame:
    """client, ts, starts, cents and known (an array with a flag for each cutoff) of each distinct click with a client and a time.

    arrival: when a click came in, over clicks' columns; a null arrival is known only where the cutoff is None (never cut).
    """
    used = [id_col, client_col, ts_col, arrived_col, kind_col, value_col]
    distinct = clicks.where(F.col(quoted(ts_col)).isNotNull() & F.col(quoted(client_col)).isNotNull()).select(*_comparable(clicks, used)).distinct()
    kind = clicks.schema[arrived_col].dataType
    known = [F.lit(True) if c is None else F.coalesce(arrival < F.lit(c).cast(kind), F.lit(False)) for c in cutoffs]
    return distinct.select(F.col(client_col).alias("client"), F.col(ts_col).alias("ts"), F.coalesce(F.col(kind_col) == start_kind, F.lit(False)).alias("starts"), _cents(F.col(value_col)).alias("cents"), F.array(*known).alias("known"))


def client_segments(clients: DataFrame, client_col: str = "client_id", segment_col: str = "segment", updated_col: str = "updated_at") -> DataFrame:
    """client, segment: one row a client, of its latest row (null times first, then the greater segment); no segment is ''."""
    segment = F.coalesce(F.col(quoted(segment_col)).cast("string"), F.lit(""))
    latest = F.max(F.struct(F.col(quoted(updated_col)).alias("at"), segment.alias("segment")))
    return clients.where(F.col(quoted(client_col)).isNotNull()).groupBy(F.col(quoted(client_col)).alias("client")).agg(latest["segment"].alias("segment"))


def activity(known: DataFrame, segments: DataFrame, states: int, cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """client, segment, moved, state, cohort, block, mask, cents: a row for each block of 64 periods of a client's bit vector in a state.

    Bit b of mask: the client was active in period 64 * block + b; cents is a map from set bits to their sums. moved: the
    client's cohorts in the first and the last state differ (false if it has no start in one of them).
    """
    rows = materialize(known, "clicks", F.count(F.lit(1)).alias("n"))
    firsts = [F.min(F.when(F.col("starts") & F.col("known")[k], F.col("ts"))).alias(f"_s{k}") for k in range(states)]
    begun = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n"), *firsts).where(F.coalesce(*[F.col(f"_s{k}") for k in range(states)]).isNotNull())
    starts = F.array(*[F.struct(F.col(f"_s{k}").alias("start"), F.floor(F.unix_date(F.to_date(F.col(f"_s{k}"))) / cohort_days).cast("long").alias("cohort")) for k in range(states)])
    begun = begun.select("client", "n", starts.alias("begun")).join(segments, "client", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
    moved = F.coalesce(F.col("begun")[0]["cohort"] != F.col("begun")[states - 1]["cohort"], F.lit(False))
    begun = materialize(begun.withColumn("moved", moved), "starts")

    hot = F.broadcast(begun.where(F.col("n") > rows.measured["n"] // HOT_SHARE).select("client", F.lit(True).alias("hot")))  # fewer than HOT_SHARE rows: their counts add up to n at most
    salted = rows.join(hot, "client", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("ts", "cents", F.monotonically_increasing_id()), SALTS)).otherwise(0).cast("int")).drop("hot")
    owners = begun.join(hot, "client", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot", "n")
    each = salted.hint("shuffle_merge").join(owners, ["client", "salt"])
    known_at = F.filter(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: F.get("known", k) & F.coalesce(F.col("ts") >= F.get("begun", k)["start"], F.lit(False)))
    each = each.withColumn("state", F.explode(known_at)).withColumn("from", F.get("begun", F.col("state")))
    period = F.floor(F.expr("extract(DAY FROM ts - `from`.start)") / period_days).cast("long")
    each = each.select("client", "salt", "segment", "moved", "state", F.col("from.cohort").alias("cohort"), period.alias("period"), "cents")

    of = ["client", "segment", "moved", "state", "cohort", "block"]
    bits = each.select("client", "salt", "segment", "moved", "state", "cohort", F.floor(F.col("period") / BITS).cast("long").alias("block"), F.pmod("period", F.lit(BITS)).cast("int").alias("bit"), "cents")
    sums = bits.groupBy("salt", *of, "bit").agg(F.sum("cents").alias("cents"))
    partial = sums.groupBy("salt", *of).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"), F.map_from_entries(F.collect_list(F.struct("bit", "cents"))).alias("cents"))  # at most 64 entries
    merged = partial.drop("salt").groupBy(*of).agg(F.bit_or("mask").alias("mask"), F.collect_list("cents").alias("parts"))  # at most SALTS maps
    total = F.map_from_entries(F.transform(set_bits(F.col("mask")), lambda b: F.struct(b, F.aggregate("parts", F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.get(F.array(m[b]), F.lit(0)), F.lit(0))))))
    return merged.select(*of, "mask", total.alias("cents"))


def set_bits(mask: Column) -> Column:
    """The places of the bits that are set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.bit_get(mask, b) == 1)


def retention_matrix(clicks: DataFrame, clients: DataFrame, cutoffs: Sequence[str | None] = (None,), arrival: Column | None = None, start_kind: str = "signup", cohort_days: int = 1, period_days: int = 1, **columns: str) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents of each nonempty cell.

    State k knows the clicks that arrive before cutoffs[k] (None: all). Equal clicks count once; clicks without time or client
    are left out, and so are clients without a start; a null kind starts nothing, a null value has no cents, a null id or arrival
    is as known_clicks says. Clients that are missing, or have no segment, have ''; of several rows of a client the latest
    counts. Tables may be empty (no rows), and have other columns of any name, which matter for the equality of clicks only.
    columns: names of the columns, as in known_clicks.
    """
    came = F.col(quoted(columns.get("arrived_col", "arrived_at"))) if arrival is None else arrival
    vectors = activity(known_clicks(clicks, cutoffs, came, start_kind, **columns), client_segments(clients), len(cutoffs), cohort_days, period_days)
    one = vectors.select("state", "segment", "cohort", "client", "moved", "block", F.explode("cents").alias("bit", "cents"))
    cells = one.groupBy("state", "segment", "cohort", (F.col("block") * BITS + F.col("bit")).alias("period"))
    return cells.agg(F.count(F.lit(1)).alias("users"), F.sum(F.crc32(F.col("client").cast("string").cast("binary"))).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents"))


#: When a click of the contract arrives: those whose id's checksum 3 divides, that checksum mod 100 days late.
def late_arrival(id_col: str = "click_id", arrived_col: str = "arrived_at") -> Column:
    h = F.crc32(F.col(quoted(id_col)).cast("string").cast("binary"))
    late = F.col(quoted(arrived_col)) + F.make_dt_interval((h % 100).cast("int"))
    return F.when(h % 3 == 0, late).otherwise(F.col(quoted(arrived_col)))


ORACLE = f"""
WITH {CRC_TABLE},
ids AS (SELECT click_id, {crc_sql("click_id")} AS h FROM (SELECT DISTINCT click_id FROM clicks), t),
users AS (SELECT client_id, {crc_sql("client_id")} AS crc FROM (SELECT DISTINCT client_id FROM clicks WHERE client_id IS NOT NULL), t),
c AS (SELECT d.client_id, d.ts, d.kind, CASE WHEN d.value IS NULL THEN 0 ELSE CAST(floor(100 * d.value + 0.5) AS BIGINT) END AS cents,
  CASE WHEN h % 3 = 0 THEN d.arrived_at + to_days(CAST(h % 100 AS INTEGER)) ELSE d.arrived_at END AS arrival
  FROM (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL) d LEFT JOIN ids ON ids.click_id IS NOT DISTINCT FROM d.click_id),
k AS (SELECT 0 AS state, * FROM c WHERE arrival < TIMESTAMP '2024-02-15 00:00:00' UNION ALL SELECT 1, * FROM c),
s AS (SELECT state, client_id, min(ts) AS start, CAST(floor(epoch_us(date_trunc('day', min(ts))) / 86400000000) AS BIGINT) AS cohort FROM k WHERE kind = 'signup' GROUP BY ALL),
m AS (SELECT a.client_id, a.cohort <> b.cohort AS moved FROM s a JOIN s b ON a.client_id = b.client_id AND a.state = 0 AND b.state = 1),
g AS (SELECT client_id, max_by(coalesce(segment, ''), (coalesce(updated_at, TIMESTAMP '0001-01-01 00:00:00'), coalesce(segment, ''))) AS segment FROM clients GROUP BY 1),
cell AS (SELECT k.state, coalesce(g.segment, '') AS segment, s.cohort, (epoch_us(k.ts) - epoch_us(s.start)) // 86400000000 AS period, k.client_id, coalesce(m.moved, false) AS moved, sum(k.cents) AS cents
  FROM k JOIN s ON k.state = s.state AND k.client_id = s.client_id AND k.ts >= s.start LEFT JOIN g ON g.client_id = k.client_id LEFT JOIN m ON m.client_id = k.client_id GROUP BY ALL)
SELECT CAST(state AS INTEGER) AS state, segment, CAST(cohort AS BIGINT) AS cohort, CAST(period AS BIGINT) AS period, count(*) AS users, CAST(sum(crc) AS BIGINT) AS users_crc32, CAST(sum(CAST(moved AS INTEGER)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM cell JOIN users ON users.client_id = cell.client_id GROUP BY state, segment, cohort, period
"""
