"""Retention cells held against plain Python over awkward clicks."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from weftline.llm import registry as R
from weftline.llm import retention as N

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, updated_at timestamp_ntz, segment string"
CUT = datetime(2024, 2, 15)


def clicks(seed=4, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(120 * 86_400_000_000))
        client = 7 if rng.random() < 0.4 else rng.randrange(30)
        kind = rng.choice(["signup", "view", "view", "buy", None])
        value = rng.choice([None, 1.005, -2.345, 10.0, float("nan"), float("inf"), rng.random() * 100])
        rows.append((None if rng.random() < 0.02 else i, None if rng.random() < 0.02 else ts, None if rng.random() < 0.02 else ts + timedelta(seconds=2), None if rng.random() < 0.02 else client, kind, value, rng.choice([None, "{}", "x" * 200])))
    rows += [rows[5]] * 50 + rows[:100]
    rows += [(9000, datetime(1969, 12, 30, 23, 59, 59, 999999), datetime(2024, 1, 1), 101, "signup", 1.0, None), (9001, datetime(1969, 12, 31, 23, 59, 59, 999998), datetime(2024, 1, 1), 101, "view", 2.0, None), (9002, datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 1, 1), 101, "view", 3.0, None), (9003, datetime(2024, 3, 1), datetime(2024, 3, 1), 101, "view", 4.0, None)]
    return rows


def clients():
    return [(i, datetime(2024, 1, 1), None if i % 5 == 0 else f"s{i % 3}") for i in range(25)] + [(3, datetime(2024, 2, 1), "later"), (4, None, "never"), (None, None, "nobody"), *[(8, datetime(2023, 1, 1), "old")] * 40]


def plain(rows, people, cutoff=CUT):
    crc = lambda x: zlib.crc32(str(x).encode())
    segment = {}
    for c, at, s in people:
        segment[c] = max(segment.get(c, (datetime.min, "")), (at or datetime.min, s or ""))
    distinct = {tuple("nan" if v != v else v for v in r): r for r in rows if r[1] is not None and r[3] is not None}.values()
    known = [[], list(distinct)]
    for r in distinct:
        h = None if r[0] is None else crc(r[0])
        came = r[2] + timedelta(days=h % 100) if r[2] and h is not None and h % 3 == 0 else r[2]
        if came is not None and came < cutoff:
            known[0].append(r)
    starts, cells = [{}, {}], defaultdict(lambda: [set(), 0])
    for k in (0, 1):
        for r in known[k]:
            if r[4] == "signup":
                starts[k][r[3]] = min(r[1], starts[k].get(r[3], r[1]))
    day = lambda t: (t - datetime(1970, 1, 1)).days
    for k in (0, 1):
        for r in known[k]:
            s = starts[k].get(r[3])
            if s and r[1] >= s:
                cell = cells[k, segment.get(r[3], (None, ""))[1], day(s), (r[1] - s) // timedelta(days=1)]
                cell[0].add(r[3])
                cell[1] += 0 if r[5] is None or r[5] != r[5] or abs(r[5]) == float("inf") else int((100 * r[5] + 0.5) // 1)
    moved = {c for c in starts[0] if c in starts[1] and day(starts[0][c]) != day(starts[1][c])}
    return {key: (len(u), sum(map(crc, u)), len(u & moved), cents) for key, (u, cents) in cells.items()}


def shape(df):
    return {(r.state, r.segment, r.cohort, r.period): (r.users, r.users_crc32, r.moved, r.cents) for r in df.collect()}


@pytest.mark.parametrize("share", [512, 3])
def test_cells(spark, monkeypatch, share):
    """With one hot client among the many (every client with more than a part of all clicks is salted)."""
    monkeypatch.setattr(N, "HOT_SHARE", share)
    df = spark.createDataFrame(clicks(), CLICKS).repartition(5)
    got = N.retention_matrix(df, spark.createDataFrame(clients(), CLIENTS), ("2024-02-15 00:00:00", None), N.late_arrival())
    want = plain(clicks(), clients())
    assert shape(got) == want and got.count() == len(want)
    assert {k: want[k] for k in want if k[2] < 0} and any(k[1] == "later" for k in want) and sum(v[2] for v in want.values())


def test_other_columns_and_widths(spark):
    """Columns of any name beside the clicks' own matter for equality only; periods and cohorts of more than a day."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(clicks(), CLICKS)
    extra = base.withColumns({c: F.lit("x") for c in ("client", "salt", "state", "cents", "known", "n", "a.b", "x`y", "_other0")})
    people = spark.createDataFrame(clients(), CLIENTS)
    assert shape(N.retention_matrix(extra, people)) == shape(N.retention_matrix(base, people))
    twice = base.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    once, both = shape(N.retention_matrix(base, people)), shape(N.retention_matrix(twice, people))
    assert both == {k: (*v[:3], 2 * v[3]) for k, v in once.items()}
    week = shape(N.retention_matrix(base, people, cohort_days=7, period_days=7))
    assert sum(v[3] for v in week.values()) == sum(v[3] for v in once.values())
    assert {(k[2], k[3]) for k in week} <= {(a, b) for a in {k[2] // 7 for k in once} for b in {k[3] // 7 for k in once}}


def test_empty_tables(spark):
    none, people = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert N.retention_matrix(none, people).count() == 0
    rows = [(1, datetime(2024, 1, 1), datetime(2024, 1, 1), 5, "signup", 0.5, None)]
    got = shape(N.retention_matrix(spark.createDataFrame(rows, CLICKS), people))
    assert got == {(0, "", 19723, 0): (1, zlib.crc32(b"5"), 0, 50)}
    assert N.retention_matrix(spark.createDataFrame([(*rows[0][:4], "view", 0.5, None)], CLICKS), people).count() == 0


def test_vectors(spark):
    """Bits and cents of one client, more than 64 periods on."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(days=d, hours=1), start, 5, "signup" if d == 0 else "view", 1.0, None) for i, d in enumerate([0, 1, 1, 63, 64, 200])]
    known = N.known_clicks(spark.createDataFrame(rows, CLICKS), (None,), N.F.col("arrived_at"))
    got = {r.block: (r.mask & (2**64 - 1), r.cents) for r in N.activity(known, N.client_segments(spark.createDataFrame([], CLIENTS)), 1).collect()}
    assert got == {0: (1 | 2 | 1 << 63, {0: 100, 1: 200, 63: 100}), 1: (1, {0: 100}), 3: (1 << 8, {8: 100})}


def test_query_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in clicks() if r[5] is None or abs(r[5]) < 1e9]
    spark.createDataFrame(rows, CLICKS).repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(clients(), CLIENTS).write.parquet(f"{tmp_path}/clients.parquet")
    con = duckdb.connect()
    for t in ("clicks", "clients"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = con.execute(R.oracle_sql()["op11_retention"])
    at = [d[0] for d in got.description]
    want = Counter(tuple(row[at.index(c)] for c in sorted(at)) for row in got.fetchall())
    df = R.op11_retention(spark, str(tmp_path))
    assert Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect()) == want and len(want) == len(plain(rows, clients()))
