import re
from collections import Counter, defaultdict

import fixtures_llm as fx
import pytest

from weftline.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights=(5, 2, 1), factor=1.5, cap=2.0):
    """Targets by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = factor * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: cap * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        more = {s for s in open_ if out[s] > cap * sizes[s] + 1e-9}
        if not more:
            return out
        full |= more


def test_targets_and_takes(spark):
    rows = fx.documents() + [(1000 + i, " ".join(["w"] * (1 + i % 40)), "en", f"z{i % 5}", 1) for i in range(600)]
    got = M.mix(spark.createDataFrame(rows, fx.SCHEMA).repartition(4)).collect()
    sizes, biggest = Counter(), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        biggest[r[3]] = max(biggest[r[3]], n)
    want, taken = fill(sizes), Counter()
    for r in got:
        assert r._size == len(WORD.findall(r.text or "")) and r._source_size == sizes[r.source]
        assert r._target == pytest.approx(want[r.source]) and 0 <= r._copies <= 2
        taken[r.source] += r._copies * r._size
    assert len(got) == len(rows)
    for s in sizes:
        # a source's words miss its target by half its largest document at most
        assert abs(taken[s] - want[s]) <= max(1, biggest[s] / 2), s
        if s and s.startswith("z"):
            assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 1


def test_many_sources_share_again(spark):
    """Sizes that fill source after source: as many rounds as it takes."""
    sizes = {f"s{i:03}": 3 ** (i % 9) for i in range(200)} | {None: 5}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    for factor in (0.2, 1.0, 1.5, 1.99, 3.0):
        want = fill(sizes, factor=factor) if factor < 2 else {s: 2.0 * n for s, n in sizes.items()}
        got = {r.source: r.target for r in M.targets(table, (5, 2, 1), factor, 2.0).collect()}
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_reruns_agree(spark):
    df = fx.table(spark, extra=True)
    a = Counter((r.doc_id, r.text, r._copies) for r in M.mix(df).collect())
    assert a == Counter((r.doc_id, r.text, r._copies) for r in M.mix(df.repartition(9)).collect())


def test_preferences_and_inclusion(spark):
    rows = [(i, "a b c d", "en", "s", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, fx.SCHEMA).selectExpr("*", "case when doc_id < 1000 then 3.0 when doc_id < 1900 then 1.0 end p")
    got = M.mix(df, weights=(1,), factor=0.5, preference_col="p").collect()
    taken = [sum(r._copies for r in got if lo <= r.doc_id < hi) for lo, hi in ((0, 1000), (1000, 1900), (1900, 2000))]
    assert abs(sum(taken) - 1000) <= 1 and taken[2] == 0 and taken[0] / 1000 == pytest.approx(3 * taken[1] / 900, rel=0.15)


def test_empty_and_wordless(spark):
    assert M.mix(fx.empty(spark)).count() == 0
    got = M.mix(spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", None, 0)], fx.SCHEMA)).collect()
    assert [(r._size, r._target) for r in got] == [(0, 0.0)] * 2


@pytest.mark.parametrize("factor", [0.7, 0.98, 1.5, 1.9])
def test_a_third_of_all_rows_equal(spark, factor):
    """One row a thousand times over, beside others of its source and of another: each source's taken words come within half a large row of the target."""
    rows = [(1, "a b c", "en", "s", 5)] * 1000 + [(i, " ".join(["w"] * (1 + i % 5)), "en", "s", 1) for i in range(2, 502)] + [(i, "x y", "en", "t", 1) for i in range(600, 900)]
    df = spark.createDataFrame(rows, fx.SCHEMA)
    got = M.mix(df.repartition(7), factor=factor).collect()
    assert len(got) == len(rows)
    for source, biggest in (("s", 5), ("t", 2)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r._copies * r._size for r in mine) - mine[0]._target) <= max(1, biggest / 2), source
    assert Counter((r.doc_id, r._copies) for r in got) == Counter((r.doc_id, r._copies) for r in M.mix(df.repartition(3), factor=factor).collect())
    assert M.take(df, factor=factor).count() == sum(r._copies for r in got)


def test_copies_are_numbered_without_gaps(spark):
    """Equal rows over many partitions: numbers 0, 1, ... each, null sources too."""
    rows = [("s", 1, 7, 1.0)] * 900 + [(None, 1, 7, 1.0)] * 300 + [("s", 1, 8, 1.0)] * 2 + [("s", 1, 9, 1.0)]
    df = spark.createDataFrame(rows, "source string, size long, draw long, pref double").repartition(6)
    repeats = df.groupBy("source", "draw").count().where("count > 1").drop("count")
    got = Counter((r.source, r.draw, r.copy) for r in M.number_copies(df, repeats).collect())
    assert got == Counter([("s", 7, i) for i in range(900)] + [(None, 7, i) for i in range(300)] + [("s", 8, i) for i in range(2)])
