"""Runs held against a search of all periods, and the pieces against their definitions."""

import random

import fixtures_llm as fx
import numpy as np

from weftline.llm import periodic_runs as P


def brute(w):
    """Every maximal stretch in which words q apart are equal, for the least q."""
    n, seen, out = len(w), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and (s, i + q) not in seen:
                seen.add((s, i + q))
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def text(rng):
    k, n, w = rng.randrange(1, 4), rng.randrange(0, 140), []
    while len(w) < n:
        w += [bytes([97 + rng.randrange(k)]) for _ in range(rng.randrange(1, 7))] * (1 if rng.random() < 0.5 else rng.randrange(1, 8))
        if rng.random() < 0.2 and w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(50)]
    return w[:n]


def test_all_runs():
    rng = random.Random(5)
    for _ in range(250):
        texts = [text(rng) for _ in range(8)]
        assert P.find_runs(texts) == [brute(t) for t in texts]
    assert P.find_runs([]) == [] and P.find_runs([[], []]) == [[], []]


def test_runs_within_copies():
    """Runs that lie deep inside a block come from its source, again and again."""
    a, b = [b"x"] * 7, [b"p", b"q"] * 5
    unit = [b"1", b"2", *a, b"3", *b, b"4", b"5"]
    w = [*unit, b"6", *unit, b"7", b"8", *unit, b"6", *unit, b"9"]
    assert P.find_runs([w]) == [brute(w)] and len(brute(w)) == 8
    nested = ([*a, b"y"] * 5 + [b"z"]) * 4
    assert P.find_runs([nested]) == [brute(nested)]


def test_long_texts():
    rng = random.Random(2)
    for w in ([b"a"] * 20000, [b"a", b"b"] * 20000, ([b"a"] * 7 + [b"b"]) * 3000, [bytes([97 + rng.randrange(2)]) for _ in range(3000)]):
        want = brute(w) if len(w) <= 3000 else None
        got = P.find_runs([w])[0]
        assert want is None or got == want
        assert got and got[0][0] + got[0][1] <= len(w)
    assert P.find_runs([[b"a"] * 20000]) == [[(0, 20000, 1)]] and len(P.find_runs([([b"a"] * 7 + [b"b"]) * 3000])[0]) == 3001


def test_factors_and_extensions():
    rng = random.Random(7)
    for _ in range(60):
        texts = [text(rng)[:40] for _ in range(3)]
        n = [len(t) for t in texts]
        symbols = np.array([ord(w) + 1000 * k for k, t in enumerate(texts) for w in t], np.int64)
        tables = P.doubling_ranks(symbols, np.repeat(np.cumsum(n), n))
        length, place = P.previous_factors(tables)
        base = 0
        for t in texts:
            for i in range(len(t)):
                common = lambda j, i=i, t=t: next((k for k in range(len(t)) if i + k >= len(t) or t[i + k] != t[j + k]), len(t))
                best = max((common(j) for j in range(i)), default=0)
                assert length[base + i] == best and (best == 0 or common(place[base + i] - base) == best and place[base + i] < base + i)
            base += len(t)


def test_collapse():
    w = [b"s", *[b"a", b"b"] * 4, b"b", b"b", b"b", b"b", b"b", b"t"]
    runs = P.find_runs([w])[0]
    assert runs == [(1, 8, 2), (8, 6, 1)] and P.collapse(w, runs) == b"s a b t"
    assert P.collapse([b"a", b"b"], []) == b"a b" and P.collapse([], []) == b""


def test_operator_keeps_rows(spark):
    df = fx.table(spark, extra=True)
    got = P.periodic_runs(df).collect()
    assert len(got) == len(fx.documents())
    for r in got:
        w = (r.text or "").encode().split()
        assert r.periodic.n_words == len(w) and [tuple(x) for x in r.periodic.runs] == brute(w) if len(w) < 1000 else True
        assert r.periodic.collapsed == P.collapse(w, [tuple(x) for x in r.periodic.runs]).decode()
    assert P.periodic_runs(fx.empty(spark)).count() == 0


def test_most_repeated(spark):
    df = spark.createDataFrame([(1, [(0, 12, 3), (20, 8, 2), (30, 4, 1), (40, 8, 2)]), (2, []), (3, [(5, 9, 2), (5, 9, 2)])], "i int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r.i: r.b and tuple(r.b) for r in df.select("i", P.most_repeated(df.runs).alias("b")).collect()}
    assert got == {1: (0, 12, 3), 2: None, 3: (5, 9, 2)}
