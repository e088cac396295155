import re
from collections import Counter

import fixtures_llm as fx
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows, margin=0.0):
    """Classes of equal texts and of unweighted similarity 0.8 (fixtures keep clear of the threshold)."""
    texts = sorted({r[1] or "" for r in rows})
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            low, high = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if high and low / high >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {t: g for t, g in zip(texts, group, strict=True)}


def test_classes(spark):
    rows = fx.documents()
    of = brute(rows)
    least = {}
    for r in rows:
        if r[0] is not None:
            g = of[r[1] or ""]
            least[g] = min(least.get(g, r[0]), r[0])
    size = Counter(of[r[1] or ""] for r in rows)
    want = Counter((r[0], least.get(of[r[1] or ""]), size[of[r[1] or ""]]) for r in rows)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in N.near_duplicates(fx.table(spark, extra=True)).collect())
    assert got == want


def test_keep_one(spark):
    rows = fx.documents()
    df = fx.table(spark, extra=True)
    kept = N.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(brute(rows).values()))
    assert N.keep_one(fx.empty(spark)).count() == 0


def test_samples_agree_with_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32)
    w = rng.uniform(0.5, 5, 3000)
    a, b = np.arange(0, 2600), np.arange(300, 3000)
    wb = w.copy()
    wb[1000:1500] *= 2
    real = np.minimum(w, wb)[300:2600].sum() / (w[:2600].sum() + wb[300:].sum() - np.minimum(w, wb)[300:2600].sum())
    hits = []
    for k in range(30):
        turn = np.uint32(k * 7919)
        s = N.weighted_samples(np.concatenate([ids[a] ^ turn, ids[b] ^ turn]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([w[a], wb[b]]), 2)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - real) < 0.03


FLAT = np.zeros((N.SKETCH_ROWS, N.SKETCH), np.uint8)


def test_similarities_exact():
    one = (np.array([1, 2, 2, 3], np.uint32), np.array([0, 0, 0, 1]))
    two = (np.array([2, 5, 3, 3], np.uint32), np.array([0, 0, 1, 1]))
    for found in N.similarities(one, two, 3, FLAT):
        assert np.allclose(found, [1 / 4, 1 / 2, 1])


def test_sketch_counts_every_text(spark):
    """Weights fall with the share of texts that hold a shingle, and bound what a common template can hide."""
    rng = np.random.default_rng(7)
    rows = [(i, f"all five words are here w{i} " + " ".join(f"x{k}" for k in rng.integers(0, 9**6, 30))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sketch = N.document_frequencies(df)
    assert (sketch == N.document_frequencies(df.coalesce(1))).all()
    h, row = N.shingles(*N.strings(pa.array([r[1] for r in rows])))
    w = N.weights_of(h, sketch)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    assert np.allclose(w[first], 1) and np.allclose(np.median(w), 1 + np.log(501 / 2) / np.log(N.RARE), atol=0.01)
    assert N.document_frequencies(fx.empty(spark)).shape == sketch.shape


def test_unweighted_similarity_bounds_the_weighted():
    rng = np.random.default_rng(9)
    sketch = rng.integers(0, 256, FLAT.shape).astype(np.uint8)
    for _ in range(200):
        a, b = (np.sort(rng.integers(0, 50, rng.integers(1, 80)).astype(np.uint32)) for _ in range(2))
        weighted, plain = (x[0] for x in N.similarities((a, np.zeros(len(a), int)), (b, np.zeros(len(b), int)), 1, sketch))
        assert weighted >= plain / (2 - plain) - 1e-6


def drifting(n=150, width=60, step=5):
    """A chain of which only neighbours are alike, and a group whose pairs lie on both sides of the bound."""
    words = [f"c{k}" for k in range(width + step * n)]
    rows = [" ".join(words[k * step : k * step + width]) for k in range(n)]
    rng = np.random.default_rng(4)
    rows += [" ".join(f"m{i}x{j}" if new else f"b{j}" for j, new in enumerate(rng.random(width) < 0.04)) for i in range(n)]
    return list(enumerate(dict.fromkeys(rows)))


@pytest.mark.parametrize("block", [256, 16])
def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch, block):
    """In one block, and in many that meet two by two."""
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    rows = drifting()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = N.document_frequencies(df)
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], names=["key", "text", "doc"])
    made = pa.Table.from_batches(N._signatures(sketch)([table]))
    bands = [set(b) for b in made.column("bands").to_pylist()]
    own = [N.shingles(*N.strings(pa.array([r[1]]))) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and bands[i] & bands[j] and max(x[0] for x in N.similarities(own[i], own[j], 1, sketch)) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    assert len(set(group)) > 3
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    least = {g: group.index(g) for g in set(group)}
    assert got == {i: least[g] for i, g in enumerate(group)}


def test_blocks_agree_with_pairs():
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 256, FLAT.shape).astype(np.uint8)
    texts = [np.sort(rng.integers(0, 60, rng.integers(0, 90)).astype(np.uint32)) for _ in range(40)]
    hashes, row = np.concatenate(texts), np.repeat(np.arange(40), [len(t) for t in texts])
    left, right = np.arange(0, 25), np.arange(25, 40)
    near = N.near_pairs(hashes, row, left, right, sketch, 0.4)
    for i in left:
        for j in right:
            one, two = ((texts[k], np.zeros(len(texts[k]), int)) for k in (i, j))
            assert near[i, j - 25] == (max(x[0] for x in N.similarities(one, two, 1, sketch)) >= 0.4)


def edited(rng, words, share):
    return [f"e{rng.integers(0, 9**7)}" if new else w for w, new in zip(words, rng.random(len(words)) < share, strict=True)]


def isolated(rng, n):
    """Pairs that share nothing with others."""
    for _ in range(n):
        base = [f"i{k}" for k in rng.integers(0, 9**7, 200)]
        yield base
        yield edited(rng, base, 0.015)


def family(rng, n):
    """Pairs over one template: what makes a pair's two texts alike is rare, what all texts share is common."""
    template = [f"t{k}" for k in range(200)]
    for _ in range(n):
        base = edited(rng, template, 0.04)
        yield base
        yield edited(rng, base, 0.012)


def test_recall_against_brute_force(spark):
    """Pairs of similarity 0.8 and more (of five-word shingle sets) that end in one class: isolated ones, and in families that share a template."""
    rng = np.random.default_rng(11)
    for make in (isolated, family):
        texts = list(dict.fromkeys(" ".join(w) for w in make(rng, 150)))
        sets = [set(shingles(t)) for t in texts]
        near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        of = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
        found = sum(of[i] == of[j] for i, j in near) / len(near)
        assert len(near) > 100 and found >= 0.97, (make.__name__, len(near), found)
        # a class holds nothing but what links join
        group = list(range(len(texts)))
        for i, j in near:
            a, b = group[i], group[j]
            group = [b if g == a else g for g in group]
        strangers = sum(of[i] == of[j] and group[i] != group[j] for i in range(len(texts)) for j in range(i))
        assert strangers <= 0.02 * len(texts), (make.__name__, strangers)


def test_clashing_and_dotted_names(spark):
    df = fx.table(spark, extra=True)
    names = {c: F.lit("x") for c in ("a.b", "_own", "_doc", "_key", "_row", "_id", "class_key", "n`q")}
    odd = df.withColumns(names)
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == N.keep_one(df).count()
    assert N.near_duplicates(odd).columns == ["doc_id", "class_id", "class_size"]
