import hashlib
from collections import Counter

import fixtures_llm as fx
import numpy as np
from pyspark.sql import functions as F

from weftline.llm import fingerprints as P


def names(text, level):
    raw = text.encode()
    return P.phrases(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), level)[0]


def test_equal_substrings_share_interior_names():
    body = " ".join(fx.words(__import__("random").Random(3), 800))
    inner = set(names(body, 3))
    for before in ("", "q", "some other text of another length "):
        assert len(inner & set(names(before + body + "tail", 3))) / len(inner) > 0.97


def test_blocks_are_short_but_not_single():
    body = " ".join(fx.words(__import__("random").Random(4), 3000))
    sizes = [len(names(body, k)) for k in (1, 2, 3)]
    assert all(1.8 < a / b < 6 for a, b in zip([len(body), *sizes], sizes, strict=False))


def test_rows_of_a_batch_dont_mix():
    texts = [b"", b"abc abc", b"x" * 500, "é".encode() * 9, b"abc abc"]
    whole, _ = P._signed(texts)
    for i, t in enumerate(texts):
        assert (whole[i] == P._signed([t])[0][0]).all()


def test_next_and_edit(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(r[1] for r in fx.documents())]
    got = {r.doc_id: r for r in P.compare_with_next(spark.createDataFrame(rows, fx.SCHEMA).repartition(5)).collect()}
    texts = [r[1] or "" for r in rows]
    prints = {r.doc_id: r.fingerprint for r in P.fingerprint_texts(spark.createDataFrame(rows, fx.SCHEMA)).collect()}
    for i, t in enumerate(texts):
        follow = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == follow:
            assert r.near_next == 1
    assert got[0].fingerprint == "" and got[0].near_edited == 1


def test_cases(spark):
    df = fx.table(spark, extra=True)
    assert Counter(r.doc_id for r in P.compare_with_next(df).collect()) == Counter(r[0] for r in fx.documents())
    assert P.compare_with_next(fx.empty(spark)).count() == 0
    one = P.compare_with_next(df.where(F.col("doc_id") == 8)).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_a_third_of_all_rows_equal(spark):
    """Equal rows follow each other; every row is there, and each id's next text is right."""
    rows = [(5, "the same text again and again")] * 400 + [(10 + i, f"text number {i} of a few") for i in range(800)]
    got = P.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    same = [r for r in got if r.doc_id == 5]
    assert len(got) == 1200 and len(same) == 400 and sum(r.near_next == 1 for r in same) == 399


def test_likeness_is_that_of_the_phrase_sets(spark):
    """Estimates against exact Jaccard similarities of the sets of phrase names, for texts and edited texts."""
    rng = __import__("random").Random(12)
    texts = []
    for i in range(120):
        if i and rng.random() < 0.5:  # much like the one before
            w = texts[-1].split()
            for _ in range(rng.randrange(1, 30)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(fx.words(rng, rng.randrange(40, 300))))
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in P.compare_with_next(spark.createDataFrame(rows, fx.SCHEMA)).collect()}
    sets = lambda t: set(names(t, P.LEVEL))
    off = []
    for i, t in enumerate(texts):
        follow = texts[(i + 1) % len(texts)]
        for other, said in ((P.edit(t, follow), got[i].near_edited), (follow, got[i].near_next)):
            a, b = sets(t), sets(other)
            off.append(said - len(a & b) / len(a | b))
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.2
