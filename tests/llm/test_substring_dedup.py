import random
import re
from collections import Counter

import fixtures_llm as fx
import numpy as np
import pytest

from weftline.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("limit", [None, 1])
def test_against_brute_force(spark, monkeypatch, limit):
    """With limit 1 each mixed group takes the longest prefix instead of a tree."""
    if limit:
        monkeypatch.setattr(S, "GROUP_PIECES", limit)
    got = S.remove_repeats(fx.table(spark, extra=True)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(fx.documents(), 35)


def test_spans_and_empty(spark):
    for r in S.remove_repeats(fx.table(spark)).collect():
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
    assert S.remove_repeats(fx.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(fx.empty(spark), window=3)


def test_subtree_common_prefixes():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    starts = np.arange(0, 360)
    group = starts % 2
    order, common = S.subtree(words, group, starts, 35)
    for i in range(1, len(order)):
        a, b = starts[order[i - 1]], starts[order[i]]
        want = 0
        if group[order[i - 1]] == group[order[i]]:
            while want < 35 and words[a + want] == words[b + want]:
                want += 1
        assert common[i] == want


def test_a_third_of_all_rows_equal(spark):
    """3,000 equal rows share one passage with 200 others: all of it goes, and each task gives equal rows' pieces once."""
    rng = random.Random(8)
    passage = " ".join(fx.words(rng, 40))
    rows = [(1, f"one {passage} two")] * 3000 + [(10 + i, f"{' '.join(fx.words(rng, 10))} before{i} {passage} after{i} {' '.join(fx.words(rng, 9))}") for i in range(200)] + [(1000 + i, " ".join(fx.words(rng, 50))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = S.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_removed == (42 if r.doc_id == 1 else 40 if r.doc_id < 1000 else 0)
