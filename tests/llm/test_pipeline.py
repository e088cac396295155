import hashlib
from collections import Counter

import corpus_pipeline as P
import fixtures_llm as fx
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = [(2000 + i, f"Doc {i}. " + " ".join(fx.words(__import__("random").Random(i), 120)) + ".", "en", f"s{i % 4}", 1) for i in range(200)]
    bad = [(3000 + i, "spam " * (30 + i), "en", "s1", 1) for i in range(60)]
    copies = [(4000 + i, good[0][1], "en", "s2", 1) for i in range(20)]
    rows = [*fx.documents(), *good, *bad, *copies]
    spark.createDataFrame(rows, fx.SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, good[5][1]), (2, "unrelated words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    seen = {"start": docs}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == seen["start"].columns
    ids = {k: Counter(r.doc_id for r in v.collect()) for k, v in seen.items()}
    assert not any(3000 <= i < 3060 for i in ids["quality"] if i) and all(i in ids["quality"] for i in range(2000, 2200))
    assert sum(i in ids["near_dedup"] for i in [2000, *range(4000, 4020)]) == 1 and all(i in ids["near_dedup"] for i in range(2001, 2200))
    assert 2005 not in ids["decontamination"] and all(i in ids["decontamination"] for i in (2001, 2004, 2006))
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and max(v for k, v in ids["mixing"].items() if k and k >= 2000) <= 2
    last = docs.collect()
    assert Counter(r.doc_id for r in last) == ids["mixing"]
    slots = {}
    for r in last:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_repeats(spark, folder):
    def digest():
        return Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest(), r.shard, r.slot) for r in P.run(spark, folder).collect())

    assert digest() == digest()


def test_stages_on_empty_tables_and_odd_names(spark, folder):
    for name, stage in P.STAGES:
        none = stage(spark, fx.empty(spark), folder)
        assert none.count() == 0 and set(fx.empty(spark).columns) <= set(none.columns), name
        odd = fx.table(spark, extra=True)
        out = stage(spark, odd, folder)
        want = [*[c for c in odd.columns if c not in ("shard", "slot")], "shard", "slot"] if name == "sharding" else odd.columns
        assert out.columns == want, name
        assert {r["a.b"] for r in out.select("`a.b`").collect()} <= {"x"}
        if name in ("sharding", "decontamination"):
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in stage(spark, fx.table(spark), folder).collect())
