import fixtures_llm as fx
import numpy as np

from weftline.llm import sharding as S


def test_permutation_is_a_bijection_and_inverts():
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        x = np.arange(n)
        y = S.permute(x, n, 7)
        assert sorted(y) == list(x)
        assert (S.invert(y, n, 7) == x).all()
    assert (S.permute(np.arange(1000), 1000, 7) != S.permute(np.arange(1000), 1000, 8)).any()


def test_rows_law(spark):
    import zlib

    rows = fx.documents()
    got = S.assign_shards(fx.table(spark, extra=True)).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want


def test_reruns_agree_and_empty(spark):
    a = sorted((str(r.doc_id), r.shard, r.slot) for r in S.assign_shards(fx.table(spark)).collect())
    b = sorted((str(r.doc_id), r.shard, r.slot) for r in S.assign_shards(fx.table(spark).repartition(7)).collect())
    assert a == b
    assert S.assign_shards(fx.empty(spark)).count() == 0


def test_a_row_thousands_of_times_over(spark):
    """20,000 equal rows of 60,000: numbered without gaps, and no partition holds them all."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}  # else these few bytes are one partition
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    numbered, n = S.number_rows(rows, ["id"])
    for k, v in before.items():
        spark.conf.set(k, v)
    assert n == 60000 and numbered.agg(F.count_distinct("_number"), F.min("_number"), F.max("_number")).first()[:] == (60000, 0, 59999)
    held = [r["count"] for r in numbered.where("id = -1").groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 20000 and max(held) < 14000
    assert numbered.where("id = -1").agg(F.max("_number")).first()[0] == 19999
