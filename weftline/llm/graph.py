"""Connected components over an edge list, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) for every node of edges a, b. Loops until a large-star and small-star pass change nothing.

    Least neighbours are written before they meet the edges: a small table is broadcast, and a large one joins by plain
    exchanges, of which AQE splits that of a hub. Each pass's tables go when the next is written.
    """
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc", *mark)
    if not now.measured["n"]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = both.join(bounded_broadcast(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(bounded_broadcast(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "cc-small", *mark)
        same = new.measured == now.measured
        release(now, least, large, low)
        now = new
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
