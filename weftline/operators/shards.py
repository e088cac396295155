"""Statistics of a corpus of Parquet shards that are kept by shard and merged: shards that are added cost only themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bounded_broadcast, written


def shard_partials(rows: DataFrame, key: Column, text: Column | None = None) -> DataFrame:
    """shard, key, rows, filled, chars, least, most: sums that can be added up, of each shard (file) and key of rows that come straight from files; a null or empty key is '(missing)'."""
    name = F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit("(missing)"))
    body = F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long") if text is not None else F.lit(0).cast("long")
    sums = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_chars") > 0).alias("filled"), F.sum("_chars").alias("chars"), F.min("_chars").alias("least"), F.max("_chars").alias("most")]
    return rows.select(_path(F.col("_metadata.file_path")).alias("shard"), name.alias("key"), body.alias("_chars")).groupBy("shard", "key").agg(*sums)


def _path(c: Column) -> Column:
    """A file's path in one way of writing: local files are file:/..."""
    return F.regexp_replace(F.regexp_replace(c, "^/+", "file:/"), "^file:/+", "file:/")


def update_statistics(spark: SparkSession, shards: Sequence[str] | DataFrame, store: str, key: Column, text: Column | None = None, max_shards: int | None = None) -> DataFrame:
    """Works out the partials of the shards that the store lacks, appends them, and gives the partials of the asked shards.

    shards: paths, or a table of them (path); max_shards takes the first by path. Shards are known by their path (one
    without a scheme is a local file's); a shard without rows is remembered too (key null, 0 rows). The store is a folder that all executors share; an append that fails
    leaves nothing behind that counts (partials of one run are one commit), and the next run does that work again.
    """
    asked = shards if isinstance(shards, DataFrame) else spark.createDataFrame([(p,) for p in shards], "path string")
    asked = asked.select(_path(F.col("path")).alias("shard")).distinct()
    asked = written(asked.orderBy("shard").limit(max_shards) if max_shards else asked, "asked-shards")
    known = spark.read.schema(PARTIAL).parquet(store) if _there(spark, store) else spark.createDataFrame([], PARTIAL)
    new = written(asked.join(known.select("shard").distinct(), "shard", "left_anti"), "new-shards", F.count(F.lit(1)).alias("n"))
    if new.measured["n"]:
        paths = [r.shard for r in new.collect()]  # names of files to read, which Spark's reader takes as a list
        found = shard_partials(spark.read.parquet(*paths), key, text)
        empty = new.join(found.select("shard").distinct(), "shard", "left_anti").select("shard", F.lit(None).cast("string").alias("key"), *[F.lit(0).cast("long").alias(c) for c in ("rows", "filled", "chars", "least", "most")])
        found.unionByName(empty).coalesce(1 + len(paths) // 1000).write.mode("append").parquet(store)
        known = spark.read.schema(PARTIAL).parquet(store)
    return known.join(bounded_broadcast(asked), "shard", "left_semi")


#: Columns of a store of partials.
PARTIAL = "shard string, key string, rows long, filled long, chars long, least long, most long"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merged(partials: DataFrame) -> DataFrame:
    """key, rows, filled, chars, least, most over all shards."""
    return partials.where("key is not null").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("rows", "filled", "chars")], F.min("least").alias("least"), F.max("most").alias("most"))


def language_statistics(partials: DataFrame, shards_total: int) -> DataFrame:
    """One row: total_rows, unique_languages, by_language (map), partial (whether shards are missing), shards_total, shards_processed, shard_paths."""
    nothing = F.lit(None).cast("string")
    parts = merged(partials).select("key", "rows", nothing.alias("shard")).unionByName(partials.select(nothing.alias("key"), F.lit(0).cast("long").alias("rows"), "shard").distinct())
    paths = F.array_sort(F.collect_list("shard"))
    languages = F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "rows"))))
    out = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.count("key").alias("unique_languages"), languages.alias("by_language"), paths.alias("shard_paths"))
    return out.select("total_rows", "unique_languages", "by_language", (F.size("shard_paths") < shards_total).alias("partial"), F.lit(shards_total).cast("long").alias("shards_total"), F.size("shard_paths").cast("long").alias("shards_processed"), "shard_paths")
