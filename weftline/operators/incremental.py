"""Joins of evaluated items with stored results: re-assembly, resume, what is missing and what is extra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .pairs import keep_last

KEY = ("_corpus", "src_lang", "tgt_lang", "_sample")


def with_result_key(rows: DataFrame) -> DataFrame:
    """Adds the key of a result: corpus (or dataset), direction, sample id as text."""
    corpus = F.coalesce(F.nullif(F.col("eval_corpus"), F.lit("")), F.col("dataset")) if "eval_corpus" in rows.columns else F.col("dataset")
    return rows.withColumns({"_corpus": F.coalesce(corpus, F.lit("")), "_sample": F.coalesce(F.col("sample_id").cast("string"), F.lit(""))})


def matched(items: DataFrame, results: DataFrame, columns: Sequence[str] = ("hypothesis",)) -> DataFrame:
    """Items that have a result, with its columns, in the items' bag: repeated items stay, of equal results the last counts."""
    last = keep_last(with_result_key(results), KEY).select(*KEY, *columns)
    return with_result_key(items).drop(*columns).join(last, list(KEY)).drop("_corpus", "_sample")


def pending(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items without a result yet."""
    return with_result_key(items).join(with_result_key(results).select(*KEY), list(KEY), "left_anti").drop("_corpus", "_sample")


def extra(items: DataFrame, results: DataFrame) -> DataFrame:
    """Results of no item."""
    return with_result_key(results).join(with_result_key(items).select(*KEY), list(KEY), "left_anti").drop("_corpus", "_sample")


def evaluated(items: DataFrame, results: DataFrame) -> DataFrame:
    """What is scored: matched items, then results that belong to none."""
    return matched(items, results).unionByName(extra(items, results), allowMissingColumns=True)


def source_hash(rows: DataFrame) -> Column:
    """The hash a generated row names as its source, else that of its input."""
    own = F.sha1(strip(F.col("input")))
    return F.coalesce(F.nullif(F.col("meta.source_hash"), F.lit("")), own) if "meta" in rows.columns else own


def done_hashes(rows: DataFrame) -> DataFrame:
    return rows.select(source_hash(rows).alias("source_hash")).distinct()


def resume(sources: DataFrame, output: DataFrame) -> DataFrame:
    """Sources (with hash) that the output doesn't hold yet; only hashes are shuffled from the output."""
    return sources.join(done_hashes(output).withColumnRenamed("source_hash", "hash"), "hash", "left_anti")
