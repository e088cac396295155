"""The corpus pipeline: STAGES over documents, each stage's rows written as Parquet and read again by the next.

Each stage works on all rows that its predecessor kept, whatever other columns they have and whatever these are called; texts of
any length are read whole, ties are settled by id and text, and an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import materialize
from weftline.llm.decontamination import drop_contaminated
from weftline.llm.mixing import take
from weftline.llm.near_dedup import keep_one
from weftline.llm.quality import keep_good, learn
from weftline.llm.sharding import shard_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents' labels, doesn't reject; all columns. Null texts are judged as empty ones, repeated rows alike."""
    return keep_good(docs, learn(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of equal or near-equal ones; all columns. Null texts equal empty ones, null ids come last, repeated rows leave one."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows; all columns. Null and empty texts stay, repeated rows are treated alike."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice; all columns. Documents without words are never taken; a null source is one of its own."""
    return take(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows with shard and slot, and all their columns but for such names. Null ids come last; rows that are equal in id and text are interchangeable."""
    return shard_rows(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier, the signatures and the keyed permutation can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; see the stages for nulls, ties and repeated rows."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
