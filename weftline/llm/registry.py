"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread
from . import decontamination, mixing, periodic_runs, retention, sharding, substring_dedup, url_filter
from .bpe import encode_texts, read_vocabulary
from .fingerprints import compare_with_next
from .license_scan import scan_licenses
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import learn, score_texts
from .retention import late_arrival, retention_matrix
from .secret_scan import scan_secrets
from .sharding import assign_shards
from .substring_dedup import remove_repeats
from .url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; documents of one small file over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, learn(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source as a tree: source / language / id, all in the directory of their source and language.

    So a document that is mostly licence wording speaks for its source's other documents of that language that have no
    licence of their own.
    """
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return scan_licenses(docs, "path")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "name")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_matrix(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"), ("2024-02-15 00:00:00", None), late_arrival())


def op12_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: a file of the driver; that of the public tokenizers if none is given."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    tables = read_vocabulary(vocabulary)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode_texts(docs, tables, decoded_col="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_sharding": op2_sharding, "op3_quality": op3_quality, "op4_decontamination": op4_decontamination, "op5_license_scan": op5_license_scan, "op6_fingerprints": op6_fingerprints, "op7_url_filter": op7_url_filter, "op8_near_dedup": op8_near_dedup, "op9_secret_scan": op9_secret_scan, "op10_mixing": op10_mixing, "op11_retention": op11_retention, "op12_bpe": op12_bpe, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op2_sharding": sharding.ORACLE, "op4_decontamination": decontamination.ORACLE, "op7_url_filter": url_filter.ORACLE, "op10_mixing": mixing.ORACLE, "op11_retention": retention.ORACLE, "op13_periodic_runs": periodic_runs.ORACLE}
