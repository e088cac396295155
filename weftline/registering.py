"""What registered queries share: the registry, the test tables, pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """The documents in order of their ids; for heavy work on the texts of a small table over all cores."""
    rows = table(spark, sf_dir, "documents")
    return (spread(rows) if heavy else rows).withColumn("_ord", F.col("doc_id"))


#: White space as the engine strips it, for DuckDB's regular expressions; its trim takes off blanks alone, no line ends.
SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


WS = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+', ' ', 'g')"
TURNS = "t AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input, output: a user's turn and the answer."""
    rows = table(spark, sf_dir, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(answers, ["conv_id", "turn"]).withColumn("_ord", F.struct("conv_id", "turn"))
