"""Tables written between the steps of iterative operators, and broadcasts of a proven size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one of our own only where that is unset and the session is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed at exit."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex[:12]}-{tag}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; whoever owns the folder clears it
            pass


def written(df: DataFrame, tag: str, *measures: Column) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, removed by release() or at exit.

    measures: named aggregates that are observed while writing, in the result's `measured`.
    """
    path = scratch_path(df.sparkSession, tag)
    seen = Observation() if measures else None
    (df.observe(seen, *measures) if seen else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    if seen:
        out.measured = seen.get
    return out


def release(*tables: DataFrame) -> None:
    """Removes written tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)
        _written.remove((t.sparkSession, t.written_at))


def quoted(name: str) -> str:
    """A column's name as it is, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


#: Rows and bytes up to which a side is broadcast; beyond, the join shuffles and splits skewed keys.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a count of rows and bytes proves df (written, or cheap to compute) small enough for a broadcast."""
    width = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            width = width + F.coalesce(F.octet_length(F.col(quoted(f.name))), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
            width = width + F.coalesce(F.octet_length(F.col(quoted(f.name)).cast("string")), F.lit(0))
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits_broadcast; unchanged otherwise."""
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df


#: Rows that go to a Python worker at a time, at most.
BATCH_ROWS = 2_000


def bounded_batches(docs: DataFrame) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS: rows here are whole texts, long ones too, of which the default of 10,000 would be held at once on either side."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, BATCH_ROWS)


#: Bytes up to which a file is taken to be one row group.
ONE_ROW_GROUP = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of one small file, dealt over all cores: its one row group is read by one task, however it is split, and work on its texts is worth the exchange. Others as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    alone = size <= ONE_ROW_GROUP and len(df.inputFiles()) == 1
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if alone else df
