"""Writers: JSON lines with previews, documents, metrics tables, registries, rewrites."""

from __future__ import annotations

import io
import json
import tarfile
import time
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import release, written

PREVIEW = 50


def preview(df: DataFrame, n: int = PREVIEW, order: str = "_ord") -> DataFrame:
    """The first n rows by order."""
    return df.orderBy(order).limit(n)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", order: str = "_ord", n: int = PREVIEW) -> int:
    """Rows as JSON lines, nulls kept and non-ASCII as it is; the first n beside them under previews. Returns the count, observed while writing.

    df is worked out once: with a preview, it is written to the shared folder first, and lines and preview come from there (a
    preview is a top-n by order: each task keeps its n least rows, nothing is sorted as a whole).
    """
    with_preview = bool(n) and order in df.columns
    staged = written(df, "staged") if with_preview else df
    seen = Observation()
    rows = staged.drop(order) if order in df.columns else staged
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", False).json(path)
    if with_preview:
        preview(staged, n, order).drop(order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path.rstrip('/')}.preview_{n}")
        release(staged)
    return int(seen.get["n"])


def preview_of(spark: SparkSession, path: str, n: int = PREVIEW, skip_blank: bool = True) -> list[str]:
    """The first n lines of written text files, in file order, without the blank ones if so asked; reads no more than the head."""
    from .readers import file_order

    lines = spark.read.text(path).select("value", file_order().alias("_ord"))
    good = lines.where(F.trim("value") != "") if skip_blank else lines
    return [r.value for r in good.orderBy("_ord").limit(n).collect()]


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("src_lang", "tgt_lang"), mode: str = "overwrite") -> None:
    """One folder per direction. Rows of one direction may lie in many files, so none is written by a single task."""
    df.write.mode(mode).partitionBy(*keys).option("ignoreNullFields", False).json(path)


def write_document(value: object, path: str) -> None:
    """A small JSON document, written beside its place and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(target)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """All rows, and the rows of each corpus by pair."""
    metrics.orderBy("_ord" if "_ord" in metrics.columns else "pair").drop("_ord").coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{path}/all")
    metrics.drop("_ord").repartition("corpus").sortWithinPartitions("corpus", "pair").write.mode("overwrite").partitionBy("corpus").option("header", True).option("emptyValue", "").csv(f"{path}/by_corpus")


def registration(file_name: str, formatting: str = "alpaca", columns: Mapping[str, str] | None = None) -> dict:
    """A registry's entry for one data file."""
    return {"file_name": file_name, "formatting": formatting, "columns": dict(columns or {"prompt": "instruction", "query": "input", "response": "output"})}


def upsert_registry(path: str, entries: Mapping[str, Mapping], overwrite: bool = False) -> dict:
    """Merges entries into a JSON object on disk (or replaces it); anything but an object there is an error."""
    target = Path(path)
    old = {}
    if target.exists() and not overwrite:
        old = json.loads(target.read_text(encoding="utf-8"))
        if not isinstance(old, dict):
            raise ValueError(f"not a JSON object: {path}")
    merged = {**old, **{k: dict(v) for k, v in entries.items()}}
    write_document(merged, path)
    return merged


def rewrite_column(df: DataFrame, column: str, value: Column) -> tuple[DataFrame, int]:
    """df with column set to value, and how many rows that changes; the caller writes to a new folder and renames it."""
    changed = df.where(~F.col(column).eqNullSafe(value)).count()
    return df.withColumn(column, value), changed


def replace_folder(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes df as JSON lines beside path, then takes its place: the old folder steps aside by a rename and goes only when the new one is there."""
    fs = spark._jvm.org.apache.hadoop.fs
    target, part, old = (fs.Path(path.rstrip("/") + end) for end in ("", ".part", ".old"))
    df.write.mode("overwrite").option("ignoreNullFields", False).json(str(part))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        system.delete(old, True)
        if not system.rename(target, old):
            raise OSError(f"could not move {path} aside")
    if not system.rename(part, target):
        system.rename(old, target)
        raise OSError(f"could not rename to {path}")
    system.delete(old, True)


#: How the empty files begin that name a published table's versions.
POINTER = "current-"


def _folder(spark: SparkSession, path: str) -> tuple[object, list]:
    """The file system of a folder, and what is in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [s.getPath() for s in system.listStatus(p)] if system.exists(p) else []


def publish(spark: SparkSession, df: DataFrame, path: str, dry_run: bool = False, keep: int = 1) -> str | None:
    """Makes df (JSON lines) the table at path: a version of its own below path, and then an empty file that names it.

    The greatest name counts, so readers by read_published see the old version until that one file is there, and the new one
    from then on: never none and never both. keep older versions stay, for readers that began before. With dry_run nothing is
    written: df is worked out and None returned.
    """
    if dry_run:
        df.write.format("noop").mode("overwrite").save()
        return None
    root = path.rstrip("/")
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.option("ignoreNullFields", False).json(f"{root}/{version}")
    system, _ = _folder(spark, root)
    system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}{version}"), False).close()
    _, there = _folder(spark, root)
    names = {p.getName(): p for p in there}
    old = sorted(n for n in names if n.startswith("v") and n < version)
    for name in (n for n in names if n.startswith(POINTER) and n.removeprefix(POINTER) < version):
        system.delete(names[name], False)
    for name in old[: len(old) - keep] if keep else old:
        system.delete(names[name], True)
    return version


def published(spark: SparkSession, path: str) -> str:
    """The folder of the current version of a published table."""
    root = path.rstrip("/")
    versions = [p.getName().removeprefix(POINTER) for p in _folder(spark, root)[1] if p.getName().startswith(POINTER)]
    if not versions:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{root}/{max(versions)}"


def read_published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(published(spark, path))


def copy_table(spark: SparkSession, src: str, dst: str, schema: str, overwrite: bool = False) -> int:
    """Copies JSON lines unless dst is there already (or is src); the number of rows at dst, 0 where src is missing."""
    fs = spark._jvm.org.apache.hadoop.fs

    def there(p: str) -> bool:
        return fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(p))

    if not there(src):
        return 0
    if src != dst and (overwrite or not there(dst)):
        spark.read.schema(schema).json(src).write.mode("overwrite").option("ignoreNullFields", False).json(dst)
    return spark.read.schema(schema).json(dst).count()


def reversed_pairs(pairs: DataFrame, instruction: Column) -> DataFrame:
    """The other direction of Alpaca pairs: input and output change places, meta names the row it came from."""
    meta = F.struct(F.sha1("input").alias("reversed_from"))
    return pairs.select(instruction.alias("instruction"), F.col("output").alias("input"), F.col("input").alias("output"), meta.alias("meta"), "_ord")


def quarantine(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without, and rows with, an error."""
    return items.where("error is null"), items.where("error is not null")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def bundle(paths: Mapping[str, str], target: str) -> None:
    """A tar of small assets, by name in the archive."""
    with tarfile.open(target, "w:gz") as tar:
        for name, path in paths.items():
            tar.add(path, arcname=name)


def render_config(values: Mapping[str, object]) -> str:
    """A YAML training configuration, mappings and lists nested; a key without a value is a section, as a comment."""
    out = io.StringIO()

    def scalar(value: object) -> str:
        return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int | float) else json.dumps(str(value), ensure_ascii=False)

    def lines(part: Mapping[str, object], indent: str) -> None:
        for key, value in part.items():
            if value is None:
                out.write(f"\n{indent}### {key}\n")
            elif isinstance(value, Mapping):
                out.write(f"{indent}{key}:\n")
                lines(value, indent + "  ")
            elif isinstance(value, list | tuple):
                out.write(f"{indent}{key}: [{', '.join(map(scalar, value))}]\n")
            else:
                out.write(f"{indent}{key}: {scalar(value)}\n")

    lines(values, "")
    return out.getvalue()


def heat_map(rows: Sequence[Mapping], languages: Sequence[str], least: float, most: float, title: str = "", size: int = 48) -> str:
    """A score matrix (rows of metrics.score_matrix) as an SVG drawing: darker is more; with a negative least the scale parts at 0. A row per language, so small."""
    from xml.sax.saxutils import escape

    by, cells = {r["src"]: r for r in rows}, []
    for i, src in enumerate(languages):
        cells.append(f'<text x="{2 * size - 4}" y="{(i + 1.6) * size}" text-anchor="end">{escape(src)}</text><text x="{(i + 2.5) * size}" y="{0.8 * size}" text-anchor="middle">{escape(src)}</text>')
        for j, tgt in enumerate(languages):
            value = by[src][tgt] if src in by else None
            if value is None:
                fill, shown = "#eeeeee", ""
            else:
                share = min(1.0, abs(value) / max(abs(least), abs(most))) if least < 0 else min(1.0, max(0.0, (value - least) / (most - least))) if most > least else 1.0
                pale = round(255 * (1 - 0.8 * share))
                fill, shown = f"rgb(255,{pale},{pale})" if value < 0 else f"rgb({pale},{pale},255)", f"{value:.1f}"
            cells.append(f'<rect x="{(j + 2) * size}" y="{(i + 1) * size}" width="{size}" height="{size}" fill="{fill}"/><text x="{(j + 2.5) * size}" y="{(i + 1.6) * size}" text-anchor="middle">{shown}</text>')
    wide, high = (len(languages) + 2) * size, (len(languages) + 1) * size
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-size="{size // 4}"><title>{escape(title)}</title>{"".join(cells)}</svg>'
