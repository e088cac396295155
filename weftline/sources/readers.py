"""Readers. Each gives an _ord column, an orderable struct (file, split, row): the order of the files' lines.

Rows within a split keep their order under monotonically_increasing_id, splits are ordered by their offset, and files by
path, so no file is ever read by one task for the sake of its order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SOLID, SPACE, clean_definition, distinct_keys, first_nonblank, has_any, nonblank, normalize_space, strip, traditional_characters
from ..storage import bounded_broadcast, quoted, written


def file_order() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def with_row_numbers(rows: DataFrame) -> DataFrame:
    """rows with _row, their number over all files (from 0), and _line, that in their own file (from 1).

    rows come straight from a reader, with _ord and none left out since. A split's rows lie one after the other, so each is
    set off by the counts of the splits before: one row a split is summed, and no file is read by one task.
    """
    split = [F.col("_ord.file").alias("_file"), F.col("_ord.split").alias("_split")]
    counts = rows.groupBy(*split).agg(F.min("_ord.row").alias("_from"), F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offs = [(F.coalesce(F.sum("_count").over(w), F.lit(0)) - F.col("_from")).alias(name) for w, name in ((before, "_all"), (within, "_own"))]
    offsets = bounded_broadcast(written(counts.select("_file", "_split", *offs), "splits"))
    met = rows.join(offsets, (F.col("_ord.file") == F.col("_file")) & (F.col("_ord.split") == F.col("_split")))
    return met.select(*[F.col(quoted(c)) for c in rows.columns], (F.col("_ord.row") + F.col("_all")).alias("_row"), (F.col("_ord.row") + F.col("_own") + 1).alias("_line"))


def _parsed_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """value, _ord, _line and parsed (with _malformed) of the filled lines of JSON files, every line counted."""
    lines = with_row_numbers(spark.read.text(path).select("value", file_order().alias("_ord"))).where(strip(F.col("value")) != "")
    parsed = F.from_json("value", f"{schema}, _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    return lines.select("value", "_ord", "_line", parsed.alias("parsed"))


def malformed_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """file, line (from 1), value of the lines that aren't JSON of this schema."""
    return _parsed_lines(spark, path, schema).where("parsed._malformed is not null").select(F.col("_ord.file").alias("file"), F.col("_line").alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, missing_ok: bool = False, numbered: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the query. With missing_ok, no file gives no rows.

    numbered adds _row, the row's number from 0 over all files, blank lines not counted, and _line, the line of its file from
    1; a malformed line is then named by its number.
    """
    if missing_ok and isinstance(path, str) and not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, _ord struct<file:string,split:long,row:long>" + (", _row long, _line long" if numbered else ""))
    if not numbered:
        raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return raw.select("*", file_order().alias("_ord"))
    lines = _parsed_lines(spark, path, schema)
    bad = F.concat(F.col("_ord.file"), F.lit(", line "), F.col("_line").cast("string"), F.lit(": not JSON of the schema"))
    checked = F.when(F.col("parsed._malformed").isNotNull(), F.raise_error(bad).cast(lines.schema["parsed"].dataType)).otherwise(F.col("parsed"))
    # filled lines are counted anew: an id that is given after the filter has no gaps within a split
    filled = lines.select(checked.alias("parsed"), F.struct("_ord.file", "_ord.split", F.monotonically_increasing_id().alias("row")).alias("_ord"), "_line").withColumnRenamed("_line", "_at")
    fields = [f.name for f in lines.schema["parsed"].dataType.fields if f.name != "_malformed"]
    return with_row_numbers(filled).select(*[F.col("parsed").getField(c).alias(c) for c in fields], "_ord", "_row", F.col("_at").alias("_line"))


def read_lines(spark: SparkSession, path: str | Sequence[str], only_json: bool = False) -> DataFrame:
    """value: stripped raw lines without the blank ones; with only_json, without those that aren't JSON."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"), file_order().alias("_ord")).where("value <> ''")
    return lines.where(F.try_parse_json("value").isNotNull()) if only_json else lines


def parse_alpaca(lines: DataFrame) -> DataFrame:
    """input, output of raw lines that are JSON objects with both texts; others are dropped."""
    row = F.from_json("value", "input string, output string")
    return lines.select(nonblank(row["input"]).alias("input"), nonblank(row["output"]).alias("output"), "_ord").where("input is not null and output is not null")


def read_config(path: str, spark: SparkSession | None = None) -> dict:
    """A JSON document; with a session, from any store that Spark reads."""
    if spark is None:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def parse_scored_tsv(lines: DataFrame, kind: str) -> DataFrame:
    """text0, text1 of tab-separated lines: 'statmt' is score, text, text; 'allenai' is text, text and seven columns more or so."""
    cells = F.split("value", "\t")
    if kind == "statmt":
        rows = lines.where((F.size(cells) >= 3) & strip(cells[0]).try_cast("double").isNotNull())
        first, second = cells[1], cells[2]
    elif kind == "allenai":
        rows, first, second = lines.where(F.size(cells) >= 9), cells[0], cells[1]
    else:
        raise ValueError(f"unknown kind: {kind}")
    return rows.select(nonblank(first).alias("text0"), nonblank(second).alias("text1"), "_ord").where("text0 is not null and text1 is not null")


def spread_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, _ord of text files. Files that can't be split (packed ones) are read by a task each, so their lines are dealt over all cores before anything is done with them."""
    lines = spark.read.text(path).select("value", file_order().alias("_ord"))
    packed = any(f.lower().endswith((".gz", ".zst", ".xz", ".lz4", ".deflate")) for f in lines.inputFiles())
    return lines.repartition(max(spark.sparkContext.defaultParallelism, 2 * lines.rdd.getNumPartitions())) if packed else lines


def read_scored_tsv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse_scored_tsv(spread_lines(spark, path), kind)


def resolve_source(src: str, tgt: str, direct: Iterable[tuple[str, str]], mined: Iterable[tuple[str, str]], codes: Mapping[str, str], direct_url: str, mined_url: str) -> tuple[str, str, str, str] | None:
    """url, canonical source and target, and kind of a direction: as asked before reversed, direct before mined."""
    direct, mined = set(direct), set(mined)
    for a, b in ((src, tgt), (tgt, src)):
        if (a, b) in direct:
            return f"{direct_url}{a}-{b}.gz", a, b, "allenai"
        if (a, b) in mined:
            known = codes.get(a) and codes.get(b)
            return (f"{mined_url}{codes[a]}-{codes[b]}.bitextf.tsv.gz", a, b, "statmt") if known else None
    return None


def read_first_of(spark: SparkSession, attempts: Sequence[Callable[[SparkSession], DataFrame]], probe: int = 1) -> DataFrame:
    """The first reader that works: registry before raw files, one hub before another. Its first rows are read, so that one that only fails when read is passed over too."""
    last: Exception | None = None
    for attempt in attempts:
        try:
            found = attempt(spark)
            if probe:
                found.limit(probe).collect()
            return found
        except (PySparkException, Py4JJavaError, OSError) as error:
            last = error
    raise last or ValueError("no reader given")


def read_shards(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], max_shards: int | None = None) -> DataFrame:
    """The given (nested) columns of the first shards, by path."""
    return spark.read.parquet(*sorted(paths)[:max_shards]).select(*columns)


# Fixed value: a line of the public Chinese-English dictionary, 'traditional simplified [reading] /def/def/'.
DICTIONARY_LINE = r"^(\S+)\s+(\S+)\s+\[[^\]]*\]\s+/(.*)/$"


def parse_cedict(lines: DataFrame, traditional: str | None = None) -> DataFrame:
    """simplified, defs (cleaned, distinct by key, in order) of dictionary lines; terms with one of the traditional characters (default: those that Unicode's rules change) go."""
    pattern = DICTIONARY_LINE
    marks = traditional_characters(lines.sparkSession) if traditional is None else traditional
    rows = lines.select(strip(F.col("value")).alias("line"), "_ord").where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").rlike(pattern))
    cut = rows.select(F.regexp_extract("line", pattern, 2).alias("simplified"), F.split(F.regexp_extract("line", pattern, 3), "/").alias("parts"), "_ord")
    kept = F.filter("parts", lambda p: (p != "") & ~p.startswith("CL:"))
    cleaned = F.array_compact(F.transform(kept, clean_definition))
    # a generator binds the definitions: the filter on them isn't pushed below, where each would be cleaned again
    good = cut.where(~has_any(F.col("simplified"), marks)).select("simplified", F.inline(F.array(F.struct(cleaned.alias("defs")))), "_ord").where(F.size("defs") > 0)
    return good.withColumn("defs", distinct_keys(F.col("defs")))


def read_cedict(spark: SparkSession, path: str, traditional: str | None = None) -> DataFrame:
    return parse_cedict(spread_lines(spark, path), traditional)


def parse_word_pairs(lines: DataFrame, reverse: bool = False) -> DataFrame:
    """src, tgt: the first two words of each line; what follows isn't looked at."""
    first_two = f"^{SPACE}*+({SOLID}++){SPACE}++({SOLID}++)"
    a, b = (2, 1) if reverse else (1, 2)
    pair = F.struct(F.regexp_extract("value", first_two, a).alias("src"), F.regexp_extract("value", first_two, b).alias("tgt"))
    return lines.select(F.inline(F.array(pair)), "_ord").where("src <> ''")


def read_word_pairs(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    return parse_word_pairs(spark.read.text(path).select("value", file_order().alias("_ord")), reverse)


def read_metrics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Metrics files as text columns with their path; numbers are parsed where they are used."""
    schema = "corpus string, pair string, bleu string, bleu_tokenizer string, comet string, num string"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths).select("*", F.col("_metadata.file_path").alias("path"), file_order().alias("_ord"))


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path of the files of that name (or glob) anywhere below root, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return found.select("path").orderBy("path")


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """Pairs of a flat list, one a line, comma or space between; # starts a comment line."""
    out = []
    for raw in text.splitlines():
        line = raw.strip()
        if line and not line.startswith("#"):
            parts = line.replace(",", " ").split()
            if len(parts) != 2:
                raise ValueError(f"bad pair line: {raw!r}")
            out.append((parts[0], parts[1]))
    return out


def pair_limits(config: Mapping, default: int) -> list[tuple[str, str, int]]:
    """(src, tgt, limit) of a pairs configuration; no limit, or 0, is the default."""
    out = []
    for item in config.get("pairs", []):
        src, tgt = str(item.get("src_lang", "")).strip(), str(item.get("tgt_lang", "")).strip()
        if not src or not tgt:
            raise ValueError(f"bad pair item: {item!r}")
        out.append((src, tgt, int(item.get("limit") or default)))
    return out


def configured_languages(config: Mapping, keep_order: bool = False) -> list[str]:
    """Languages of an evaluation configuration's pair groups: sorted, or as first seen."""
    seen = dict.fromkeys(x for group in config.get("language_pair_groups", []) for x in group)
    return list(seen) if keep_order else sorted(seen)


ID_COLUMNS = ("id", "ID", "sentence_id", "seg_id")
SENTENCE_COLUMNS = ("sentence", "text", "Sentence", "TEXT")


def language_table(rows: DataFrame, order: str = "_ord") -> DataFrame:
    """sample_id, sentence of one language: first filled candidate columns, the later of equal ids.

    A table without a usable row fails when it is read, not while the plan is made.
    """
    ids = [F.col(c).cast("string") for c in ID_COLUMNS if c in rows.columns]
    texts = [F.col(c) for c in SENTENCE_COLUMNS if c in rows.columns]
    found = rows.select(F.coalesce(*ids, F.lit("")).alias("sample_id"), first_nonblank(*texts).alias("sentence"), F.col(order).alias("_ord")).where("sample_id <> '' and sentence is not null")
    out = found.groupBy("sample_id").agg(F.max_by("sentence", "_ord").alias("sentence"))
    # one row of counts guards the table: it raises if there is nothing to read
    none = F.when(F.col("n") == 0, F.raise_error(F.lit("no usable rows in the language table")))
    guard = found.select("sample_id").limit(1).agg(F.count(F.lit(1)).alias("n")).where(F.coalesce(none.cast("boolean"), F.lit(False)))
    return out.unionByName(guard.select(F.lit("").alias("sample_id"), F.lit("").alias("sentence")))


def sample_rows(rows: DataFrame, dataset: str, subset: str, split: str, id_col: str = "id", text_col: str = "text", metadata_col: str = "metadata") -> DataFrame:
    """Rows in the form of corpus samples: names of the corpus, id, text, and metadata as texts, dates and times in ISO form; metadata of another kind is empty."""
    empty = F.expr("cast(map() as map<string,string>)")
    kind = rows.schema[metadata_col].dataType if metadata_col in rows.columns else None

    def shown(value: Column, of: T.DataType) -> Column:
        if isinstance(of, T.TimestampType | T.TimestampNTZType):
            whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(value, "SSSSSS")
            return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        return value.cast("string")

    meta = empty
    if isinstance(kind, T.StructType) and kind.fields:
        meta = F.map_from_arrays(F.array(*[F.lit(f.name) for f in kind.fields]), F.array(*[shown(F.col(metadata_col).getField(f.name), f.dataType) for f in kind.fields]))
    elif isinstance(kind, T.MapType):
        meta = F.transform_values(metadata_col, lambda k, v: shown(v, kind.valueType))
    filled = F.when(F.col(metadata_col).isNotNull(), meta).otherwise(empty) if kind is not None else empty
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(subset).alias("subset"), F.lit(split).alias("split"), F.col(id_col).cast("string").alias("sample_id"), F.col(text_col).alias("text"), filled.alias("metadata"))


def first_split(tables: Mapping[str, DataFrame], order: Sequence[str] = ("test", "train", "validation", "dev", "default")) -> tuple[str, DataFrame] | None:
    """The first split, in probing order, that has rows."""
    for name in order:
        if name in tables and not tables[name].isEmpty():
            return name, tables[name]
    return None
