"""Directions, parallel corpora, projections and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.text import first_nonblank, nonblank, normalize_space, once, script_ratio, strip
from ..storage import bounded_broadcast, quoted, written


def expand_directions(groups: DataFrame, bidirectional: bool = True, same_language: bool = False) -> DataFrame:
    """src_lang, tgt_lang, _ord over groups (group, pos, lang): every language of a group with every one of a later group.

    A bag: languages in several groups give a direction several times. Pairs of one language are left out unless asked for.
    """
    a = groups.select(F.col("group").alias("g1"), F.col("pos").alias("p1"), F.col("lang").alias("a"))
    b = groups.select(F.col("group").alias("g2"), F.col("pos").alias("p2"), F.col("lang").alias("b"))
    crossed = a.join(b, F.col("g1") < F.col("g2"))  # configured languages: dozens of rows
    if not same_language:
        crossed = crossed.where("a <> b")
    ways = [F.struct(F.lit(0).alias("way"), F.col("a").alias("src_lang"), F.col("b").alias("tgt_lang"))]
    if bidirectional:
        ways.append(F.struct(F.lit(1).alias("way"), F.col("b").alias("src_lang"), F.col("a").alias("tgt_lang")))
    flat = crossed.select("g1", "g2", "p1", "p2", F.explode(F.array(*ways)).alias("d"))
    return flat.select("d.src_lang", "d.tgt_lang", F.struct("g1", "g2", "p1", "p2", "d.way").alias("_ord"))


def group_table(spark: SparkSession, groups: Sequence[Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(g, p, lang) for g, langs in enumerate(groups) for p, lang in enumerate(langs)], "group int, pos int, lang string")


def directions_of(sources: Sequence[str], targets: Sequence[str], bidirectional: bool = True) -> list[tuple[str, str]]:
    """Ordered distinct directions of two language lists."""
    found = []
    for a in sources:
        for b in targets:
            if a != b:
                found += [(a, b), (b, a)] if bidirectional else [(a, b)]
    return names.ordered_distinct(found)


def distinct_directions(pairs: DataFrame) -> DataFrame:
    """Distinct directions, at the place where each came first."""
    return pairs.groupBy("src_lang", "tgt_lang").agg(F.min("_ord").alias("_ord"))


def parallel_corpus(src: DataFrame, tgt: DataFrame, dataset: str, split: str, src_lang: str, tgt_lang: str) -> DataFrame:
    """Evaluation items of the ids (as strings) that both language tables have."""
    joined = src.withColumnRenamed("sentence", "source_text").join(tgt.withColumnRenamed("sentence", "reference_text"), "sample_id")
    return joined.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"), "sample_id", "source_text", "reference_text")


ENGLISH_COLUMNS = ("eng", "english", "en", "eng_latn", "source", "src")


def english_column(df: DataFrame) -> Column:
    """Filled text of the first column, in table order, whose lower-case name is one for English."""
    found = [F.col(f"`{c}`") for c in df.columns if c.lower() in ENGLISH_COLUMNS]
    return first_nonblank(*found) if found else F.lit(None).cast("string")


def target_column(df: DataFrame, lang: str) -> Column:
    """Filled text of a language's column: its code, with a hyphen, its stem, or any column that starts with the stem."""
    stem = lang.split("_")[0]
    exact = [c for c in dict.fromkeys((lang, lang.replace("_", "-"), stem)) if c in df.columns]
    fuzzy = [c for c in df.columns if c.lower().startswith(stem.lower())]
    found = [F.col(f"`{c}`") for c in dict.fromkeys([*exact, *fuzzy])]
    return first_nonblank(*found) if found else F.lit(None).cast("string")


def english_centric_items(df: DataFrame, dataset: str, split: str, tgt_lang: str, src_lang: str = "eng_Latn") -> DataFrame:
    """Items of a wide multilingual table; ids are split:row, counted before rows without both texts go.

    Rows bring their numbers: _row of a numbered reader (readers.with_row_numbers), else an _ord that is a whole number.
    """
    number = next((c for c in ("_row", "_ord") if c in df.columns and isinstance(df.schema[c].dataType, T.IntegralType)), None)
    if number is None:
        raise ValueError("rows have no numbers: read them numbered")
    rows = df.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"), F.concat(F.lit(f"{split}:"), F.col(number).cast("string")).alias("sample_id"), english_column(df).alias("source_text"), target_column(df, tgt_lang).alias("reference_text"), F.col("_ord" if "_ord" in df.columns else number).alias("_ord"))
    return rows.where("source_text is not null and reference_text is not null")


def translation_pair(df: DataFrame, src: str, tgt: str, column: str = "translation") -> DataFrame:
    """input, output from a map of translations, where both are filled."""
    picked = df.select("*", nonblank(F.col(column)[src]).alias("input"), nonblank(F.col(column)[tgt]).alias("output"))
    return picked.where("input is not null and output is not null")


def oriented(first: Column, second: Column, swapped: Column) -> tuple[Column, Column]:
    """The two sides as asked for: changed over where swapped."""
    return F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)


def asked_direction(src: str, tgt: str, canonical_src: str, canonical_tgt: str) -> bool | None:
    """Whether a file's columns must change places for the direction; None if it isn't that direction at all."""
    return False if (src, tgt) == (canonical_src, canonical_tgt) else True if (src, tgt) == (canonical_tgt, canonical_src) else None


def resolve_text(df: DataFrame, keys: Sequence[str], min_chars: int, longest: bool = True, normalize: bool = False, max_chars: int | None = None, min_latin: float | None = None) -> DataFrame:
    """text: the first of keys that is long enough (and Latin enough), else with longest the longest text of the row; rows without go.

    With max_chars a text is cut and stripped.
    """

    def fit(name: str) -> Column:
        c = normalize_space(F.col(f"`{name}`")) if normalize else strip(F.col(f"`{name}`"))

        def good(v: Column) -> Column:
            long = F.length(v) >= min_chars
            return F.when(long if min_latin is None else long & (script_ratio(v, "latin") >= min_latin), v)

        return once(c, good)

    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    found = [fit(k) for k in keys if k in texts]
    if longest and texts:
        ranked = F.array_max(F.transform(F.array(*[strip(F.col(f"`{t}`")) for t in texts]), lambda v, i: F.struct(F.coalesce(F.length(v), F.lit(-1)).alias("n"), (-i).alias("i"), v.alias("v"))))
        found.append(once(ranked, lambda r: F.when(r["n"] >= min_chars, r["v"])))
    value = F.coalesce(*found) if found else F.lit(None).cast("string")
    if max_chars is not None:
        value = strip(F.substring(value, 1, max_chars))
    rest = ["_ord"] if "_ord" in df.columns else []
    # a generator binds the text: the filter on it isn't pushed below, where all would be worked out again
    return df.select(F.inline(F.array(F.struct(value.alias("text")))), *rest).where("text is not null")


def both_filled(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both sides filled, stripped."""
    return df.withColumns({a: nonblank(F.col(a)), b: nonblank(F.col(b))}).where(f"{a} is not null and {b} is not null")


def alpaca(df: DataFrame, instruction: Column, source: str = "input", target: str = "output") -> DataFrame:
    return df.select(instruction.alias("instruction"), F.col(source).alias("input"), F.col(target).alias("output"), *(["_ord"] if "_ord" in df.columns else []))


def block(instruction: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.lit("\nInput: "), source, F.lit("\nResponse: "), target)


def blocks(df: DataFrame, keep_meta: bool = False) -> DataFrame:
    """Alpaca rows as text blocks: parts cleaned, rows with a blank part dropped."""
    clean = df.withColumns({c: normalize_space(F.col(c)) for c in ("instruction", "input", "output")}).where("instruction <> '' and input <> '' and output <> ''")
    extra = [c for c in (["meta"] if keep_meta else []) + ["_ord"] if c in df.columns]
    return clean.select(block(F.col("instruction"), F.col("input"), F.col("output")).alias("text"), *extra)


def first_rows(df: DataFrame, n: int, keys: Sequence[str] = (), order: str = "_ord") -> DataFrame:
    """The first n rows by order, of all or of each key."""
    if not keys:
        return df.orderBy(order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, key: Column, order: str = "_ord", narrow: bool = False) -> DataFrame:
    """The first row of each key; order tells the rows of a key apart. A null key is one key.

    Firsts are found on keys and orders alone, pre-aggregated, and only for keys that come more than once; rows are then kept or
    dropped where they are if the list of such keys is small, so that wide rows don't move. Narrow rows are aggregated in one pass.
    """
    if narrow:
        row = F.struct(*[F.col(quoted(c)) for c in df.columns])
        return df.groupBy(key.alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    slim = df.select(key.alias("_key"), F.col(order).alias("_at"))
    several = written(slim.groupBy("_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "repeated-keys")
    marked = df.select("*", key.alias("_own")).join(bounded_broadcast(several), F.col("_own").eqNullSafe(F.col("_key")), "left")
    return marked.where(F.col("_first").isNull() | (F.col("_first") == F.col(order))).select(*[F.col(quoted(c)) for c in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: str = "_ord") -> DataFrame:
    """The last row of each key."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def of_corpus(items: DataFrame, corpus: str) -> DataFrame:
    return items.where(F.lower(strip(F.col("eval_corpus"))) == corpus.strip().lower())


def supported_only(items: DataFrame, supported: DataFrame) -> DataFrame:
    """Items whose direction is in the (small) table of supported ones."""
    return items.join(supported.select("src_lang", "tgt_lang"), ["src_lang", "tgt_lang"], "left_semi")


REQUIRED = ("source_text", "reference_text", "src_lang", "tgt_lang", "hypothesis")


def validated(rows: DataFrame) -> DataFrame:
    """rows, failing on a missing column at once and on a null in one when it is read."""
    absent = [c for c in REQUIRED if c not in rows.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    at = next((F.concat(F.lit(word + " "), F.col(c).cast("string")) for c, word in (("_line", "line"), ("_row", "row"), ("_ord", "row")) if c in rows.columns), F.lit("a row"))
    bad = F.concat(at, F.lit(" lacks a required value"))
    checks = {c: F.when(F.col(c).isNull(), F.raise_error(bad).cast("string")).otherwise(F.col(c)) for c in REQUIRED}
    return rows.withColumns(checks)


def check_languages(asked: Sequence[str], allowed: Sequence[str], strict: bool = True) -> list[str]:
    """The asked languages that are allowed; with strict, any other is an error."""
    extra = [x for x in asked if x not in set(allowed)]
    if extra and strict:
        raise ValueError(f"languages not configured: {extra}")
    return [x for x in asked if x in set(allowed)]


def routed(items: DataFrame, experts: DataFrame, strict: bool = False) -> DataFrame:
    """Items with the adapter of their direction; the later of equal entries counts, blank ones don't. With strict a direction without one is an error."""
    good = experts.where((strip(F.col("src_lang")) != "") & (strip(F.col("tgt_lang")) != "") & (strip(F.col("adapter_name")) != ""))
    routes = good.groupBy(strip(F.col("src_lang")).alias("src_lang"), strip(F.col("tgt_lang")).alias("tgt_lang")).agg(F.max_by("adapter_name", "_ord").alias("routed_model"))
    if not strict:
        return items.join(routes, ["src_lang", "tgt_lang"])
    found = items.join(routes, ["src_lang", "tgt_lang"], "left")
    lacking = F.raise_error(F.concat(F.lit("no route: "), names.pair_of(F.col("src_lang"), F.col("tgt_lang")))).cast("string")
    return found.withColumn("routed_model", F.when(F.col("routed_model").isNull(), lacking).otherwise(F.col("routed_model")))


# What two providers' messages hold, by kind of error; lower-case phrases of the first are looked for in any case.
PROVIDER_ERRORS = {
    "deepseek": {"rate_limit": ("429",), "rate_limit_any_case": ("rate limit", "too many requests"), "content_filter": ("不安全", "敏感"), "content_filter_any_case": ("content filter", "safety", "sensitive", "unsafe")},
    "zhipu": {"rate_limit": ('"code":"1302"', "'code':'1302'", "Error code: 429", "达到速率限制", "请求频率"), "content_filter": ('"code":"1301"', "'code':'1301'", "contentFilter", "可能包含不安全或敏感内容")},
}


def provider_error_kind(error: Column, provider: str = "deepseek") -> Column:
    """rate_limit, content_filter or other, by what the provider's message holds; null stays null."""
    rules = PROVIDER_ERRORS[provider]

    def says(kind: str) -> Column:
        out = F.lit(False)
        for phrase in rules.get(kind, ()):
            out = out | error.contains(phrase)
        for phrase in rules.get(f"{kind}_any_case", ()):
            out = out | F.lower(error).contains(phrase)
        return out

    return F.when(error.isNull(), None).when(says("rate_limit"), "rate_limit").when(says("content_filter"), "content_filter").otherwise("other")


def merge_source_configs(defaults: Mapping[str, Mapping], pair: Mapping) -> dict[str, dict]:
    """Default sources with a pair's overrides, key by key; unknown sources are added."""
    out = {name: dict(cfg) for name, cfg in defaults.items()}
    overrides = pair.get("sources") or {}
    if not isinstance(overrides, Mapping):
        raise ValueError(f"pair sources must be an object: {pair!r}")
    for name, override in overrides.items():
        if not isinstance(override, Mapping) or not isinstance(out.get(name, {}), Mapping):
            raise ValueError(f"source config must be an object: {name}")
        out[name] = {**out.get(name, {}), **override}
    return out


def existing_languages(asked: DataFrame, available: DataFrame) -> DataFrame:
    return asked.join(available, "lang", "left_semi")


def missing_languages(asked: DataFrame, available: DataFrame) -> DataFrame:
    return asked.join(available, "lang", "left_anti")
