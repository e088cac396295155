"""Queries against their SQL on rows that the test tables lack."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline import table_queries
from weftline.functions import text
from weftline.operators import metrics, sampling
from weftline.plans import programs

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"


def agrees(spark, tmp_path, name, **tables):
    """The query's rows, which its SQL's rows must equal."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    return got


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_f1_ends_of_texts(spark, tmp_path):
    body = "a line of words " * 9
    texts = [e + body + e for e in SPACES for _ in range(3)] + [None, "", " \n", "x" * 99 + "\n", "x" * 99 + "\u200b"] * 3 + [body[:390] + "\n" * 20 + body] * 3
    got = agrees(spark, tmp_path, "resolve_text", documents=documents(spark, texts))
    assert len(got) == 3 * len(SPACES) + 3 + 3


def test_f2_matches_by_chunks(monkeypatch):
    """Counting holds no more tokens at a time than a chunk, or one row's, and counts the same."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sides = [pa.array([None if i % 11 == 0 else [f"w{w}" for w in rng.integers(0, 6, rng.integers(0, 30 if i % 17 else 90))] for i in range(200)], pa.list_(pa.string())) for _ in range(2)]
    want, seen, plain = metrics._matches(*sides), [], metrics._matches

    def watched(hyp, ref):
        seen.append((len(hyp), len(hyp.flatten()) + len(ref.flatten())))
        return plain(hyp, ref)

    monkeypatch.setattr(metrics, "_matches", watched)
    monkeypatch.setattr(metrics, "CHUNK_TOKENS", 100)
    assert (metrics._matches_by_chunks(*sides) == want).all()
    assert sum(n for n, _ in seen) == 200 and all(n == 1 or tokens <= 100 for n, tokens in seen)
    assert not len(metrics._matches_by_chunks(sides[0][:0], sides[1][:0]))


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f3_texts_are_cleaned_once(spark, tmp_path):
    body = "plain  words \n of a text " * 6
    texts = [body, " " + body, body[:50], "1 2 3 4 5 6 7 8 9 " * 9, body[:119].strip() + "  " + body, None, ""]
    got = agrees(spark, tmp_path, "resolve_ordered", documents=documents(spark, texts))
    assert [r[0] for r in got] == [0, 1, 4]
    one = entry.queries()["resolve_ordered"](spark, str(tmp_path))
    assert planned(one).count(f"{text.SPACE}+,  , 1") == 2  # title and text, each once


def test_f3_strip_and_spaces(spark):
    odd = [c for c in map(chr, range(0x3100)) if c.isspace()]
    assert sorted(text.SPACE_CHARS) == odd
    rows = spark.createDataFrame([(c, f"{c}a{c}b {c}") for c in map(chr, range(1, 0x3100))], "c string, v string")
    got = rows.select("c", text.strip(F.col("v")).alias("s"), text.normalize_space(F.col("v")).alias("n"), F.col("c").rlike(f"^{text.SOLID}$").alias("solid")).collect()
    assert len(got) == 0x30FF and all((r.s, r.n, r.solid) == (f"{r.c}a{r.c}b {r.c}".strip(), " ".join(f"{r.c}a{r.c}b {r.c}".split()), not r.c.isspace()) for r in got)


def test_f7_only_the_first_words_are_read(spark, tmp_path):
    texts = ["a b", " a\tb c d ", "alone", " alone ", "", None, "x\n\ny" + " z" * 50, "é ü"]
    got = agrees(spark, tmp_path, "word_pairs", documents=documents(spark, texts))
    assert got == [(0, "b", "a"), (1, "b", "a"), (6, "y", "x"), (7, "ü", "é")]
    assert "split(" not in planned(entry.queries()["word_pairs"](spark, str(tmp_path)))


def test_f9_has_any_looks_up_what_is_in_range(spark, tmp_path):
    texts = ["plain", "一丁", "x體y", "書", None, "", "a 中 b", "ก後"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.has_any(F.col("t"), text.TRADITIONAL_MARKS).alias("any"), text.has_any(F.col("t"), "^-]").alias("marks"))
    assert [r.any for r in rows.collect()] == [None if t is None else any(c in text.TRADITIONAL_MARKS for c in t) for t in texts]
    assert "regexp_replace" in planned(rows)
    agrees(spark, tmp_path, "script_ratios", documents=documents(spark, ["plain text", "x y words", "a  b\n9", "z" * 40]))


def test_f10_definitions_are_cleaned_once_over_all_cores(spark, tmp_path):
    part = spark.createDataFrame([(i, f"name {i}", "STEEL", "Brand#1") for i in range(40)], "p_partkey long, p_name string, p_type string, p_brand string")
    agrees(spark, tmp_path, "parse_cedict", part=part)
    plan = planned(entry.queries()["parse_cedict"](spark, str(tmp_path)))
    assert plan.count("surname ") == 1 and "Repartition" in plan


def test_f8_pages_lie_by_the_thousand(spark, tmp_path, monkeypatch):
    """As many folders as shelves of a thousand pages, not as pages."""
    made = []
    monkeypatch.setattr(table_queries, "scratch_path", lambda *_: made.append(f"file://{tmp_path}/pages") or made[0])
    events = spark.range(0, 250_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"))
    got = agrees(spark, tmp_path, "pulled_scan", events=events)
    assert len(got) == 300
    assert len(list((tmp_path / "pages").glob("*=*"))) == 3


def test_f5_texts_are_packed_in_batches_and_move_once(spark, monkeypatch):
    """Packing and script checks are Arrow functions, no folds and replacements that Spark interprets; pieces are written where they are made."""
    texts = ["one sentence here. " * 30, "another one; " * 40, "12 34 56. " * 50, "one sentence here. " * 30, None, "short text, twenty chars"]
    found = sampling.candidates(documents(spark, texts).withColumn("_ord", F.col("doc_id")), F.col("lang"), 20, 100)
    assert "array_append" not in planned(found) and "[A-Za-z]" not in planned(found)
    plans, plain = {}, sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, tag, *measures: plans.setdefault(tag, planned(df)) and plain(df, tag, *measures))
    got = {r._ord: r.pos for r in sampling.greedy_sources(found).collect()}
    assert got == {0: 0, 1: 0, 5: 0} and "Window" not in plans["pieces"]


def test_f5_a_document_that_stands_there_twice(spark):
    """Rows of one id pass for one document: one row at most, the first candidate by place, then hash."""
    rows = [(7, "en", 0, "b", "b"), (7, "en", 0, "b", "b"), (7, "en", 0, "a", "a"), (8, "en", 0, "a", "a"), (8, "en", 1, "c", "c"), (8, "en", 1, "c", "c")]
    got = sampling.greedy_sources(spark.createDataFrame(rows, "_ord long, lang string, pos int, text string, hash string"))
    assert sorted(tuple(r) for r in got.select("lang", "_ord", "pos", "hash", "text").collect()) == [("en", 7, 0, "a", "a"), ("en", 8, 1, "c", "c")]


def test_f5_share_of_latin_letters(spark):
    texts = [None, "", " ", "a", "é", "a　b\x85", "  x1 ", "1\x1c2", "Zz[`@{", "กขค a", "国a", "\U0001d4b3y z", "one, two; three. " * 9]
    rows = documents(spark, texts)
    assert rows.where(~text.script_ratio(F.col("text"), "latin").eqNullSafe(text.latin_ratio(F.col("text")))).count() == 0


def test_f11_only_texts_that_are_asked_for_move(spark, monkeypatch):
    """The sources that wait for their turn are written without their texts."""
    texts = [f"the words of document number {i} are these. " * (1 + i % 3) for i in range(40)] + ["the words of document number 3 are these. "] * 3
    docs = documents(spark, texts).withColumn("_ord", F.col("doc_id"))
    columns, plain = {}, sampling.written
    for module in (sampling, programs):
        monkeypatch.setattr(module, "written", lambda df, tag, *measures: columns.setdefault(tag, df.columns) and plain(df, tag, *measures))
    done = sampling.candidates(docs.where("doc_id < 5"), F.lit("eng_Latn")).select(F.col("hash").alias("source_hash"))
    got = programs.synthetic_pairs(docs, "eng_Latn", "spa_Latn", lambda prompt: "no" if "number 9 " in prompt else "กข" if prompt.endswith("8 are these.") else prompt[-12:], 9, done, over=1.0)
    rows = sorted((r._ord, r.output) for r in got.collect())
    assert [r[0] for r in rows] == [n for n in range(5, 40) if n % 10 != 8][:9]
    assert [t for t, c in columns.items() if "text" in c] == ["pieces", "answers"]
