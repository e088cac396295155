"""Queries against their SQL on rows that the test tables lack."""

import hashlib

from test_findings_r03 import SPACES, agrees

import __spark_entry__ as entry

PLAIN = " \t\n\x0c\r"  # white space to DuckDB's regular expressions


def made(spark, rows):
    """Documents of texts, sources and languages."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")


def test_f1_empty_texts_and_odd_names(spark, tmp_path):
    """Only the text is normalised: source and language stand behind it as they are, behind no text too."""
    rows = [(t, "src", "en") for c in PLAIN for t in ("", c, c * 3, f"{c}a b{c}", f"a{c}b", f"a {c}{c} b{c} ")]
    rows += [("a b", s, lang) for c in SPACES for s, lang in ((c, c), (f"{c}s", f"en{c}"), (f"s{c}{c}r", f"e{c}{c}n"))]
    rows += [("a", "", "en"), ("a", "src", ""), ("", "", ""), (None, "src", "en"), ("a", None, "en"), ("a", "src", None), ("a\x00 b \u200b c", "src", "en")]
    got = agrees(spark, tmp_path, "whitespace", documents=made(spark, rows))
    want = [(i, None if None in r else hashlib.md5(f"{' '.join(r[0].split())} {r[1]} {r[2]}".encode()).hexdigest()) for i, r in enumerate(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_f1_all_white_space_of_texts(spark, tmp_path):
    """The query's own rule, which is wider than its SQL's: each white space character in a text, within and at its ends."""
    texts = [t for c in SPACES for t in (c, f"{c}a b{c}", f"a{c}b", f"a {c}\n{c} b")]
    made(spark, [(t, "src", "en") for t in texts]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.out for r in entry.queries()["whitespace"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(f"{' '.join(t.split())} src en".encode()).hexdigest() for i, t in enumerate(texts)}
