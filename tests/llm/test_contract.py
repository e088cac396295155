"""Each registered query, with its production parameters, on a small folder of tables: held against its SQL, or against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import fixtures_llm as fx
import pytest

from weftline.llm import registry as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
PAGES = [
    (1, "HTTP://A.Example.COM/en/7x?q#f", None), (2, "https://x.com/en/1", ""), (3, "http://net/de/1", "<p>no link</p>"), (4, "http://w.example.net/de/85", None), (5, None, None), (6, "nothing", None), (7, "http://É.COM/en/", None),
    (8, "http://a.fr/1", '<link rel="canonical" href="https://b.com/en/2?a=1&amp;b=2">'), (9, "https://b.com/en/2?a=1&b=2#top", None), (10, "http://q.fr/1", "<META HTTP-EQUIV=refresh content='0; url=/2'>"), (11, "http://q.fr/2", "<link href=http://r.fr rel=canonical>"),
    (12, "http://r.fr/", '<link rel=canonical href="//www.example.com/en/77">'), (13, "http://s.fr/d/e", '<link rel="canonical" href="f">'), (14, "http://s.fr/d/f", None), (15, "http://t.fr/", '<link rel="canonical" href="">'),
    (16, "http://u.fr/1", '<link rel=canonical href="http://b.org/es/1"><link rel=canonical href="http://net/de/1">'), (17, "http://v.fr?x", '<link rel="alternate canonical" href="?y">'), (18, "http://v.fr/?y", '<link rel=canonical href="mailto:a@b">'),
    (19, "http://w.fr/a", '<link rel=canonical href="http://o.org/es/9">'), (19, "http://w.fr/a", None), (None, "http://w.fr/a", None),
]


def documents():
    rows = fx.documents()
    secrets = ["é token=abcdef123 x", "api_key: 'zzzzzz9' AKIA" + "B" * 30, "0123456789abcdef" * 3, 'db_passphrase = "q;W1,e2R3t4" and password=short', "AKIA12 " + "ab" * 11]
    return rows + [(1000 + i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(secrets)] + [(1100 + i, "word " * (1 + i * 7 % 31) + f"w{i}", "en", f"z{i % 5}", 1) for i in range(120)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("contract"))
    rows = documents()
    spark.createDataFrame(rows, fx.SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1].upper()), (2, None), (10, rows[17][1]), (11, rows[2][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(R.oracle_sql().keys() - {"op11_retention"}))  # test_retention.py has that one
def test_against_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, found = R.queries()[name](spark, folder), con.sql(R.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    want = sorted(([plain(r[found.columns.index(c)]) for c in cols] for r in found.fetchall()), key=repr)
    assert got == want and len(got) == len(PAGES if "url" in name else documents())


def test_sharding_groups_and_columns(spark, folder):
    got = R.op2_sharding(spark, folder).collect()
    of = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), hashlib.md5((r[1] or "").encode()).hexdigest()) for r in documents())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.text_md5) for r in got) == of and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_quality_rules(spark, folder, tmp_path):
    got = R.op3_quality(spark, folder).collect()
    assert len(got) == len(documents())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # labels of held-out rows, and columns beside the text, don't touch the scores
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs.selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    again = R.op3_quality(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.score) for r in got) == Counter((r.doc_id, r.score) for r in again)


def test_licence_tree(spark, folder, tmp_path):
    """Licence texts and headers among the documents: a text that is mostly one speaks for its source and language."""
    more = [(2000, "Released under the MIT License.", "en", "lic", 1), (2001, "plain words", "en", "lic", 1), (2002, "plain words", "de", "lic", 1), (2003, "# SPDX-License-Identifier: GPL-2.0-only\nint x;", "de", "lic", 1), (2004, None, "en", "lic", 1), (2001, "plain words", "en", "lic", 1)]
    spark.createDataFrame(documents() + more, fx.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op5_license_scan(spark, str(tmp_path)).collect()
    want = Counter("/".join((r[3] or "unknown", r[2] or "unknown", "" if r[0] is None else str(r[0]))) for r in documents() + more)
    assert Counter(r.path for r in got) == want and all(r.license is None for r in got if r.doc_id is None or r.doc_id < 2000)
    found = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in got if r.doc_id is not None and r.doc_id >= 2000}
    assert found == {2000: ("MIT", "MIT", None), 2001: (None, "MIT", "lic/en"), 2002: (None, None, None), 2003: ("GPL-2.0", "GPL-2.0", None), 2004: (None, "MIT", "lic/en")}


def test_fingerprint_edits(spark, folder, tmp_path):
    rows = sorted({r[0]: r for r in documents() if r[0] is not None}.values())
    spark.createDataFrame(rows, fx.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in R.op6_fingerprints(spark, str(tmp_path)).collect()}
    prints = {}
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(rows):
        text, follow = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert prints.setdefault(edited, got[i].edited_fingerprint) == got[i].edited_fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert text != follow or got[i].near_next == 1
        assert text != edited or got[i].near_edited == 1


def test_near_classes(spark, folder):
    def shingles(text):
        w = WORD.findall(text)
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    rows = documents()
    texts = sorted({r[1] or "" for r in rows})
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            low, high = (sets[i] & sets[j]).total(), (sets[i] | sets[j]).total()
            if high and low / high >= 0.8 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    of = dict(zip(texts, group, strict=True))
    size, least = Counter(of[r[1] or ""] for r in rows), {}
    for r in rows:
        if r[0] is not None:
            least[of[r[1] or ""]] = min(r[0], least.get(of[r[1] or ""], r[0]))
    got = R.op8_near_dedup(spark, folder).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == Counter((r[0], least.get(of[r[1] or ""]), size[of[r[1] or ""]]) for r in rows)


def test_secret_columns(spark, folder):
    want = Counter()
    for r in documents():
        text = r[1] or ""
        base = sorted(((m.start(), k, m.end(), kind) for k, (kind, p, good) in enumerate(SECRETS) for m in p.finditer(text) if good(m)))
        digest = hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base).encode()).hexdigest()
        want[(r[0], *(sum(x[3] == kind for x in base) for kind, *_ in SECRETS), digest)] += 1
    got = R.op9_secret_scan(spark, folder).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("name:"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
    assert any("name:17:28" in r.spans for r in got if r.doc_id == 1003)
