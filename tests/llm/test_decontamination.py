import re
from collections import Counter

import fixtures_llm as fx

from weftline.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    grams = {}
    for item, t in items:
        w = words(t)
        if w:
            for i in range(max(1, len(w) - n + 1)):
                grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for r in docs:
        w, hit, found = words(r[1]), set(), set()
        for g, of in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= of
        out.append((r[0], len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def items():
    docs = fx.documents()
    return [(1, docs[7][1].upper()), (2, "  "), (3, None), (4, docs[3][1]), (10, docs[17][1]), (11, docs[2][1]), (12, docs[2][1]), (13, "Größe ÉTÉ")]


def test_against_brute_force(spark):
    docs = [*fx.documents(), (900, "die GRößE éTÉ größe ÉTÉ", "de", "s1", 3)]
    df = spark.createDataFrame(docs, fx.SCHEMA).repartition(3)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = D.judge(df, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == brute(docs, items())
    for r in got:
        assert sum(s.end - s.start for s in r.spans or []) == r.n_hit


def test_dropping_and_removing(spark):
    df, bench = fx.table(spark, extra=True), spark.createDataFrame(items(), "item_id long, text string")
    want = Counter({k: v for k, v in brute(fx.documents(), items()).items() if not k[4]})
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, *_), n in _by_id(want).items()})
    hit = {i: (n, h) for i, n, h, *_ in brute(fx.documents(), items()) if h}
    left = D.remove_spans(df, bench)
    assert left.columns == df.columns
    for r in left.collect():
        if r.doc_id in hit:
            n, h = hit[r.doc_id]
            assert len(r.text.split()) == n - h and r.text == " ".join(words(r.text))
    same = {r.doc_id: r.text for r in left.collect() if r.doc_id not in hit}
    assert all(same[r[0]] == r[1] for r in fx.documents() if r[0] in same)


def test_beyond_a_broadcast(spark):
    """The shuffled search finds what the broadcast one does."""
    df, bench = fx.table(spark, extra=True), spark.createDataFrame(items(), "item_id long, text string")
    found = [Counter((r.k1, r.pos, r.len, tuple(sorted(r["items"]))) for r in D.find_hits(df, bench, rows=rows).collect()) for rows in (500_000, 0)]
    assert found[0] == found[1] and sum(found[0].values()) > 50


def test_clashing_and_dotted_names(spark):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame(items(), "item_id long, text string")
    df = fx.table(spark, extra=True)
    odd = df.withColumns({c: F.lit("x") for c in ("a.b", "_o0", "_k1", "_body", "spans", "n_hit", "_row", "w", "pos", "k1")})
    for operator in (D.drop_contaminated, D.remove_spans):
        out = operator(odd, bench)
        assert out.columns == odd.columns and out.count() == operator(df, bench).count()


def _by_id(counts):
    out = Counter()
    for k, v in counts.items():
        out[(k[0],)] += v
    return out


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.judge(fx.empty(spark), none).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in D.judge(fx.table(spark), none).collect())
