"""Operators whose way of working matters at scale, held against plain Python: windows of requests, BLEU sums, greedy ranges, row numbers, pulled scans, stored statistics, jobs side by side."""

import gzip
import itertools
import json
import random
import threading
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as text_functions
from weftline.operators import metrics, pairs, remote, sampling, shards
from weftline.plans import programs
from weftline.sources import paged, readers


def batches(sizes):
    n = 0
    for size in sizes:
        yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n, n + size)])], names=["t"])
        n += size


def test_a_slow_request_keeps_one_place_only():
    """Row 0 waits for the last row that may be asked for meanwhile: a window that waited for it would never end."""
    lock, open_now, most, asked, go = threading.Lock(), 0, 0, [], threading.Event()

    def call(t):
        nonlocal open_now, most
        with lock:
            open_now += 1
            most = max(most, open_now)
            asked.append(int(t))
        if t == "0":
            assert go.wait(20)
        if t == "39":
            go.set()
        time.sleep(0.002)
        with lock:
            open_now -= 1
        return f"<{t}>"

    got = list(remote.windowed(batches([10, 10, 10, 10, 10]), 0, call, 3, 4))
    assert [r for _, found in got for r in found] == [f"<{i}>" for i in range(50)] and [len(b) for b, _ in got] == [10] * 5
    assert most == 3 and sorted(asked) == list(range(50))


def test_window_holds_few_batches_and_passes_errors():
    pulled = []

    def source():
        for b in batches([2] * 30):
            pulled.append(b)
            yield b

    hold = threading.Event()
    windows = remote.windowed(source(), 0, lambda t: hold.wait(1) if t == "0" else t, 2, 3)
    next(windows)
    assert len(pulled) <= 6  # the slow one's batch, most_open behind it, and what went on meanwhile
    with pytest.raises(ZeroDivisionError):
        list(remote.windowed(batches([3]), 0, lambda t: 1 / 0, 2, 3))
    assert list(remote.windowed(iter(()), 0, str, 2, 3)) == [] and [f for _, f in remote.windowed(batches([0, 2]), 0, str, 2, 3)] == [[], ["0", "1"]]


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def test_clipped_matches_of_each_row():
    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(12))], [rng.choice("abcd") for _ in range(rng.randrange(12))]) for _ in range(400)] + [([], []), (["a"], []), ([], ["a"]), (["a"] * 50, ["a"] * 9)]
    got = metrics._matches(pa.array([h for h, _ in rows] + [None]), pa.array([r for _, r in rows] + [["x"]]))
    want = [[(grams(h, n) & grams(r, n)).total() for n in range(1, 5)] for h, r in rows] + [[0] * 4]
    assert got.tolist() == want
    assert metrics._matches(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))).shape == (0, 4)


def test_bleu_sums_in_one_exchange(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), [rng.choice("abcde") for _ in range(rng.randrange(20))], [rng.choice("abcde") for _ in range(rng.randrange(20))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, hyp array<string>, ref array<string>")
    found = metrics.bleu_statistics(df, ["k"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for r in found.collect():
        own = [(h, f) for k, h, f in rows if k == r.k]
        assert (r.num, r.hyp_len, r.ref_len) == (len(own), sum(len(h) for h, _ in own), sum(len(f) for _, f in own))
        for n in range(1, 5):
            assert r[f"m{n}"] == sum((grams(h, n) & grams(f, n)).total() for h, f in own) and r[f"t{n}"] == sum(max(0, len(h) - n + 1) for h, _ in own)


def greedy(rows):
    """lang, _ord, pos, hash in order: a pass over the documents."""
    taken, out = set(), []
    for (lang, order), group in itertools.groupby(sorted(rows), key=lambda r: r[:2]):
        for _, _, pos, h in group:
            if (lang, h) not in taken:
                taken.add((lang, h))
                out.append((lang, order, pos, h))
                break
    return sorted(out)


def table_of(spark, rows):
    return spark.createDataFrame([(o, lang, p, h, h) for lang, o, p, h in rows], "_ord long, lang string, pos int, text string, hash string").repartition(5)


@pytest.mark.parametrize("size", [7, 60, None])
def test_greedy_sources_in_ranges(spark, size):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "es"]), o, p, f"h{int(rng.random() ** 2 * 80)}") for o in range(150) for p in range(rng.randrange(1, 5))]
    rows = sorted({(("en" if o % 2 else "es"), o, p, h) for _, o, p, h in rows})
    rounds = []
    got = sampling.greedy_sources(table_of(spark, rows), size, rounds)
    assert sorted((r.lang, r._ord, r.pos, r.hash) for r in got.collect()) == greedy(rows)
    assert len(rounds) <= rounds[0] + 1


def test_a_chain_of_a_thousand(spark):
    """Each document wants what the one before it must take instead: one range settles it in a pass, ten ranges in ten at most."""
    chain = [("en", 0, 0, "h0")] + [x for i in range(1, 1000) for x in (("en", i, 0, f"h{i - 1}"), ("en", i, 1, f"h{i}"))] + [("en", 1000, 0, "h999")]
    want = greedy(chain)
    assert len(want) == 1000 and want[500][3] == "h500"
    for size, most in ((None, 1), (200, 12)):
        rounds = []
        got = sampling.greedy_sources(table_of(spark, chain), size, rounds)
        assert sorted((r.lang, r._ord, r.pos, r.hash) for r in got.collect()) == want and len(rounds) <= most


def test_row_numbers_over_splits(spark, tmp_path):
    """Files of several splits each: numbers go on from split to split and file to file; blank lines are lines, not rows."""
    want, n = [], 0
    for name in ("a", "b", "c"):
        lines = []
        for k in range(400):
            if k % 7 == 3:
                lines.append("   " if k % 2 else "")
            else:
                lines.append(json.dumps({"i": n, "t": "x" * (k % 30)}))
                want.append((n, n, k + 1))
                n += 1
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_jsonl(spark, str(tmp_path), "i long, t string", numbered=True)
        assert rows.rdd.getNumPartitions() > 6
        assert sorted((r.i, r._row, r._line) for r in rows.collect()) == want
        (tmp_path / "d.jsonl").write_text('{"i": 1}\n\n{"i": \n{"i": "word"}\n')
        bad = readers.malformed_lines(spark, str(tmp_path), "i long, t string")
        assert sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in bad.collect()) == [("d.jsonl", 3, '{"i": '), ("d.jsonl", 4, '{"i": "word"}')]
        with pytest.raises(Exception, match=r"d\.jsonl, line [34]: not JSON"):
            readers.read_jsonl(spark, str(tmp_path), "i long, t string", numbered=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert readers.read_jsonl(spark, str(tmp_path / "none*"), "i long", missing_ok=True, numbered=True).columns == ["i", "_ord", "_row", "_line"]


def test_ids_of_a_read_file(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r) for r in ({"eng": "a", "spa": "b"}, {"eng": "c"}, {"eng": "e", "spa": "f"})))
    rows = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "eng string, spa string", numbered=True)
    assert [r.sample_id for r in pairs.english_centric_items(rows, "d", "test", "spa_Latn").orderBy("sample_id").collect()] == ["test:0", "test:2"]
    with pytest.raises(ValueError, match="numbers"):
        pairs.english_centric_items(readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "eng string, spa string"), "d", "test", "spa_Latn")
    (tmp_path / "h.jsonl").write_text('\n{"source_text": "a", "reference_text": "b", "src_lang": "s", "tgt_lang": "t", "hypothesis": "h"}\n{"source_text": "a"}\n')
    hyps = readers.read_jsonl(spark, str(tmp_path / "h.jsonl"), "source_text string, reference_text string, src_lang string, tgt_lang string, hypothesis string", numbered=True)
    with pytest.raises(Exception, match="line 3 lacks a required value"):
        pairs.validated(hyps).collect()


def test_packed_files_are_dealt_out(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.writelines(f"1.0\ta{i}\tb{i}\n" for i in range(1000))
    got = readers.read_scored_tsv(spark, str(tmp_path / "x.tsv.gz"), "statmt")
    assert got.rdd.getNumPartitions() >= 4 and [r.text0 for r in got.orderBy("_ord").collect()] == [f"a{i}" for i in range(1000)]


def test_traditional_characters(spark):
    """Characters that both standards have stay; a few count as Traditional all the same."""
    marks = text_functions.traditional_characters(spark)
    assert not set("俱姊藉乐学") & set(marks) and set("猛於著樂學") <= set(marks)
    lines = spark.createDataFrame([(f"x {t} [a] /some/",) for t in ("俱乐部", "姊妹", "凶猛", "樂", "猫")], "value string").withColumn("_ord", F.monotonically_increasing_id())
    assert [r.simplified for r in readers.parse_cedict(lines).orderBy("_ord").collect()] == ["俱乐部", "姊妹", "猫"]


WORDS = ["กา", "กาน", "การ", "งาน", "นา", "รง", "ดี", "มาก", "มา", "ก"]


def best_path(t):
    """All ways to cut t, by the rule: least outside, least pieces, longest first."""
    ways = []

    def go(i, parts, outside, open_):
        if i == len(t):
            ways.append((outside, len(parts), [-len(p) for p in parts], [p for p in parts]))
            return
        for w in WORDS:
            j = i + len(w)
            if t.startswith(w, i) and (j == len(t) or t[j] not in metrics.CLINGING):
                go(j, [*parts, w], outside, False)
        go(i + 1, [*parts[:-1], parts[-1] + t[i]] if open_ else [*parts, t[i]], outside + 1, True)

    go(0, [], 0, False)
    return min(ways)


def test_thai_words_take_the_best_path(spark):
    rng, root = random.Random(4), metrics._trie(WORDS)
    for _ in range(300):
        t = "".join(rng.choice([*WORDS, "ซ", "ุ"]) for _ in range(rng.randrange(1, 5)))
        outside, pieces, *_ = best_path(t)
        got = metrics.thai_path(t, root)
        assert "".join(got) == t and len(got) == pieces and sum(len(p) for p in got if p not in WORDS) == outside, (t, got, best_path(t))
    metrics.register_tokenizer("pythai_newmm", metrics.thai_words(WORDS))
    try:
        chosen = metrics.available_tokenizer(F.lit("pythai_newmm"), F.lit("tha_Thai"))
        df = spark.createDataFrame([("การงานดีมาก AB-c 1,200.5 !?",), (None,), ("",)], "t string")
        assert [r[0] for r in df.select(metrics.thai_words(WORDS)(F.col("t"))).collect()] == ["การ งาน ดี มาก AB-c 1,200.5 !?", None, ""]
        assert df.select(chosen.alias("c")).first().c.use == "pythai_newmm"
        assert df.select(metrics.tokenized(F.col("t"), chosen["use"]).alias("w")).first().w == ["การ", "งาน", "ดี", "มาก", "AB-c", "1,200.5", "!?"]
    finally:
        metrics.TOKENIZERS.pop("pythai_newmm")


def test_length_batches(spark):
    rng = random.Random(6)
    lengths = [min(900, int(rng.lognormvariate(4, 1))) for _ in range(3000)]
    parts = remote.length_batches(lengths, 8000)
    assert sorted(i for p in parts for i in p) == list(range(3000)) and remote.padding(lengths, parts) < 0.1
    assert all(len(p) == 1 or max(lengths[i] for i in p) * len(p) <= 8000 for p in parts)
    assert remote.length_batches([], 10) == [] and remote.length_batches([50, 1], 10) == [[0], [1]] and remote.padding([], []) == 0
    assert max(map(len, remote.length_batches([1] * 10, 100, most=3))) == 3

    def call(texts, src, tgt):
        if len(texts) > 1 and max(map(remote.count_words, texts)) * len(texts) > 60:
            raise ValueError("over the budget")
        return [f"{src}>{tgt}:{t.upper()}" for t in texts]

    rows = [(i, None if i == 5 else " ".join(["w"] * rng.randrange(20)), rng.choice(["a", "b"]), "t") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, source_text string, src_lang string, tgt_lang string").repartition(3)
    got = {r.i: r.hypothesis for r in remote.in_length_batches(df, call, 60, pool_rows=100).collect()}
    assert got == {i: f"{s}>{t}:{(x or '').upper()}" for i, x, s, t in rows}
    scored = df.selectExpr("i", "source_text", "source_text as hypothesis", "source_text as reference_text")
    sums = {r.i: r.score for r in remote.score_segments(scored, lambda s, h, r: [float(len(x or "")) for x in s], "i", 300).collect()}
    assert sums == {i: float(len(x or "")) for i, x, *_ in rows}


def test_padding_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lengths = [remote.count_words(t) for t in texts]
    assert remote.padding(lengths, remote.length_batches(lengths, 16384)) < 0.1


def test_one_process_a_partition(spark, tmp_path):
    log = tmp_path / "starts"
    script = f"import sys, os\nopen({str(log)!r}, 'a').write('x')\nfor line in sys.stdin:\n    print(line.strip()[::-1], flush=True)\n"
    rows = [(i, None if i == 3 else f"line {i}\nand é {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, source_text string").repartition(3)
    got = {r.i: r.hypothesis for r in remote.translate_lines(df, ["python", "-c", script], ahead=16).collect()}
    assert got == {i: (" ".join((t or "").splitlines()))[::-1] for i, t in rows} and log.read_text() == "xxx"
    for command, said in ((["python", "-c", "import sys; sys.stdin.readline(); sys.exit(3)"], "exit status 3"), (["python", "-c", "import sys\nfor x in sys.stdin: print(x.strip())\nprint('more')"], "more lines"), (["python", "-c", "import sys\nfor x in sys.stdin: print(x.strip())\nsys.exit(4)"], "exit status 4")):
        with pytest.raises(Exception, match=said):
            remote.translate_lines(df.limit(5), command).collect()


def test_request_options():
    assert remote.request_options("Qwen3-4B") == {"chat_template_kwargs": {"enable_thinking": False}} and remote.request_options("GLM5") == remote.request_options("deepseek") == {"thinking": {"type": "disabled"}}
    assert remote.request_options("M2.7") == {"reasoning_split": True} and remote.request_options("generic") is None is remote.request_options(None)


def test_a_pulled_scan_stops(spark, tmp_path):
    log = str(tmp_path / "pulled")

    def fetch(page):
        with open(log, "a") as f:
            f.write(f"{page}\n")
        return None if page >= 20 else [(page * 10 + i, f"t{page}") for i in range(10)]

    spark.dataSource.register(paged.paged_source("tens", "n long, t string", fetch))
    got = paged.pull_until(spark, "tens", 35, F.col("n") % 2 == 0, pages_at_a_time=3)
    assert [r.n for r in got.orderBy("_page", "_at").collect()] == list(range(0, 70, 2)) and got.next_page == 9
    assert sorted(map(int, open(log).read().split())) == list(range(9))  # each page once, none beyond the round that filled the quota
    rest = paged.pull_until(spark, "tens", 1000, F.col("n") % 2 == 0, pages_at_a_time=8, first=got.next_page)
    assert [r.n for r in rest.collect()] == list(range(90, 200, 2))
    assert paged.pull_until(spark, "tens", 5, first=50, pages_at_a_time=2).collect() == [] and paged.pull_until(spark, "tens", 500, pages_at_a_time=4, last=2).count() == 20
    assert paged.pull_until(spark, "tens", 0).collect() == []


def test_a_pulled_stream_goes_on_and_stops(spark, tmp_path):
    def fetch(page):
        return None if page >= 6 else [(page * 10 + i,) for i in range(10)]

    spark.dataSource.register(paged.paged_source("few", "n long", fetch))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run(quota, until):
        stream = spark.readStream.format("few").option("quota", quota).option("batch_pages", 2).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
        try:
            end = time.time() + 60
            while time.time() < end and (not query.lastProgress or spark.read.schema("n long, _page long, _at long").parquet(out).count() < until):
                query.processAllAvailable() if query.lastProgress else time.sleep(0.3)
            time.sleep(1)
        finally:
            query.stop()
        return sorted(r.n for r in spark.read.parquet(out).collect())

    assert run(25, 25) == list(range(25))
    more = run(45, 45)
    assert more[:25] == list(range(25)) and len(more) == len(set(more)) == 45


def test_added_shards_cost_only_themselves(spark, tmp_path):
    rng, want = random.Random(7), defaultdict(Counter)
    paths = []
    for k in range(5):
        rows = [(rng.choice(["en", "es", None, ""]), "x" * rng.randrange(9)) for _ in range(200 if k != 2 else 0)]
        path = str(tmp_path / f"shard{k}.parquet")
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())}), path)
        paths.append("file:" + path)
        for lang, text in rows:
            want[k][lang or "(missing)"] += 1
    store = str(tmp_path / "store")
    first = shards.update_statistics(spark, paths[:3], store, F.col("lang"), F.col("text"))
    one = shards.language_statistics(first, 5).first()
    assert one.partial and one.shards_processed == 3 and one.by_language == dict(want[0] + want[1]) and one.shard_paths == paths[:3]
    for p in paths[:3]:  # a run that read them again would fail
        (tmp_path / p.rsplit("/", 1)[1]).rename(tmp_path / (p.rsplit("/", 1)[1] + ".gone"))
    both = shards.update_statistics(spark, paths, store, F.col("lang"), F.col("text"))
    for p in paths[:3]:
        (tmp_path / (p.rsplit("/", 1)[1] + ".gone")).rename(tmp_path / p.rsplit("/", 1)[1])
    whole = shards.update_statistics(spark, paths, str(tmp_path / "other"), F.col("lang"), F.col("text"))
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert sorted(map(tuple, shards.merged(both).collect())) == sorted(map(tuple, shards.merged(whole).collect()))
    all_ = shards.language_statistics(both, 5).first()
    assert not all_.partial and all_.total_rows == 800 and all_.by_language == dict(sum(want.values(), Counter())) and all_.unique_languages == len(all_.by_language)
    assert shards.update_statistics(spark, paths, store, F.col("lang"), max_shards=2).select("shard").distinct().count() == 2


def test_a_failing_direction_leaves_the_rest(spark):
    def job(n):
        return lambda: spark.range(n).selectExpr("sum(id) as s").first().s

    seen = {}

    def noting():
        seen["pool"] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        seen["group"] = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        return 1

    runner = programs.Directions(spark, 3)
    tally = runner.run({"a": job(100), "bad": lambda: spark.sql("select raise_error('no')").collect(), "b": job(1000), "c": noting})
    assert [tally.outcomes[x].status for x in ("a", "bad", "b", "c")] == ["ok", "failed", "ok", "ok"] and tally.outcomes["b"].result == 499500
    assert tally.exit_status == 2 and seen["pool"] == seen["group"] == runner.group("c")
    assert programs.run_directions({"a": job(5)}, spark=spark).exit_status == 0


def test_cancelled_directions(spark):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    runner = programs.Directions(spark, 2)

    def long_one():
        return spark.range(0, 4000, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).first()[0]

    def stopper():
        time.sleep(3)
        runner.cancel("long")
        return "done"

    began = time.time()
    tally = runner.run({"long": long_one, "stop": stopper})
    assert tally.outcomes["long"].status == "cancelled" and tally.outcomes["stop"].status == "ok" and time.time() - began < 60 and tally.exit_status == 2
    strict = programs.Directions(spark, 1, stop_on_failure=True).run({"bad": lambda: 1 / 0, "never": lambda: 1})
    assert [o.status for o in strict.outcomes.values()] == ["failed", "cancelled"]


def lexicon_rows(rng, n):
    return [(rng.choice(["a", "b"]), rng.choice(["x", "y"]), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))), f"t{rng.randrange(9)}", rng.randrange(5) / 4, i) for i in range(n)]


def test_stored_lexicon(spark, tmp_path):
    """Lookups, searches and tables of terms from a stored index are those of the whole lexicon."""
    from weftline.operators import lexicon, lookup_index

    rng = random.Random(9)
    rows = lexicon_rows(rng, 600)
    index = spark.createDataFrame(rows, "src_lang string, tgt_lang string, source_text string, target_text string, confidence double, _ord int").withColumn("norm_key", F.col("source_text"))
    lookup_index.store(index, str(tmp_path / "lexicon"), buckets=3)
    stored = lookup_index.open_stored(spark, str(tmp_path / "lexicon"))

    def matches(k, key):
        return key in k or k in key

    for key, offset in (("a", 0), ("a", 7), ("", 3), ("abc", 0), ("abca", 1), ("bcabcaa", 0), ("zzzz", 0)):
        want = sorted((r for r in rows if r[:2] == ("a", "x") and matches(r[2], key)), key=lambda r: (r[2] != key, -r[4], len(r[2]), r[3], r[5]))
        got = stored.lookup("a", "x", key, 4, offset).collect()
        assert [r._ord for r in got] == [r[5] for r in want[offset : offset + 4]], key
        assert all((r.total_matches, r.has_more) == (len(want), offset + 4 < len(want)) for r in got)
    for key in ("b", "cab", "abcab"):
        best = sorted((r for r in rows if matches(r[2], key)), key=lambda r: (r[2] != key, -r[4], r[0], r[1], r[2], r[5]))
        assert [(r._ord, r.match_type) for r in stored.search(key, top_k=6).collect()] == [(r[5], "exact" if r[2] == key else "contains") for r in best[:6]]
        assert [r._ord for r in stored.search(key, "b", top_k=3).collect()] == [r[5] for r in best if r[0] == "b"][:3]
    terms = spark.createDataFrame([(t, t) for t in ["", "a", "ab", "abc", "abca", "cabcab", "zz", "zzzz"]], "term_id string, key string")
    a, b = (sorted((r.term_id, r.rank, r._ord, r.match_type) for r in x.lookup_terms(*y, 5).collect()) for x, y in ((stored, (terms,)), (lexicon, (index, terms))))
    assert a == b and len(a) > 20


def test_a_hot_term_reads_its_first_ranks_only(spark, tmp_path):
    from weftline.operators import lookup_index

    index = spark.range(6000).selectExpr("'a' as src_lang", "'x' as tgt_lang", "concat('term e', id) as source_text", "cast(id % 7 as double) as confidence", "concat('term e', id) as norm_key", "id as _ord")
    stored = lookup_index.store(index, str(tmp_path / "lexicon"))
    anchor = stored.anchor("e")
    assert anchor[2] == 6000 and stored.count("e", ("a", "x")) == 6000
    plan = stored.holders("e", "direction", ("a", "x"), [0], anchor)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = plan._jdf.queryExecution().explainString(mode)
    pruned = text.split("PartitionFilters: [")[1].split("\n")[0]
    assert "(b#" in pruned and "(level#" in pruned and "EqualTo(piece,e)" in text
    assert plan.count() == 1024
    assert [r.confidence for r in stored.lookup("a", "x", "e", 5, 2).collect()] == [6.0] * 5


def test_a_plan_runs_once_for_lines_and_preview(spark, tmp_path):
    from weftline.sources import writers

    log = str(tmp_path / "rows")

    def noted(x):
        with open(log, "a") as f:
            f.write("x")
        return x

    df = spark.range(0, 300, 1, 3).select(F.udf(noted, "long")("id").alias("v"), (-F.col("id")).alias("_ord"))
    assert writers.write_jsonl(df, str(tmp_path / "out"), n=4) == 300
    assert len(open(log).read()) == 300 and [json.loads(x)["v"] for x in writers.preview_of(spark, str(tmp_path / "out.preview_4"))] == [299, 298, 297, 296]


def test_published_tables_are_never_missing(spark, tmp_path):
    from weftline.sources import writers

    path = str(tmp_path / "table")
    assert writers.publish(spark, spark.range(3), path, dry_run=True) is None and not (tmp_path / "table").exists()
    first = writers.publish(spark, spark.range(3), path)
    old = writers.read_published(spark, path, "id long")
    assert old.count() == 3
    stop, seen = threading.Event(), []

    def watch():
        while not stop.is_set():
            seen.append(writers.published(spark, path).rsplit("/", 1)[1])

    watcher = threading.Thread(target=watch)
    watcher.start()
    second = writers.publish(spark, spark.range(5), path)
    stop.set()
    watcher.join()
    assert seen and set(seen) <= {first, second} and writers.read_published(spark, path, "id long").count() == 5
    assert old.count() == 3  # who began before still reads its version
    third = writers.publish(spark, spark.range(7), path)
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.is_dir()) == [second, third]


def test_values_are_cut_before_they_meet(spark):
    """No array of a group's values is longer than the limit, and no window's partition is sent whole."""
    from weftline.operators import lexicon

    df = spark.range(0, 5000, 1, 4).selectExpr("id % 2 as g", "concat('v', id % 900) as v", "id as _ord")
    found = lexicon.distinct_by_key(df, ["g"], "v", 5)
    assert {r.g: r["values"] for r in found.collect()} == {g: [f"v{i}" for i in range(g, 10, 2)] for g in (0, 1)}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_and_letters_among_terms(spark):
    """A third of all entries have one key, many none, and every key holds one letter: the best are still those of all."""
    from weftline.operators import lexicon

    rng = random.Random(11)
    keys = ["same"] * 300 + [""] * 50 + ["".join(rng.choice("aes") for _ in range(rng.randrange(1, 8))) for _ in range(550)]
    rows = [(rng.choice("ab"), "y", k, rng.randrange(4) / 4, i) for i, k in enumerate(keys)]
    index = spark.createDataFrame(rows, "src_lang string, tgt_lang string, source_text string, confidence double, _ord int").withColumn("norm_key", F.col("source_text"))
    terms = ["e", "", "same", "the same thing", "aes", "eaes", "zz", "sa"]
    got = {(r.term_id, r["rank"]): (r._ord, r.match_type) for r in lexicon.lookup_terms(index, spark.createDataFrame([(t, t) for t in terms], "term_id string, key string"), 4).collect()}
    want = {}
    for t in terms:
        best = sorted((r for r in rows if t in r[2] or r[2] in t), key=lambda r: (r[2] != t, -r[3], r[0], r[1], r[2], r[4]))
        want |= {(t, k): (r[4], "exact" if r[2] == t else "contains") for k, r in enumerate(best[:4], 1)}
    assert got == want


def test_pivot_lexicons_both_ways(spark):
    """Between each language and Chinese by way of English, where both hops are there."""
    from weftline.operators import lexicon

    def table(rows, src, tgt):
        return spark.createDataFrame([(s, [t], t, i) for i, (s, t) in enumerate(rows)], "source_text string, target_candidates array<string>, target_text string, _ord int").withColumns({"src_lang": F.lit(src), "tgt_lang": F.lit(tgt)})

    hops = {
        ("spa_Latn", "eng_Latn"): table([("gato", "house cat"), ("sol", "sun")], "spa_Latn", "eng_Latn"), ("eng_Latn", "zho_Hans"): table([("house cat", "家猫"), ("moon", "月")], "eng_Latn", "zho_Hans"),
        ("zho_Hans", "eng_Latn"): table([("家猫", "house cat")], "zho_Hans", "eng_Latn"), ("eng_Latn", "spa_Latn"): table([("House Cat", "gato")], "eng_Latn", "spa_Latn"),
    }
    made = programs.pivot_lexicons(hops, ["spa_Latn", "tha_Thai"])
    assert set(made) == {("spa_Latn", "zho_Hans"), ("zho_Hans", "spa_Latn")}
    assert [(r.source_text, r.target_text) for r in made["spa_Latn", "zho_Hans"].collect()] == [("gato", "家猫")]
    assert [(r.source_text, r.target_text, r.pivot_text) for r in made["zho_Hans", "spa_Latn"].collect()] == [("家猫", "gato", "house cat")]
    assert lexicon.MOST_CANDIDATES == 8
