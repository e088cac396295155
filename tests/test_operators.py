"""Operators that SQL can't express, against plain Python; and edge cases."""

import hashlib
import json
import pathlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import names, text
from weftline.operators import incremental, lexicon, metrics, pairs, remote, sampling
from weftline.plans import driver, programs
from weftline.sources import readers, writers


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.floats(0.01, 5)), min_size=1, max_size=6), st.integers(1, 150))
def test_allocation_fills_what_there_is(pools, total):
    lengths, weights = [p[0] for p in pools], [p[1] for p in pools]
    got = sampling.allocate(lengths, weights, total)
    assert sum(got) == min(total, sum(lengths)) and all(0 <= g <= n for g, n in zip(got, lengths, strict=True))
    one = [min(n, int(total * w / sum(weights))) for n, w in zip(lengths, weights, strict=True)]
    while sum(one) < min(total, sum(lengths)):  # rounds of one more, as defined
        for i, n in enumerate(lengths):
            if sum(one) < total and one[i] < n:
                one[i] += 1
    assert got == one


def test_allocation_errors():
    for bad in (([1], [1, 2], 3), ([1], [1], 0), ([1], [0], 1)):
        with pytest.raises(ValueError):
            sampling.allocate(*bad)


def pack(t, most, seps=r"(?:\\n+|[.!?！？。；;])"):
    t = " ".join(t.split())
    if not t or len(t) <= most:
        return [t] if t else []
    out, buf = [], ""
    for part in re.split(seps, t):
        part = " ".join(part.split())[:most].strip()
        if part:
            if buf and len(buf) + 1 + len(part) <= most:
                buf += " " + part
            else:
                out += [buf] if buf else []
                buf = part
    return out + ([buf] if buf else [])


def test_packing(spark):
    texts = ["", "short one.", "a b. c d! " * 12, "x" * 90 + ". y", "one；two。three？four" * 5, "q\\nw. " * 20, "  spaced   out .  " * 9, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", text.pack_sentences(F.col("t"), 40).alias("p")).collect()}
    assert got == {i: pack(t or "", 40) for i, t in enumerate(texts)}


def test_greedy_equals_the_ordered_pass(spark):
    import random

    rng = random.Random(3)
    docs = [(i, rng.choice("ab"), [f"c{rng.randrange(12)}" for _ in range(rng.randrange(1, 5))]) for i in range(60)]
    seen, want = set(), []
    for i, lang, cands in docs:
        for pos, c in enumerate(cands):
            if (lang, c) not in seen:
                seen.add((lang, c))
                want.append((lang, i, pos))
                break
    flat = spark.createDataFrame([(i, lang, p, c) for i, lang, cands in docs for p, c in enumerate(cands)], "_ord long, lang string, pos int, text string").withColumn("hash", F.sha1("text"))
    assert sorted((r.lang, r._ord, r.pos) for r in sampling.greedy_sources(flat).collect()) == sorted(want)


def test_bleu_cases(spark):
    rows = [("same", "a b c d e", "a b c d e"), ("none", "x y z w", "a b c d"), ("short", "a b c d", "a b c d e f"), ("empty", "", "a b"), ("clip", "the the the the", "the cat sat on"), ("part", "a b c x", "a b c d")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, h string, r string")
    tok = df.select("id", "g", metrics.tokenized(F.col("h"), F.lit("none")).alias("hyp"), metrics.tokenized(F.col("r"), F.lit("none")).alias("ref"))
    got = {r.g: r.bleu for r in metrics.corpus_bleu(tok, ["g"], "id").collect()}
    import math

    assert got["same"] == pytest.approx(100) and got["none"] == 0 and got["empty"] == 0
    assert got["short"] == pytest.approx(100 * math.exp(1 - 6 / 4))
    assert got["clip"] == pytest.approx(math.exp((math.log(25) + math.log(100 / (2 * 3)) + math.log(100 / (4 * 2)) + math.log(100 / (8 * 1))) / 4))
    assert got["part"] == pytest.approx(math.exp((math.log(75) + math.log(100 * 2 / 3) + math.log(50) + math.log(100 / 2)) / 4))


def test_tokenizers(spark):
    one = spark.createDataFrame([("Hello, world! 3.5-4 &amp; \"x\"", "你好 world，3。", "a b", "a,b $5.")], "a string, z string, c string, i string")
    r = one.select(metrics.tokenize_13a(F.col("a")).alias("a"), metrics.tokenize_zh(F.col("z")).alias("z"), metrics.tokenize_char(F.col("c")).alias("c"), metrics.tokenize_intl(F.col("i")).alias("i")).first()
    assert r.a == 'Hello , world ! 3.5 - 4 & " x "'
    assert r.z.split() == ["你", "好", "world", "，", "3", "。"] and r.c == "a b" and r.i == "a , b $ 5."


LEX = [("eng_Latn", "zho_Hans", "dictionary", ["词典", "字典"], 0.9), ("eng_Latn", "zho_Hans", "year", ["年份", "年"], 0.8), ("eng_Latn", "zho_Hans", "language", ["语言"], 0.7), ("zho_Hans", "eng_Latn", "字典", ["dictionary"], 0.95), ("zho_Hans", "eng_Latn", "语言", ["language"], 0.88), ("zho_Hans", "eng_Latn", "後", ["after"], 0.5)]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([(s, t, a, c[0], c, f, i) for i, (s, t, a, c, f) in enumerate(LEX)], "src_lang string, tgt_lang string, source_text string, target_text string, target_candidates array<string>, confidence double, _ord int")
    return lexicon.loaded(rows).cache()


def test_lookup(index):
    assert [(r.src_lang, r.size) for r in lexicon.inventory(index).collect()] == [("eng_Latn", 3), ("zho_Hans", 3)]
    assert lexicon.lookup(index, "eng_Latn", "zho_Hans", "dictionary", 3).first().target_text == "词典"
    assert lexicon.lookup(index, "eng_Latn", "zho_Hans", "lang").first().source_text == "language"
    assert lexicon.lookup_with_fallback(index, "zho_Hans", "eng_Latn", "后")["results"][0]["target_text"] == "after"
    pages = [lexicon.lookup(index, "eng_Latn", "zho_Hans", "a", 1, k).first() for k in (0, 1)]
    assert pages[0].source_text != pages[1].source_text and pages[0].total_matches >= 2 and pages[0].has_more
    assert any(r.src_lang == "eng_Latn" for r in lexicon.search(index, "dictionary").collect())
    none = lexicon.lookup_with_fallback(index, "eng_Latn", "zho_Hans", "后", 5, 0, 3)
    assert none["total_matches"] == 0 and none["fallback_used"] and none["fallback_results"]
    with pytest.raises(ValueError):
        lexicon.lookup_with_fallback(index, "eng_Latn", "tha_Thai", "x")
    with pytest.raises(ValueError):
        lexicon.lookup(index, "eng_Latn", "zho_Hans", "x", 0)
    calls = lexicon.dispatcher(index)
    assert len(calls["list_dictionary_pairs"]()) == 2 and calls["lookup_dictionary"](src_lang="eng_Latn", tgt_lang="zho_Hans", term="year")["total_matches"] == 1
    assert lexicon.tool_schema("a->b")[0]["function"]["name"] == "lookup_dictionary"


def test_pivot(spark):
    low = spark.createDataFrame([("casa", ["House", "the"], 0), ("CASA", ["car"], 1), ("x", ["to"], 2), ("coche", ["car", "auto"], 3)], "source_text string, target_candidates array<string>, _ord int").withColumn("target_text", F.lit(""))
    en = spark.createDataFrame([("house", ["房子"], 0), ("car", ["车", "汽车"], 1), ("auto", ["汽车", "轿车"], 2), ("the", ["这"], 3)], "source_text string, target_candidates array<string>, _ord int").withColumn("target_text", F.lit(""))
    got = {r.source_text: (r.target_candidates, r.pivot_text) for r in lexicon.pivot_lexicon(low, en, "spa_Latn", "zho_Hans").collect()}
    assert got == {"casa": (["房子"], "House"), "coche": (["车", "汽车", "轿车"], "auto")}


def test_word_lists_and_record_cap(spark):
    rows = spark.createDataFrame([("Chat", f"c{i}", i) for i in range(12)] + [("chat", "C1", 20), ("馬", "m", 21), ("歲", "y", 22)], "src string, tgt string, _ord int")
    got = {r.source_text: r for r in lexicon.word_list_lexicon(rows, "fra_Latn", "eng_Latn", 20).collect()}
    assert got["Chat"].target_candidates == [f"c{i}" for i in range(8)]
    assert {r.source_text for r in lexicon.word_list_lexicon(rows.where("_ord > 20"), "zho_Hans", "eng_Latn").collect()} == {"马", "岁"}


def test_directions(spark):
    groups = pairs.group_table(spark, [["e", "z"], ["e", "z", "s"]])
    got = Counter((r.src_lang, r.tgt_lang) for r in pairs.expand_directions(groups).collect())
    assert got[("e", "z")] == 2 and got[("z", "e")] == 2 and got[("e", "s")] == 1 and ("e", "e") not in got
    assert ("e", "e") in {(r.src_lang, r.tgt_lang) for r in pairs.expand_directions(groups, same_language=True).collect()}
    assert pairs.directions_of(["a", "b"], ["b", "c"]) == [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")]
    assert pairs.asked_direction("b", "a", "a", "b") is True and pairs.asked_direction("a", "c", "a", "b") is None


def test_validation_and_routes(spark):
    with pytest.raises(ValueError):
        pairs.validated(spark.createDataFrame([(1,)], "x int"))
    bad = spark.createDataFrame([("s", "r", "a", "b", None)], "source_text string, reference_text string, src_lang string, tgt_lang string, hypothesis string")
    with pytest.raises(Exception, match="required value"):
        pairs.validated(bad).collect()
    experts = spark.createDataFrame([("a", "b", "m", 0)], "src_lang string, tgt_lang string, adapter_name string, _ord int")
    with pytest.raises(Exception, match="no route"):
        pairs.routed(spark.createDataFrame([("a", "c")], "src_lang string, tgt_lang string"), experts, strict=True).collect()


def test_config_merging():
    got = pairs.merge_source_configs({"a": {"limit": 1, "enabled": True}}, {"sources": {"a": {"limit": 5}, "b": {"limit": 2}}})
    assert got == {"a": {"limit": 5, "enabled": True}, "b": {"limit": 2}}
    with pytest.raises(ValueError):
        pairs.merge_source_configs({}, {"sources": [1]})
    with pytest.raises(ValueError):
        pairs.check_languages(["x"], ["y"])
    assert pairs.check_languages(["x", "y"], ["y"], strict=False) == ["y"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"input": "x", "output": "é"}\n\n{"input": " ", "output": "y"}\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "input string, output string")
    assert [r.input for r in rows.orderBy("_ord").collect()] == ["x", " "]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a string", missing_ok=True).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"input": "x"}\nnot json\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "input string").collect()
    assert readers.read_lines(spark, str(tmp_path / "bad.jsonl"), only_json=True).count() == 1
    assert readers.parse_alpaca(readers.read_lines(spark, str(tmp_path / "a.jsonl"))).count() == 1
    n = writers.write_jsonl(rows.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "out"), n=1)
    first = json.loads((next((tmp_path / "out").glob("part*"))).read_text(encoding="utf-8").splitlines()[0])
    assert n == 2 and first["none"] is None and len(list((tmp_path / "out.preview_1").glob("part*"))) == 1
    writers.write_document({"a": 1}, str(tmp_path / "reg.json"))
    assert writers.upsert_registry(str(tmp_path / "reg.json"), {"b": writers.registration("f.jsonl")})["a"] == 1
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        writers.upsert_registry(str(tmp_path / "list.json"), {})
    changed, count = writers.rewrite_column(rows, "input", F.lit("x"))
    assert count == 1 and changed.where("input = 'x'").count() == 2
    writers.replace_folder(spark, changed.drop("_ord"), str(tmp_path / "out"))
    assert writers.count_lines(spark, str(tmp_path / "out")) == 2
    assert writers.copy_table(spark, str(tmp_path / "out"), str(tmp_path / "copy"), "input string") == 2 and writers.copy_table(spark, str(tmp_path / "no"), str(tmp_path / "copy2"), "input string") == 0
    assert "cutoff: 512" in writers.render_config({"section": None, "cutoff": 512, "bf16": True})


def test_metrics_files(spark, tmp_path):
    table = spark.createDataFrame([("flores", "a->b", "10.5", "13a", "", "3"), ("flores", "a->b", "11", "13a", "0.5", "3"), ("flores", "b->a", "bad", "13a", "", "3")], "corpus string, pair string, bleu string, bleu_tokenizer string, comet string, num string")
    table.coalesce(1).write.option("header", True).csv(str(tmp_path / "metrics"))
    rows = readers.read_metrics(spark, str(tmp_path / "metrics"))
    got = metrics.score_matrix(rows, "flores", ["a", "b"]).collect()
    assert [(r.src, r.a, r.b) for r in got] == [("a", None, 11.0)]


def test_sources_and_pairs():
    assert readers.resolve_source("a", "b", [("b", "a")], [("a", "b")], {"a": "x", "b": "y"}, "u/", "v/") == ("v/x-y.bitextf.tsv.gz", "a", "b", "statmt")
    assert readers.resolve_source("a", "b", [("b", "a")], [], {}, "u/", "v/") == ("u/b-a.gz", "b", "a", "allenai")
    assert readers.resolve_source("a", "b", [], [], {}, "u/", "v/") is None
    assert readers.parse_pairs("# x\na,b\n\nc d\n") == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        readers.parse_pairs("a b c")
    assert readers.pair_limits({"pairs": [{"src_lang": "a", "tgt_lang": "b", "limit": 0}]}, 7) == [("a", "b", 7)]
    assert readers.configured_languages({"language_pair_groups": [["b", "a"], ["c", "a"]]}, True) == ["b", "a", "c"]


def test_retries_and_errors(spark):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429")
        return " ok "

    waits = []
    assert remote.with_retries(flaky, 3, waits.append) == "ok" and waits == [5.0, 10.0]
    items = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def translator(p):
        if p == "bad":
            raise ValueError("content filter")
        return p + "!"

    done, failed = writers.quarantine(remote.translate(items, translator, "prompt", retries=0))
    assert [r.hypothesis for r in done.collect()] == ["good!"] and failed.first().error == "content filter"
    batches = spark.createDataFrame([("x", "a", "b"), ("y", "a", "c"), ("z", "a", "b")], "source_text string, src_lang string, tgt_lang string")
    got = {r.source_text: r.hypothesis for r in remote.translate_batches(batches, lambda t, s, g: [f"{s}{g}:{x}" for x in t]).collect()}
    assert got == {"x": "ab:x", "y": "ac:y", "z": "ab:z"}
    assert remote.subprocess_translator(["cat"])("two\nlines") == "two lines"
    assert remote.request_options("qwen3") and remote.request_options("generic") is None


def test_agent():
    answers = iter([{"tool_calls": [{"name": "f", "arguments": {"x": 1}}, {"name": "g"}]}, {"content": " done "}])
    seen = []
    assert remote.run_agent(lambda h: (seen.append(list(h)), next(answers))[1], {"f": lambda x: x + 1}, remote.agent_messages("t", "eng_Latn", "spa_Latn")) == "done"
    assert [m["content"] for m in seen[1] if m.get("role") == "tool"] == [2, {"error": "unknown tool: g"}]


def test_resume_and_sampling(spark):
    out = spark.createDataFrame([("a", None), ("zz", hashlib.sha1(b"b").hexdigest())], "input string, h string").withColumn("meta", F.struct(F.col("h").alias("source_hash")))
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "text string").withColumn("hash", F.sha1("text"))
    assert [r.text for r in incremental.resume(sources, out).collect()] == ["c"]
    rows = spark.range(100).withColumn("_ord", F.col("id"))
    picked = [r.id for r in sampling.sample_keep_order(rows, 10, 1, "id").collect()]
    assert len(picked) == 10 and picked == sorted(picked) == [r.id for r in sampling.sample_keep_order(rows.repartition(7), 10, 1, "id").collect()]
    assert sampling.sample_lines(rows, 0, 1, "id").count() == 0 and sampling.sample_lines(rows, -1, 1, "id").count() == 100


def test_permutations(spark):
    rows = spark.createDataFrame([(i, [f"l{j}" for j in range(i)]) for i in range(6)], "i int, lines array<string>")
    for r in rows.select("i", "lines", sampling.permuted(F.col("lines"), 42, F.col("i")).alias("p")).collect():
        assert r.p is None if r.i < 2 else (sorted(r.p) == r.lines and r.p != r.lines)


def test_programs(spark):
    directions = pairs.expand_directions(pairs.group_table(spark, [["eng_Latn"], ["spa_Latn"]]))
    item = "dataset string, split string, src_lang string, tgt_lang string, sample_id string, source_text string, reference_text string"
    parallel = spark.createDataFrame([("flores", "dev", s, t, str(i), f"s{i}", f"r{i}") for s, t in (("eng_Latn", "spa_Latn"), ("spa_Latn", "eng_Latn")) for i in range(9)], item)
    items = programs.evaluation_set(directions, parallel, parallel.limit(5), 4, None, 1)
    assert Counter((r.eval_corpus, r.eval_pair) for r in items.collect()) == {("flores", "eng_Latn->spa_Latn"): 4, ("flores", "spa_Latn->eng_Latn"): 4, ("ntrex", "eng_Latn->spa_Latn"): 4}
    hyps = programs.generate_hypotheses(items, lambda p: p.split("\n\n")[1])
    found = programs.metrics_of(items, hyps).collect()
    assert {r.bleu_tokenizer for r in found} == {"13a_spbleu_fallback", "13a"} and sum(r.num for r in found) == 12
    rolled = metrics.metrics_document(metrics.rollup_metrics(programs.metrics_of(items, hyps)), "auto")
    assert set(rolled["by_corpus"]) == {"flores", "ntrex"}
    assert programs.run_directions({"a": lambda: 1, "b": lambda: 1 / 0}, spark=spark).outcomes["b"].status == "failed"
    assert programs.expert_assets([("a", "b")], "p", 5)[0]["adapter_name"] == "p_a_to_b"
    assert names.ordered_distinct("abca") == ["a", "b", "c"]


def test_numbers_within_a_key(spark):
    rows = spark.range(1000).selectExpr("id as _ord", "case when id % 10 = 0 then null when id % 3 = 0 then 'hot' else 'k' || id % 7 end as key").repartition(9)
    got = {}
    for r in sampling.numbered(rows, ["key"]).collect():
        got.setdefault(r.key, []).append((r._ord, r._n))
    for found in got.values():
        assert [n for _, n in sorted(found)] == list(range(len(found)))
    assert None in got and sum(map(len, got.values())) == 1000


def test_least_draws_are_the_sorted_ones(spark):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else 'k' || id % 5 end as key").withColumn("_draw", sampling.draw(1, F.col("key"), F.col("id")))
    every = {}
    for r in rows.collect():
        every.setdefault(r.key, []).append((r._draw, r.id))
    limits = {"hot": 700, "k0": 0, "k1": 1, "k2": 10**6, "k3": None, "k4": 50}
    table = spark.createDataFrame(list(limits.items()), "key string, _limit long")
    got = {}
    for r in sampling.least_draws(rows, table, ["key"], "id").collect():
        got.setdefault(r.key, set()).add(r.id)
    for key, n in limits.items():
        want = sorted(every[key])[: len(every[key]) if n is None else n]
        assert got.get(key, set()) == {i for _, i in want}, key


def test_keep_first_keeps_wide_rows(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (5, None, "w"), (4, "b", "v")], "_ord int, k string, `odd.name` string")
    assert sorted(map(tuple, pairs.keep_first(rows, F.col("k")).collect())) == [(1, "a", "y"), (2, None, "z"), (4, "b", "v")]


def test_traditional_terms(spark):
    chars = text.traditional_characters(spark)
    assert set("於著徵學國貓") <= set(chars) and not set("囧妳祂玥珺后後里猫国中文") & set(chars)
    lines = spark.createDataFrame([(0, "a 於 [x] /at/"), (1, "b 囧 [x] /glum/Glum/ glum /"), (2, "c 中 [x] /mid/")], "_ord int, value string")
    assert [(r.simplified, r.defs) for r in readers.parse_cedict(lines).orderBy("_ord").collect()] == [("囧", ["glum"]), ("中", ["mid"])]
    assert [r.simplified for r in readers.parse_cedict(lines, traditional="中").orderBy("_ord").collect()] == ["於", "囧"]


def test_readers_that_fail_late(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "good"))

    def broken(s):
        return s.createDataFrame([("x",)], "a string").select(F.raise_error(F.col("a")).cast("int").alias("a"))

    got = readers.read_first_of(spark, [lambda s: s.read.parquet(str(tmp_path / "none")), broken, lambda s: s.read.parquet(str(tmp_path / "good"))])
    assert got.collect() == [(1,)]
    with pytest.raises(Exception):
        readers.read_first_of(spark, [broken])
    empty = spark.createDataFrame([], "id string, text string, _ord int")
    with pytest.raises(Exception, match="no usable rows"):
        readers.language_table(empty).collect()
    writers.write_document({"a": [1]}, str(tmp_path / "c.json"))
    assert readers.read_config(str(tmp_path / "c.json")) == readers.read_config(str(tmp_path / "c.json"), spark) == {"a": [1]}


def test_files_and_names(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\nb\nc\n")
    assert writers.preview_of(spark, str(tmp_path / "t.txt"), 2) == ["a", "b"] and writers.preview_of(spark, str(tmp_path / "t.txt"), 2, skip_blank=False) == ["a", ""]
    rows = spark.createDataFrame([("x",)], "a string")
    for value in ("1", "2"):
        writers.replace_folder(spark, rows.select(F.lit(value).alias("a")), str(tmp_path / "swap"))
    assert [r.a for r in spark.read.json(str(tmp_path / "swap")).collect()] == ["2"] and not (tmp_path / "swap.old").exists() and not (tmp_path / "swap.part").exists()
    writers.bundle({"x/t.txt": str(tmp_path / "t.txt")}, str(tmp_path / "b.tgz"))
    import tarfile

    assert tarfile.open(tmp_path / "b.tgz").getnames() == ["x/t.txt"]
    assert names.yaml_quoted("it's") == "'it''s'" and names.relative_path("/a/b/c", "/a") == "b/c" and names.relative_path("/a/b", "/x") == "/a/b" and names.relative_path("/a/b", "/a", absolute=True) == "/a/b"
    assert names.dataset_name("a b-c.d") == "a_b_c_d" and names.preview_name("x") == "previews/x.preview_50.jsonl" and names.direction_file("k", "a", "b") == "k_a__b.jsonl"
    assert names.word_list_url("eng_Latn", "spa_Latn", "u/") == "u/en-es.txt"


def test_samples_with_dates(spark):
    import datetime as dt

    rows = spark.createDataFrame([("1", "t", (dt.date(2024, 2, 3), dt.datetime(2024, 2, 3, 4, 5, 6, 70), None)), ("2", None, None)], "id string, text string, metadata struct<d: date, ts: timestamp, n: int>")
    got = {r.sample_id: r for r in readers.sample_rows(rows, "c", "s", "train").collect()}
    assert got["1"].metadata == {"d": "2024-02-03", "ts": "2024-02-03T04:05:06.000070", "n": None} and got["2"].metadata == {} and got["2"].text is None
    assert readers.sample_rows(rows.drop("metadata"), "c", "s", "train").first().metadata == {}


def test_directions_run_side_by_side(spark):
    import threading

    meet = threading.Barrier(2, timeout=20)
    got = programs.run_directions({"a": meet.wait, "b": meet.wait, "c": lambda: 1 / 0}, workers=3, spark=spark)
    assert [got.outcomes[x].status for x in "abc"] == ["ok", "ok", "failed"] and got.outcomes["c"].error == "division by zero"
    assert got.exit_status == 2 and got.lines()[-3:] == ["PASS: 2", "FAIL: 1", "CANCELLED: 0"]


def test_terms_of_any_length_meet_their_entries(spark):
    rows = ["", "a", "ab", "abc", "abcd", "xabcx", "zzz", "b"]
    index = spark.createDataFrame([(k, i) for i, k in enumerate(rows)], "norm_key string, _ord int").selectExpr("'s' as src_lang", "'t' as tgt_lang", "norm_key as source_text", "1.0 as confidence", "norm_key", "_ord")
    terms = ["", "a", "abc", "q", "abcde", "zz"]
    got = Counter((r.term_id, r._ord) for r in lexicon.lookup_terms(index, spark.createDataFrame([(t, t) for t in terms], "term_id string, key string"), 50).collect())
    assert got == Counter((t, i) for t in terms for i, k in enumerate(rows) if t in k or k in t)


def test_tokenizers_with_models(spark):
    model = pathlib.Path("/opt/tokenizers/piece_bpe_32k.model")
    if not model.exists():
        pytest.skip("no model here")
    apply = metrics.sentence_pieces(str(model))
    try:
        metrics.register_tokenizer("flores200", apply, "flores200_local_spm")
        rows = spark.createDataFrame([("flores", "d", "eng_Latn", "zho_Hans", "", "a small house by the sea", "a small house by the sea", 0)], "eval_corpus string, dataset string, src_lang string, tgt_lang string, eval_pair string, hypothesis string, reference_text string, _ord int")
        got = metrics.evaluate(rows).first()
        assert got.bleu_tokenizer == "flores200_local_spm" and got.bleu == pytest.approx(100)
        assert "".join(rows.select(apply(F.col("hypothesis")).alias("t")).first().t.split()).replace("\u2581", " ").strip() == "a small house by the sea"
    finally:
        metrics.TOKENIZERS.pop("flores200", None)
        metrics.REPORTED.pop("flores200", None)


def test_driver_helpers(spark, tmp_path):
    import io

    (tmp_path / "raw").write_text("data")
    url = (tmp_path / "raw").as_uri()
    assert pathlib.Path(driver.fetch_once(url, str(tmp_path / "d" / "copy"))).read_text() == "data"
    (tmp_path / "raw").write_text("newer")
    assert pathlib.Path(driver.fetch_once(url, str(tmp_path / "d" / "copy"))).read_text() == "data"
    assert pathlib.Path(driver.fetch_once(url, str(tmp_path / "d" / "copy"), force=True)).read_text() == "newer"
    assert driver.text_argument(" a ") == "a" and driver.text_argument(file=str(tmp_path / "raw")) == "newer" and driver.text_argument(stdin=io.StringIO("x\n")) == "x"
    with pytest.raises(ValueError):
        driver.text_argument(" ")
    got = driver.probe({"good": lambda: spark.range(3), "none": lambda: spark.range(0), "bad": lambda: spark.read.parquet(str(tmp_path / "no"))})
    assert got["good"] == (True, "id") and got["none"] == (False, "no rows") and not got["bad"][0]
    assert driver.run_steps([("a", lambda: 1), ("b", lambda: 1 / 0)], skip=["b"]) == {"a": 1}
    with pytest.raises(RuntimeError, match="step b"):
        driver.run_steps([("b", lambda: 1 / 0)])
    lines, said, asked = iter(["one", "", "two", "/reset", "three", "/exit", "never"]), [], []
    history = driver.chat(lambda h: (asked.append([m["content"] for m in h]), h[-1]["content"].upper())[1], lambda: next(lines), said.append, system="s")
    assert said == ["ONE", "TWO", "THREE"] and asked == [["s", "one"], ["s", "one", "ONE", "two"], ["s", "three"]] and len(history) == 3
    lines = iter(["one", None])
    assert driver.chat(lambda h: h[-1]["content"], lambda: next(lines), said.append, prompt=lambda t: f"<{t}>")[0]["content"] == "<one>"


def test_drawings_and_nested_configurations():
    svg = writers.heat_map([{"src": "a", "a": None, "b": 40.0}, {"src": "b", "a": -2.5, "b": 3.0}], ["a", "b"], -5, 40, "x < y")
    assert svg.count("<rect") == 4 and "x &lt; y" in svg and "40.0" in svg and "rgb(255," in svg
    import xml.dom.minidom

    xml.dom.minidom.parseString(svg)
    assert writers.render_config({"a": {"b": [1, "x"], "c": {"d": True}}}) == 'a:\n  b: [1, "x"]\n  c:\n    d: true\n'


def test_only_one_small_file_is_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "three"))
    one, three = (storage.spread(spark.read.parquet(str(tmp_path / n))) for n in ("one", "three"))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == three.count() == 1000
    assert "REPARTITION_BY_NUM" in one._jdf.queryExecution().toString() and "REPARTITION" not in three._jdf.queryExecution().toString()
