"""More registered queries: text functions, names, files, metrics and whole programs, each over a whole test table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, text
from .operators import incremental, lexicon, lookup_index, metrics, pairs, remote, sampling, shards
from .plans import programs
from .registering import TURNS, documents, query, table, turns
from .sources import paged, readers, writers
from .storage import scratch_path, spread
from .streaming import incremental as streams


def case(key: Column, *values: Column) -> Column:
    """The value at key, counted round."""
    out = F.when(F.pmod(key, F.lit(len(values))) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.pmod(key, F.lit(len(values))) == i, v)
    return out


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


C = F.col
TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN {TRIMMED} WHEN 1 THEN source || ' ' || lang WHEN 2 THEN source || '<think>open ' || lang ELSE {TRIMMED} END) AS out FROM documents")
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = case(C("doc_id"), joined("<think>", C("lang"), "\n", C("source"), "</think> ", C("text")), joined("<THINK>q</think>", C("source"), " <think></think> ", C("lang")), joined(C("source"), "<think>open ", C("lang")), C("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(text.strip_think(made)).alias("out"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 3, 5) THEN p_name END AS out FROM part")
def clean_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = C("p_name"), C("p_type")
    made = case(C("p_partkey"), joined(n, " (", t, ")"), joined("CL:", n), joined("Variant of ", n), joined(" ", n, "; "), joined("surname ", n), joined(n, ", Tw pr. ", t), joined("abbr. for ", n), F.repeat(joined(n, " "), 20))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_definition(made).alias("out"))


@query("SELECT CAST(p_partkey AS BIGINT) AS i, CASE p_partkey % 6 WHEN 0 THEN 'statmt' ELSE 'allenai' END AS kind, p_name AS text0, p_type AS text1 FROM part WHERE p_partkey % 6 IN (0, 4)")
def parse_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, n, t = C("p_retailprice").cast("string"), C("p_name"), C("p_type")
    made = case(C("p_partkey"), joined(price, "\t ", n, "\t", t), joined("no\t", n, "\t", t), joined(price, "\t", n), joined(price, "\t \t", t), joined(n, "\t", t, "\t0" * 7), joined(n, "\t", t))
    lines = table(spark, sf_dir, "part").select(C("p_partkey").cast("long").alias("_ord"), made.alias("value"))
    both = [readers.parse_scored_tsv(lines, k).withColumn("kind", F.lit(k)) for k in ("statmt", "allenai")]
    return both[0].unionByName(both[1]).select(C("_ord").alias("i"), "kind", "text0", "text1")


DICTIONARY_TERMS = ("猫", "於", "囧", "學", "学习", "珺", "俱乐部", "姊妹", "凶猛")


@query("SELECT p_partkey, ['猫', '於', '囧', '學', '学习', '珺', '俱乐部', '姊妹', '凶猛'][p_partkey % 9 + 1] AS simplified, p_name || ';' || p_type AS defs FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 9 NOT IN (1, 3, 8)")
def parse_cedict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lines of the parts: comments and Traditional terms go, and so do classifiers and definitions that came before in another case."""
    term = case(C("p_partkey"), *[F.lit(t) for t in DICTIONARY_TERMS])
    line = joined("x ", term, " [a1] /", C("p_name"), "/", F.upper("p_name"), "/CL:", C("p_type"), "/", C("p_type"), " (", C("p_brand"), ")/", C("p_name"), "/")
    lines = spread(table(spark, sf_dir, "part")).select(C("p_partkey").alias("_ord"), F.when(C("p_partkey") % 7 == 0, joined("# ", line)).otherwise(line).alias("value"))
    return readers.parse_cedict(lines).select(C("_ord").alias("p_partkey"), "simplified", F.array_join("defs", ";").alias("defs"))


@query("SELECT min_by(p_brand, p_partkey) AS source_text, min_by(p_name || ';' || p_type, p_partkey) AS candidates FROM part GROUP BY lower(p_brand)")
def dictionary_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(C("p_brand").alias("simplified"), F.array("p_name", F.upper("p_name"), "p_type").alias("defs"), C("p_partkey").alias("_ord"))
    return lexicon.dictionary_forward(rows).select("source_text", F.array_join("target_candidates", ";").alias("candidates"))


@query("""
WITH p AS (SELECT split_part(p_name, ' ', 1) AS def, p_brand, p_partkey FROM part), f AS (SELECT lower(def) AS key, min_by(p_brand, p_partkey) AS v, min(p_partkey) AS o FROM p GROUP BY lower(def), lower(p_brand)),
r AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY o) AS n FROM f), s AS (SELECT lower(def) AS key, min_by(def, p_partkey) AS source_text FROM p GROUP BY 1)
SELECT source_text, string_agg(v, ';' ORDER BY n) AS candidates FROM r JOIN s USING (key) WHERE n <= 8 GROUP BY source_text
""")
def dictionary_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(C("p_brand").alias("simplified"), F.array(F.split("p_name", " ")[0]).alias("defs"), C("p_partkey").alias("_ord"))
    return lexicon.dictionary_backward(rows).select("source_text", F.array_join("target_candidates", ";").alias("candidates"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' || source || ' ' || lang) AS out FROM documents")
def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, set in white space and with more of it at each line end, normalised; source and language stand behind them as they are."""
    made = joined("\u3000 ", F.replace("text", F.lit("\n"), F.lit("\u001c\r\n\u00a0")), "\t\u00a0 \u2028")
    return documents(spark, sf_dir).select("doc_id", F.md5(joined(text.normalize_space(made), " ", C("source"), " ", C("lang"))).alias("out"))


@query(r"""
WITH v AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' กข ' WHEN 1 THEN '學中文' ELSE '' END AS v FROM documents), s AS (SELECT *, length(regexp_replace(v, '\s+', '', 'g')) AS solid FROM v)
SELECT doc_id, round(length(regexp_replace(v, '[^A-Za-z]', '', 'g')) / solid, 9) AS latin, round(CASE doc_id % 3 WHEN 0 THEN 2 ELSE 0 END / solid, 9) AS thai, round(CASE doc_id % 3 WHEN 1 THEN 3 ELSE 0 END / solid, 9) AS cjk, doc_id % 3 = 1 AS traditional FROM s
""")
def script_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("text", case(C("doc_id"), F.lit(" กข "), F.lit("學中文"), F.lit("")))
    rows = documents(spark, sf_dir).select("doc_id", F.inline(F.array(F.struct(made.alias("v")))))  # bound, or each ratio would make it anew
    return rows.select("doc_id", *[F.round(text.script_ratio(C("v"), s), 9).alias(s) for s in ("latin", "thai", "cjk")], text.has_any(C("v"), text.TRADITIONAL_MARKS).alias("traditional"))


@query("SELECT p_partkey, lower(p_name) || ' ss 後' AS key, lower(p_name) || ' ss 后' AS lookup FROM part")
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width capitals, a sharp s and a Traditional character beside each part's name."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    rows = table(spark, sf_dir, "part").select("p_partkey", joined(" ", wide, "  ß　後").alias("v"))
    return rows.select("p_partkey", text.normalize_key(C("v")).alias("key"), text.normalize_lookup_key(C("v")).alias("lookup"))


@query("SELECT conv_id, turn, md5(CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN role || text WHEN 3 THEN 'x' || text ELSE role || text END) AS out FROM conversations")
def flatten_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r = C("text"), C("role")
    mixed = joined("[", F.to_json(F.struct(r.alias("text"))), ",", F.to_json(F.struct(t.alias("content"))), "]")
    made = case(C("conv_id") + C("turn"), F.lit("null"), F.to_json(F.struct(t.alias("content"))), F.to_json(F.array(r, t)), joined("x", t), mixed)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.flatten_message(made)).alias("out"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id % 9 * 100 WHEN 2 THEN event_id END AS INTEGER) AS step, event_type || '->' || user_id AS pair FROM events")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = C("event_id").cast("string")
    path = case(C("event_id"), joined("runs/checkpoint-7/x/checkpoint_", i, "/m.csv"), joined("runs/checkpoint", (C("event_id") % 9 * 100).cast("string"), "/x/m.csv"), joined("runs/a/checkpoint", i, "/m.csv"), F.lit("runs/m.csv"))
    adapter = joined("expert_", C("event_type"), "_to_", C("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", names.step_of(path).alias("step"), names.adapter_pair(adapter, "expert_").alias("pair"))


CODES = {"en": "eng_Latn", "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn"}


@query("""
WITH c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' ELSE 'spa_Latn' END AS src, ['zho_Hans', 'tha_Thai', 'xx'][doc_id % 3 + 1] AS tgt, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END AS a,
  ['Simplified Chinese', 'Thai', 'xx'][doc_id % 3 + 1] AS b, CASE lang WHEN 'en' THEN '英语' WHEN 'fr' THEN '法语' WHEN 'de' THEN '德语' ELSE '西班牙语' END AS za, ['简体中文', '泰语', 'xx'][doc_id % 3 + 1] AS zb FROM documents)
SELECT doc_id, src, tgt, '请将以下 ' || za || ' 文本翻译为 ' || zb || '，只输出译文。' AS chinese, 'Translate the following ' || a || ' text into ' || b || '. Output only the translation.' || CASE doc_id % 3 WHEN 0 THEN ' Do not use Traditional Chinese.' ELSE '' END AS strict,
  'Translate the following ' || a || ' text into ' || b || '. Output only the translation, no explanations.' AS bare FROM c
""")
def direction_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions read from file names, and their instructions."""
    code = names.mapped(C("lang"), CODES, F.lit("spa_Latn"))
    name = joined("d/nllb_mt_", code, "__", case(C("doc_id"), F.lit("zho_Hans"), F.lit("tha_Thai"), F.lit("xx")), ".jsonl")
    rows = documents(spark, sf_dir).select("doc_id", names.file_pair(name).alias("p")).select("doc_id", C("p.src_lang").alias("src"), C("p.tgt_lang").alias("tgt"))
    return rows.select("*", names.chinese_instruction(C("src"), C("tgt")).alias("chinese"), names.strict_instruction(C("src"), C("tgt")).alias("strict"), names.bare_instruction(C("src"), C("tgt")).alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '+' ELSE '' END || printf('%.2f', (p_size - 25) / 4.0) AS out FROM part")
def signed_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.signed((C("p_size") - 25) / F.lit(4.0)).alias("out"))


MESSAGES = ("Error code: 429", "blocked: Content Filter", "timeout", None, '{"code":"1302"}', "请求频率过高", "UNSAFE text", "contentFilter", "不安全")


@query("""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'rate_limit' WHEN event_id % 9 IN (1, 6, 8) THEN 'content_filter' WHEN event_id % 9 <> 3 THEN 'other' END AS first_kind,
  CASE WHEN event_id % 9 IN (0, 4, 5) THEN 'rate_limit' WHEN event_id % 9 = 7 THEN 'content_filter' WHEN event_id % 9 <> 3 THEN 'other' END AS second_kind FROM events
""")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers' rules on the same messages."""
    rows = table(spark, sf_dir, "events").select("event_id", case(C("event_id"), *[F.lit(m).cast("string") for m in MESSAGES]).alias("v"))
    return rows.select("event_id", pairs.provider_error_kind(C("v"), "deepseek").alias("first_kind"), pairs.provider_error_kind(C("v"), "zhipu").alias("second_kind"))


@query("""
WITH b AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
SELECT CAST(c_custkey AS VARCHAR) AS pair, CAST(o_orderkey AS VARCHAR) AS best_step, CASE WHEN o_orderkey IS NULL THEN 'missing_eval' WHEN o_orderkey % 2 = 1 THEN 'checkpoint_missing' ELSE 'ok' END AS status FROM customer LEFT JOIN b ON c_custkey = o_custkey
""")
def selected_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest order as a best checkpoint; checkpoints of odd orders aren't there."""
    experts = table(spark, sf_dir, "customer").select(C("c_custkey").cast("string").alias("pair"), C("c_name").alias("adapter_name"))
    orders = table(spark, sf_dir, "orders")
    path = joined("ck/", C("o_orderkey").cast("string"))
    candidates = orders.select(C("o_custkey").cast("string").alias("pair"), C("o_orderkey").cast("int").alias("step"), C("o_totalprice").alias("comet"), path.alias("path"), C("o_orderkey").alias("_ord"))
    there = orders.where("o_orderkey % 2 = 0").select(path.alias("path"))
    return metrics.selected_experts(experts, metrics.best_checkpoint(candidates), there).select("pair", "best_step", "status")


@query("SELECT CAST(o_custkey AS VARCHAR) AS pair, CAST(max(o_orderkey) AS INTEGER) AS last_step, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey <= 400 AND o_orderkey % 3 = 0) GROUP BY o_custkey")
def wanted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(C("o_custkey").cast("string").alias("pair"), C("o_orderkey").cast("int").alias("step"))
    return metrics.wanted_steps(rows, list(range(0, 401, 3))).groupBy("pair").agg(F.max("step").alias("last_step"), F.count("*").alias("n"))


@query("SELECT lang AS src_lang, source AS tgt_lang, count(*) AS num, count(*) FILTER (doc_id % 5 = 0) AS failed FROM documents GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (doc_id % 5 = 0) FROM documents")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_totals(documents(spark, sf_dir).select(C("lang").alias("src_lang"), C("source").alias("tgt_lang"), F.when(C("doc_id") % 5 == 0, "failed").alias("error")))


@query("""
SELECT doc_id, ['flores', 'ntrex', ''][doc_id % 3 + 1] AS corpus, 'eng_Latn->' || ['zho_Hans', 'tha_Thai', 'spa_Latn', 'cmn_Hans'][doc_id % 4 + 1] AS pair, ['auto', 'flores200', 'legacy', '', 'AUTO'][doc_id % 5 + 1] AS policy,
  CASE WHEN doc_id % 5 = 1 THEN 'flores200' WHEN doc_id % 5 <> 2 AND doc_id % 4 = 1 THEN 'pythai_newmm' WHEN doc_id % 5 <> 2 AND doc_id % 3 = 0 THEN 'flores200' WHEN doc_id % 4 IN (0, 3) THEN 'zh' ELSE '13a' END AS tokenizer FROM documents
""")
def bleu_tokenizer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = C("doc_id")
    grid = documents(spark, sf_dir).select("doc_id", case(i, F.lit("flores"), F.lit("ntrex"), F.lit("")).alias("corpus"), joined("eng_Latn->", case(i, *[F.lit(t) for t in ("zho_Hans", "tha_Thai", "spa_Latn", "cmn_Hans")])).alias("pair"), case(i, *[F.lit(p) for p in ("auto", "flores200", "legacy", "", "AUTO")]).alias("policy"))
    return grid.withColumn("tokenizer", names.tokenizer_for(C("corpus"), C("pair"), C("policy")))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def nested_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested column of Parquet shards: the events written with a struct, found by name, and read for one of its fields alone."""
    path = scratch_path(spark, "shards")
    table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("metadata")).repartition(4).write.parquet(path)
    shards = [r.path for r in readers.find_files(spark, path, "*.parquet").collect()]
    return readers.read_shards(spark, shards, ["metadata.k"]).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract(microsecond FROM ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS seen, CAST(user_id AS VARCHAR) AS sample_id, event_type AS text FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type FROM events)")
def corpus_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as corpus samples: times of the metadata in ISO form."""
    rows = table(spark, sf_dir, "events").select(C("user_id").alias("id"), C("event_type").alias("text"), F.struct("event_id", "ts").alias("metadata"))
    made = readers.sample_rows(rows, "corpus", "sub", "train")
    return made.select(C("metadata")["event_id"].cast("long").alias("event_id"), C("metadata")["ts"].alias("seen"), "sample_id", "text")


@query(r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, w[2] AS src, w[1] AS tgt FROM w WHERE len(w) >= 2")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select(C("text").alias("value"), "_ord")
    return readers.parse_word_pairs(lines, reverse=True).select(C("_ord").alias("doc_id"), "src", "tgt")


@query("SELECT 'validation' AS split, doc_id FROM documents WHERE lang = 'fr'")
def first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split that has rows, read by the first reader that works."""
    docs = readers.read_first_of(spark, [lambda s: s.read.parquet(f"{sf_dir}/no_such_table.parquet"), lambda s: documents(s, sf_dir)])
    name, rows = readers.first_split({"dev": docs, "validation": docs.where("lang = 'fr'"), "test": docs.where("lang = 'no such'")})
    return rows.select(F.lit(name).alias("split"), "doc_id")


@query("SELECT source AS corpus, 'x->' || lang AS pair, round(avg(quality), 6) AS bleu, count(*) AS num FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def metrics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as files and read again: of all corpora, found below the folder."""
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    made = docs.groupBy(C("source").alias("corpus"), joined("x->", C("lang")).alias("pair")).agg(F.round(F.avg("quality"), 6).alias("bleu"), F.count("*").alias("num"))
    shown = made.select("corpus", "pair", C("bleu").cast("string").alias("bleu"), F.lit("13a").alias("bleu_tokenizer"), F.lit("").alias("comet"), C("num").cast("string").alias("num"))
    path = scratch_path(spark, "metrics")
    writers.write_metrics(shown, path)
    found = [r.path for r in readers.find_files(spark, f"{path}/all", "*.csv").collect()]
    return readers.read_metrics(spark, found).select("corpus", "pair", C("bleu").cast("double").alias("bleu"), C("num").cast("long").alias("num"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, trim(left(t, 120)) AS text FROM c WHERE length(t) >= 60 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 0.8 * length(replace(t, ' ', ''))
""")
def resolve_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text column that is long and Latin enough, cut; no fallback to the longest."""
    rows = documents(spark, sf_dir).select("text", C("lang").alias("title"), C("doc_id").alias("_ord"))
    return pairs.resolve_text(rows, ["title", "text"], 60, longest=False, normalize=True, max_chars=120, min_latin=0.8).select(C("_ord").alias("doc_id"), "text")


@query(f"WITH {TURNS} SELECT conv_id, turn, md5(trim(regexp_replace(input, '\\s+', ' ', 'g'))) AS hypothesis_segmented, md5(trim(regexp_replace(regexp_replace(output, '\\s+', '', 'g'), '(.)', '\\1 ', 'gs'))) AS reference_segmented FROM t")
def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", "turn", C("input").alias("hypothesis"), C("output").alias("reference_text"))
    plain, apart = metrics.segmented(rows, F.lit("none")), metrics.segmented(rows, F.lit("char"))
    both = plain.drop("reference_segmented").join(apart.select("conv_id", "turn", "reference_segmented"), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.md5("hypothesis_segmented").alias("hypothesis_segmented"), F.md5("reference_segmented").alias("reference_segmented"))


@query("WITH b AS (SELECT source AS corpus, lang AS pair, round(avg(n_chars), 6) AS bleu FROM documents WHERE source = 'src1' GROUP BY ALL), s AS (SELECT source AS corpus, lang AS pair, round(avg(quality), 6) AS c FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en' GROUP BY ALL) SELECT corpus, pair, bleu, round(c, 6) AS comet FROM b LEFT JOIN s USING (corpus, pair)")
def with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU rows of one corpus, named in another case, with their segment scores where there are any."""
    docs = documents(spark, sf_dir).withColumn("eval_corpus", joined(" ", F.upper("source")))
    bleu = pairs.of_corpus(docs, "Src1 ").groupBy(C("source").alias("corpus"), C("lang").alias("pair")).agg(F.round(F.avg("n_chars"), 6).alias("bleu"))
    scores = docs.where("lang <> 'en'").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(C("source").alias("corpus"), C("lang").alias("pair")).agg(F.round(F.avg("quality"), 6).alias("comet"))
    return metrics.with_scores(bleu, scores).withColumn("comet", F.round(F.nullif("comet", F.lit("")).cast("double"), 6))


@query("SELECT lang AS src_lang, 'x' AS tgt_lang, source, doc_id FROM documents WHERE source IN ('src1', 'src2') QUALIFY source = 'src2' OR row_number() OVER (PARTITION BY lang, source ORDER BY sha1(concat_ws('|', '5', lang, 'x', source, CAST(doc_id AS VARCHAR))), doc_id) <= 2")
def all_directions_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(C("lang").alias("src_lang"), F.lit("x").alias("tgt_lang"), "source", "doc_id")
    every = rows.select("src_lang", "tgt_lang", "source").distinct()
    configs = every.withColumns({"enabled": C("source").isin("src1", "src2", "src3"), "limit": F.when(C("source") == "src1", 2).when(C("source") == "src3", 0).cast("long")})
    return programs.all_directions_mixture(rows, configs, 5, "doc_id")


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]', ' ', 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ')) AS line FROM documents")
def stdin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(text.join_lines(C("text"))).alias("line"))


@query(f"WITH {TURNS}, n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) - 1) // 4 AS chunk FROM t) SELECT CAST(conv_id % 3 AS BIGINT) AS part, CAST(chunk AS BIGINT) AS chunk, md5(string_agg('<' || input || '>', chr(10) ORDER BY conv_id, turn)) AS draft FROM n GROUP BY conv_id % 3, chunk")
def translated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of whole chunks by a translator that puts each line in brackets."""
    chunks = sampling.chunked(turns(spark, sf_dir).withColumn("part", C("conv_id") % 3), 4, ["part"])
    made = remote.translate_chunks(chunks, lambda t: f"<{t}>")
    return made.select("part", "chunk", F.md5(F.array_join("draft", "\n")).alias("draft"))


@query("SELECT doc_id FROM documents WHERE sha1(trim(text)) NOT IN (SELECT sha1(trim(text)) FROM documents WHERE doc_id % 3 = 0)")
def resume_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose text no output row was made from: by the hash that a row names, else by its input's."""
    docs = documents(spark, sf_dir).withColumn("hash", F.sha1(text.strip(C("text"))))
    done = docs.where("doc_id % 3 = 0").select(C("text").alias("input"), F.struct(F.when(C("doc_id") % 2 == 0, C("hash")).alias("source_hash")).alias("meta"))
    return incremental.resume(docs, done).select("doc_id")


@query("""
WITH t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS key FROM part UNION SELECT DISTINCT lower(p_name) || ' indeed' FROM part WHERE p_size = 7 UNION SELECT 'e' UNION SELECT 'zz'),
m AS (SELECT key, p_partkey, p_retailprice, p_brand, p_name FROM t JOIN part ON contains(lower(p_name), key) OR contains(key, lower(p_name)))
SELECT key AS term, p_partkey AS entry, CAST(row_number() OVER (PARTITION BY key ORDER BY lower(p_name) <> key, p_retailprice DESC, p_brand, p_name, p_partkey) AS INTEGER) AS rank, CASE WHEN lower(p_name) = key THEN 'exact' ELSE 'contains' END AS match_type FROM m QUALIFY rank <= 3
""")
def lookup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entries for a table of terms: words of the parts' names, names within longer texts, and a letter."""
    part = table(spark, sf_dir, "part")
    keys = part.select(F.lower(F.split("p_name", " ")[0]).alias("key")).union(part.where("p_size = 7").select(joined(F.lower("p_name"), " indeed"))).union(spark.createDataFrame([("e",), ("zz",)], "key string")).distinct()
    index = part.select(C("p_brand").alias("src_lang"), F.lit("y").alias("tgt_lang"), C("p_name").alias("source_text"), C("p_retailprice").alias("confidence"), F.lower("p_name").alias("norm_key"), C("p_partkey").alias("_ord"))
    found = lexicon.lookup_terms(index, keys.select(C("key").alias("term_id"), "key"), 3)
    return found.select(C("term_id").alias("term"), C("_ord").alias("entry"), "rank", "match_type")


@query("""
WITH t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS key FROM part UNION SELECT DISTINCT lower(p_name) || ' indeed' FROM part WHERE p_size = 7 UNION SELECT 'e' UNION SELECT 'zz' UNION SELECT ''),
m AS (SELECT key, p_partkey, p_retailprice, p_brand, p_name FROM t JOIN part ON contains(lower(p_name), key) OR contains(key, lower(p_name)))
SELECT key AS term, p_partkey AS entry, CAST(row_number() OVER (PARTITION BY key ORDER BY lower(p_name) <> key, p_retailprice DESC, p_brand, p_name, p_partkey) AS INTEGER) AS rank, CASE WHEN lower(p_name) = key THEN 'exact' ELSE 'contains' END AS match_type FROM m QUALIFY rank <= 3
""")
def lookup_terms_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entries for a table of terms from a stored index: short terms read their first ranks only."""
    part = table(spark, sf_dir, "part")
    keys = part.select(F.lower(F.split("p_name", " ")[1]).alias("key")).union(part.where("p_size = 7").select(joined(F.lower("p_name"), " indeed"))).union(spark.createDataFrame([("e",), ("zz",), ("",)], "key string")).distinct()
    index = part.select(C("p_brand").alias("src_lang"), F.lit("y").alias("tgt_lang"), C("p_name").alias("source_text"), C("p_retailprice").alias("confidence"), F.lower("p_name").alias("norm_key"), C("p_partkey").alias("_ord"))
    found = lookup_index.store(index, scratch_path(spark, "lexicon")).lookup_terms(keys.select(C("key").alias("term_id"), "key"), 3)
    return found.select(C("term_id").alias("term"), C("_ord").alias("entry"), "rank", "match_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def incremental_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals of (user, type) by a stream over the event file, run until nothing new is there."""
    base = scratch_path(spark, "stream")
    stream = streams.read_arriving(spark, sf_dir, table(spark, sf_dir, "events").schema, "parquet", name="events.parquet")
    first = streams.first_arrivals(stream.select("user_id", "event_type"), ["user_id", "event_type"])
    streams.append_available(first, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each micro-batch, written under its number, so that a batch that is run again takes its own place; then added up."""
    base = scratch_path(spark, "batches")
    stream = streams.read_arriving(spark, sf_dir, table(spark, sf_dir, "events").schema, "parquet", name="events.parquet")
    streams.each_batch(stream, lambda df, i: df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("event_type string, n long, batch long").parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


def packed_sql(most: int, source: str) -> str:
    """Common table expressions, up to k (doc_id, pieces): greedy packing of each text's sentences as one fold."""
    return rf"""
s AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM {source}),
c AS (SELECT doc_id, lang, t, list_filter(list_transform(string_split_regex(t, '(?:\\n+|[.!?！？。；;])'), lambda x: trim(left(trim(x), {most}))), lambda x: x <> '') AS parts FROM s),
k AS (SELECT doc_id, lang, CASE WHEN t = '' THEN []::VARCHAR[] WHEN length(t) <= {most} THEN [t] WHEN len(parts) = 0 THEN []::VARCHAR[] ELSE list_append(f.out, f.buf) END AS pieces
  FROM (SELECT *, list_reduce(list_transform(parts, lambda x: struct_pack(buf := x, out := []::VARCHAR[])), lambda a, x: CASE WHEN length(a.buf) + 1 + length(x.buf) <= {most} THEN struct_pack(buf := a.buf || ' ' || x.buf, out := a.out) ELSE struct_pack(buf := x.buf, out := list_append(a.out, a.buf)) END) AS f FROM c WHERE len(parts) > 0 UNION ALL SELECT *, NULL FROM c WHERE len(parts) = 0))"""


@query(f"WITH {packed_sql(300, 'documents')} SELECT doc_id, CAST(unnest(range(len(pieces))) AS INTEGER) AS pos, md5(unnest(pieces)) AS piece FROM k")
def pack_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, heavy=True).select("doc_id", F.posexplode(text.pack_sentences(C("text"), 300)).alias("pos", "piece")).withColumn("piece", F.md5("piece"))


def greedy_sql(most: int, source: str) -> str:
    """Common table expressions, up to g (doc_id, lang, pos, piece): the ordered pass, one document of each language at a time, with the hashes taken so far."""
    return rf"""{packed_sql(most, source)},
e AS (SELECT doc_id, lang, unnest(range(len(pieces))) AS pos, unnest(pieces) AS piece FROM k),
f AS (SELECT doc_id, lang, list(struct_pack(pos := pos, piece := piece) ORDER BY pos) AS l FROM e WHERE length(piece) >= 20 AND length(regexp_replace(piece, '[^A-Za-z]', '', 'g')) >= 0.45 * length(regexp_replace(piece, '\s+', '', 'g')) GROUP BY doc_id, lang),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM f),
w(lang, n, doc_id, won, seen) AS (SELECT lang, 0, NULL::BIGINT, NULL::STRUCT(pos BIGINT, piece VARCHAR), []::VARCHAR[] FROM (SELECT DISTINCT lang FROM o)
  UNION ALL SELECT lang, n, doc_id, x, CASE WHEN x IS NULL THEN seen ELSE list_append(seen, md5(x.piece)) END FROM (SELECT w.lang, o.n, o.doc_id, seen, list_filter(o.l, lambda y: NOT list_contains(seen, md5(y.piece)))[1] AS x FROM w JOIN o ON o.lang = w.lang AND o.n = w.n + 1)),
g AS (SELECT doc_id, lang, won.pos AS pos, won.piece AS piece FROM w WHERE won IS NOT NULL)"""


@query(f"WITH RECURSIVE {greedy_sql(300, 'documents')} SELECT lang, doc_id, CAST(pos AS INTEGER) AS pos, md5(piece) AS piece FROM g")
def greedy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.candidates(documents(spark, sf_dir, heavy=True), C("lang"), 20, 300)
    return sampling.greedy_sources(found).select("lang", C("_ord").alias("doc_id"), "pos", F.md5("text").alias("piece"))


@query(f"WITH RECURSIVE {greedy_sql(300, '''(SELECT * FROM documents WHERE lang = 'en')''')} SELECT 'Translate the following English text into Spanish. Output only the translation.' AS instruction, piece AS input, piece AS output, sha1(piece) AS source_hash FROM g WHERE sha1(piece) NOT LIKE '%7' ORDER BY doc_id LIMIT 100")
def synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monolingual text to a quota of checked synthetic pairs, with a translator that answers the text itself, or now and then in a script that is turned away."""
    import hashlib

    def answer(prompt: str) -> str:
        own = prompt.split("\n\n", 1)[1]
        return "กขค" * 20 if hashlib.sha1(own.encode()).hexdigest().endswith("7") else own

    docs = documents(spark, sf_dir, heavy=True).where("lang = 'en'")
    return programs.synthetic_pairs(docs, "eng_Latn", "spa_Latn", answer, 100, max_chars=300).select("instruction", "input", "output", C("meta.source_hash").alias("source_hash"))


def bleu_sql(tokens: str, keys: str) -> str:
    """Corpus BLEU of rows w (keys, id, h, r), by keys."""
    return f"""{tokens},
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT {keys}, id, n, array_to_string(h[i:i + n - 1], chr(1)) AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM w, n WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT id, n, array_to_string(r[i:i + n - 1], chr(1)) AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM w, n WHERE len(r) >= n) GROUP BY ALL),
m AS (SELECT {keys}, n, sum(least(hg.c, coalesce(rg.c, 0))) AS m, sum(hg.c) AS t FROM hg LEFT JOIN rg USING (id, n, gram) GROUP BY ALL),
l AS (SELECT {keys}, sum(len(h)) AS hl, sum(len(r)) AS rl, count(*) AS num FROM w GROUP BY ALL),
z AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY n) AS zeros FROM m),
b AS (SELECT {keys}, sum(CASE WHEN m > 0 THEN ln(100.0 * m / t) ELSE ln(100.0 / (pow(2, zeros) * t)) END) AS logs, sum(m) AS hits, count(*) AS orders FROM z GROUP BY ALL)
SELECT {keys}, round(CASE WHEN hits = 0 OR orders < 4 THEN 0 ELSE CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * exp(logs / 4) END, 6) AS bleu, num FROM b JOIN l USING ({keys})"""


def mteval_sql(c: str) -> str:
    out = f"' ' || {c} || ' '"
    for find, put in ((r"([\{-~\[-\x60 -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        out = f"regexp_replace({out}, '{find}', '{put}', 'g')"
    return rf"list_filter(string_split_regex({out}, '\s+'), lambda x: x <> '')"


@query("WITH " + TURNS + ", " + bleu_sql(f"w AS (SELECT conv_id || ':' || turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'flores' ELSE 'd' END AS corpus, CASE WHEN conv_id % 2 = 0 THEN '13a_spbleu_fallback' ELSE '13a' END AS bleu_tokenizer, {mteval_sql('replace(replace(replace(replace(trim(input), chr(38) || chr(113) || chr(117) || chr(111) || chr(116) || chr(59), chr(34)), chr(38) || chr(97) || chr(109) || chr(112) || chr(59), chr(38)), chr(38) || chr(108) || chr(116) || chr(59), chr(60)), chr(38) || chr(103) || chr(116) || chr(59), chr(62))')} AS h, {mteval_sql('trim(output)')} AS r FROM t)", "corpus, bleu_tokenizer"))
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU by policy over stored hypotheses, with fallbacks of absent tokenizers."""
    rows = turns(spark, sf_dir).select(F.when(C("conv_id") % 2 == 0, "flores").otherwise("").alias("eval_corpus"), F.lit("d").alias("dataset"), F.lit("eng_Latn").alias("src_lang"), F.lit("spa_Latn").alias("tgt_lang"), F.lit("").alias("eval_pair"), C("input").alias("hypothesis"), C("output").alias("reference_text"), "_ord")
    return metrics.evaluate(rows).select("corpus", "bleu_tokenizer", F.round("bleu", 6).alias("bleu"), "num")


@query(f"""
WITH {TURNS}, n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) - 1) // 4 AS chunk FROM t),
i AS (SELECT conv_id % 3 AS part, chunk, input, output, row_number() OVER (PARTITION BY conv_id % 3, chunk ORDER BY conv_id, turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id % 3, chunk) AS size FROM n),
d AS (SELECT *, row_number() OVER (PARTITION BY part, chunk ORDER BY sha1(concat_ws('|', '42', part || ':' || chunk, i)), i) - 1 AS d FROM i), s AS (SELECT *, bool_and(i = d) OVER (PARTITION BY part, chunk) AS same FROM d)
SELECT CAST(part AS BIGINT) AS part, CAST(chunk AS BIGINT) AS chunk, md5('Source paragraph:' || chr(10) || string_agg(input, chr(10) ORDER BY i) || chr(10) || chr(10) || 'Initial translation:' || chr(10) || string_agg(output, chr(10) ORDER BY CASE WHEN same THEN (i + size - 1) % size ELSE d END) || chr(10)) AS input, md5(string_agg(output, chr(10) ORDER BY i)) AS output FROM s WHERE size >= 2 GROUP BY part, chunk
""")
def permuted_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("part", C("conv_id") % 3)
    chunks = sampling.chunked(rows, 4, ["part"])
    key: Column = F.concat_ws(":", "part", "chunk")
    made = sampling.draft_refine(chunks, "Refine.", sampling.permuted(C("tgt_lines"), 42, key))
    return made.select("part", "chunk", F.md5("input").alias("input"), F.md5("output").alias("output"))


def plain_marks(c: str) -> str:
    """The tokenizer's four marks in a text as their characters, in DuckDB's SQL."""
    for name, char in (("quot", 34), ("amp", 38), ("lt", 60), ("gt", 62)):
        c = f"replace({c}, chr(38) || '{name}' || chr(59), chr({char}))"
    return c


@query("WITH " + TURNS + ", " + bleu_sql(f"w AS (SELECT conv_id || ':' || turn AS id, CASE WHEN conv_id % 3 = 0 THEN 'a' ELSE 'b' END AS run, {mteval_sql(plain_marks('trim(CASE WHEN conv_id % 3 = 0 THEN left(output, greatest(length(output) - 20, 0)) ELSE output || chr(32) || input END)'))} AS h, {mteval_sql(plain_marks('trim(output)'))} AS r FROM t)", "run"))
def evaluated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' stored hypotheses at once: answers that break off, and answers that go on with the question; a run without any is passed over."""
    said = F.when(C("conv_id") % 3 == 0, F.expr("left(output, greatest(length(output) - 20, 0))")).otherwise(joined(C("output"), " ", C("input")))
    rows = turns(spark, sf_dir).select(F.lit("d").alias("dataset"), F.lit("eng_Latn").alias("src_lang"), F.lit("spa_Latn").alias("tgt_lang"), F.concat_ws(":", "conv_id", "turn").alias("sample_id"), C("input").alias("source_text"), C("output").alias("reference_text"), said.alias("hypothesis"), "conv_id", F.lit("").alias("eval_corpus"), F.lit("").alias("eval_pair"), "_ord")
    out = None
    for run, part in (("a", "conv_id % 3 = 0"), ("b", "conv_id % 3 <> 0")):
        one = programs.evaluate_runs({run: rows.where(part), "none": None}, rows.where(part).drop("hypothesis"))
        out = one if out is None else out.unionByName(one)
    return out.select("run", F.round("bleu", 6).alias("bleu"), "num")


THAI_LIST = ("กา", "นี", "โต๊ะ", "ดู", "มา", "ไป", "รถ", "เมือง")


@query(f"""
WITH w AS (SELECT {list(THAI_LIST)} AS w), k AS (SELECT p_partkey, p_size, w[p_partkey % 8 + 1] AS a, w[p_partkey // 8 % 8 + 1] AS b, w[p_partkey // 64 % 8 + 1] AS c FROM part, w)
SELECT p_partkey, concat_ws(' ', a, b, 'ซซ', c, p_size, 'AB', b) AS words FROM k
""")
def thai_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made of a list of Thai words, with characters outside of it, numbers and Latin words, cut into their words."""
    word = [case(F.floor(C("p_partkey") / 8**k).cast("long"), *[F.lit(t) for t in THAI_LIST]) for k in range(3)]
    made = joined(word[0], word[1], "ซซ", word[2], C("p_size").cast("string"), " AB", word[1])
    return table(spark, sf_dir, "part").select("p_partkey", metrics.thai_words(THAI_LIST)(made).alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN upper(source || ':' || doc_id) END AS hypothesis, CASE WHEN doc_id % 5 = 0 THEN 'turned away: ' || source || ':' || doc_id END AS error FROM documents")
def windowed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document through a window of eight a partition; every fifth is turned away."""

    def answer(prompt: str) -> str:
        if int(prompt.rsplit(":", 1)[1]) % 5 == 0:
            raise ValueError(f"turned away: {prompt}")
        return prompt.upper()

    asked = documents(spark, sf_dir).select("doc_id", joined(C("source"), ":", C("doc_id").cast("string")).alias("prompt"))
    return remote.translate(asked, answer, "prompt", workers=8, retries=0).select("doc_id", "hypothesis", "error")


@query("SELECT doc_id, lang || '>' || source || ' ' || length(text) AS hypothesis FROM documents")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by direction and like length in batches under a budget of padded words; each answer is back at its row."""
    rows = documents(spark, sf_dir).select("doc_id", C("text").alias("source_text"), C("lang").alias("src_lang"), C("source").alias("tgt_lang"))
    return remote.in_length_batches(rows, lambda texts, src, tgt: [f"{src}>{tgt} {len(t)}" for t in texts], 16384).select("doc_id", "hypothesis")


@query("SELECT lang AS key, count(*) AS rows, count(*) FILTER (text <> '') AS filled, CAST(sum(length(text)) AS BIGINT) AS chars, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY lang")
def shard_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by language of the documents as six shards: two at first, then all, of which the first two aren't read again."""
    path, store = scratch_path(spark, "shards"), scratch_path(spark, "statistics")
    documents(spark, sf_dir).select("lang", "text").repartition(6).write.parquet(path)
    found = readers.find_files(spark, path, "*.parquet")
    shards.update_statistics(spark, found, store, C("lang"), C("text"), max_shards=2)
    return shards.merged(shards.update_statistics(spark, found, store, C("lang"), C("text")))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 300")
def pulled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as pages of a hundred, pulled four at a time until 300 clicks are there."""
    path, shelf = scratch_path(spark, "pages"), 1000  # pages a folder: one folder a page would be as many files as pages
    paged_rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor(C("event_id") / 100).alias("page")).withColumn("shelf", F.floor(C("page") / shelf))
    paged_rows.repartition("shelf").sortWithinPartitions("shelf", "page").write.partitionBy("shelf").parquet(path)

    def fetch(page: int) -> list[tuple] | None:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = fs.FileSystem.from_uri(path)
        files = store.get_file_info(fs.FileSelector(f"{root}/shelf={page // shelf}", allow_not_found=True))
        found = [pq.read_table(f.path, columns=["event_id", "event_type"], filesystem=store, partitioning=None, filters=[("page", "=", page)]) for f in files if f.path.endswith(".parquet")]
        return sorted((r["event_id"], r["event_type"]) for t in found for r in t.to_pylist()) or None

    spark.dataSource.register(paged.paged_source("event-pages", "event_id long, event_type string", fetch))
    return paged.pull_until(spark, "event-pages", 300, C("event_type") == "click", pages_at_a_time=4).select("event_id", "event_type")


@query("SELECT doc_id, lang, md5(text) AS text FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON lines, and read again."""
    path = scratch_path(spark, "lines")
    writers.write_jsonl(documents(spark, sf_dir).select("doc_id", "lang", "text"), path)
    return readers.read_jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("text"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 50")
def jsonl_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by order beside a written table; the plan runs once for both."""
    path = scratch_path(spark, "lines")
    writers.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "source", (-C("doc_id")).alias("_ord")), path)
    return readers.read_jsonl(spark, f"{path}.preview_{writers.PREVIEW}", "doc_id long, source string").select("doc_id", "source")


@query(f"WITH {TURNS} SELECT input, output FROM t WHERE (conv_id + turn) % 3 = 0 AND trim(input) <> '' AND trim(output) <> ''")
def raw_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of which some are pairs, some are cut off, some blank and some JSON of another shape."""
    path = scratch_path(spark, "raw")
    k = C("conv_id") + C("turn")
    whole = F.to_json(F.struct("input", "output"))
    line = F.when(k % 3 == 0, whole).when(k % 6 == 1, F.expr("left(to_json(struct(input, output)), 9)")).when(k % 6 == 2, F.lit("  ")).otherwise(F.to_json(F.struct("input")))
    turns(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.parse_alpaca(readers.read_lines(spark, path, only_json=True)).select("input", "output")


@query("SELECT doc_id % 4 = 0 AS bad, count(*) AS n, max(CASE WHEN doc_id % 4 = 0 THEN 'e' || (doc_id % 3) END) AS worst FROM documents GROUP BY 1")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an error are set aside."""
    rows = documents(spark, sf_dir).select("doc_id", F.when(C("doc_id") % 4 == 0, joined("e", (C("doc_id") % 3).cast("string"))).alias("error"))
    good, bad = writers.quarantine(rows)
    sides = good.select(F.lit(False).alias("bad"), F.lit(None).cast("string").alias("error")).unionByName(bad.select(F.lit(True).alias("bad"), "error"))
    return sides.groupBy("bad").agg(F.count("*").alias("n"), F.max("error").alias("worst"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0")
def copied_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that is made once, and not again over what is there."""
    src, dst = scratch_path(spark, "source"), scratch_path(spark, "copy")
    docs, schema = table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id long, lang string"
    docs.where("doc_id % 2 = 0").write.json(src)
    writers.copy_table(spark, src, dst, schema)
    docs.where("doc_id % 2 = 1").write.mode("overwrite").json(src)
    writers.copy_table(spark, src, dst, schema)
    return spark.read.schema(schema).json(dst)


@query("SELECT doc_id, upper(lang) AS lang FROM documents")
def published_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table whose column is rewritten as its next version."""
    path, schema = scratch_path(spark, "published"), "doc_id long, lang string"
    writers.publish(spark, table(spark, sf_dir, "documents").select("doc_id", "lang"), path)
    before = writers.read_published(spark, path, schema)
    writers.publish(spark, before.withColumn("lang", F.upper("lang")), path)
    return writers.read_published(spark, path, schema)


@query("SELECT doc_id, lang || '>' || source || ' ' || length(text) AS hypothesis FROM documents")
def batched_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by direction in batches of a fixed number."""
    rows = documents(spark, sf_dir).select("doc_id", C("text").alias("source_text"), C("lang").alias("src_lang"), C("source").alias("tgt_lang"))
    return remote.translate_batches(rows, lambda texts, src, tgt: [f"{src}>{tgt} {len(t)}" for t in texts]).select("doc_id", "hypothesis")


@query("SELECT doc_id, reverse(source || ' ' || doc_id) AS hypothesis FROM documents")
def line_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One process a partition that answers each line with the line backwards."""
    rows = documents(spark, sf_dir).select("doc_id", joined(C("source"), " ", C("doc_id").cast("string")).alias("source_text"))
    command = ["python", "-c", "import sys\nfor line in sys.stdin: print(line.strip()[::-1], flush=True)"]
    return remote.translate_lines(rows, command).select("doc_id", "hypothesis")


@query("SELECT lang AS name, 'ok' AS status, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'none', 'failed', NULL")
def directions_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each language side by side, and one that fails; how each ended."""
    docs = table(spark, sf_dir, "documents")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())  # the configured languages
    jobs = {x: (lambda x=x: docs.where(C("lang") == x).count()) for x in langs} | {"none": lambda: docs.where("lang = 'none'").first().doc_id}
    tally = programs.run_directions(jobs, spark=spark)
    return spark.createDataFrame([(o.name, o.status, o.result) for o in tally.outcomes.values()], "name string, status string, n long")
