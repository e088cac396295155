"""Registered queries for the engine's own operators on the test tables, with their SQL.

Each entry is (query, SQL); SQL is None where it can't express the operator (those are tested against plain Python).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, text
from .operators import incremental, lexicon, lookup_index, metrics, pairs, remote, sampling
from .registering import ORACLES, QUERIES, TURNS, WS, documents, query, stripped_sql, table, turns
from .sources import readers, writers
from .storage import scratch_path

__all__ = ["ORACLES", "QUERIES"]


@query(f"""
WITH c AS (SELECT doc_id, lang, {WS} AS t FROM documents),
g AS (SELECT doc_id, lang, t FROM c WHERE length(t) >= 20 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 0.55 * length(replace(t, ' ', ''))),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS r FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM k WHERE r = 1)
SELECT lang, count(*) AS n, sum(length('Instruction: Continue.' || chr(10) || 'Input: ' || t || chr(10) || 'Response: ' || lang)) AS block_chars FROM f WHERE n <= 100 GROUP BY lang
""")
def text_clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, filter, dedup, first rows per language, text blocks, counts: the smallest whole program."""
    # a generator binds the clean text once: filters on it aren't pushed below, where each would clean it again
    clean = documents(spark, sf_dir, heavy=True).select("doc_id", "lang", "_ord", F.inline(F.array(F.struct(text.normalize_space(F.col("text")).alias("text")))))
    good = clean.where((F.length("text") >= 20) & (text.script_ratio(F.col("text"), "latin") >= 0.55))
    slim = good.select("doc_id", "lang", "_ord", F.sha1("text").alias("hash"), F.length(pairs.block(F.lit("Continue."), F.col("text"), F.col("lang"))).alias("chars"))
    first = pairs.first_rows(pairs.keep_first(slim, F.col("hash"), narrow=True), 100, ["lang"])
    return first.groupBy("lang").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("block_chars"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = documents(spark, sf_dir).select("doc_id", "_ord", F.sha1("text").alias("hash"))
    return pairs.keep_first(slim, F.col("hash"), narrow=True).select("doc_id")


@query("SELECT coalesce(nullif(trim(lang), ''), '(missing)') AS language, count(*) AS n FROM documents GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.language_counts(documents(spark, sf_dir), F.col("lang"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 200) WHERE r <= 25")
def first_n_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.first_rows(documents(spark, sf_dir).where(F.length("text") >= 200), 25, ["lang"]).select("lang", "doc_id")


@query("""SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha1(concat_ws('|', '42', source, lang, CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents) WHERE r <= 7""")
def per_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_key(documents(spark, sf_dir).select("source", "lang", "doc_id"), 7, 42, ["source", "lang"], "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY sha1(concat_ws('|', '7', CAST(doc_id AS VARCHAR))), doc_id LIMIT 150")
def global_sample_keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_keep_order(documents(spark, sf_dir).select("doc_id", "source", "_ord"), 150, 7, "doc_id").select("doc_id", "source")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1(concat_ws('|', '5', CAST(doc_id AS VARCHAR))), doc_id) AS place FROM documents QUALIFY place <= 40")
def sample_in_drawn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.sample_lines(documents(spark, sf_dir).select("doc_id"), 40, 5, "doc_id")
    return drawn.withColumn("place", F.row_number().over(sampling.Window.orderBy(sampling.draw(5, F.col("doc_id")), "doc_id")).cast("long"))


@query("""
WITH l AS (SELECT DISTINCT lang FROM documents), g AS (SELECT lang, CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('fr', 'de') THEN 1 ELSE 2 END AS grp FROM l UNION ALL SELECT 'en', 2),
p AS (SELECT a.lang AS a, b.lang AS b FROM g a JOIN g b ON a.grp < b.grp WHERE a.lang <> b.lang)
SELECT src_lang, tgt_lang, count(*) AS times FROM (SELECT a AS src_lang, b AS tgt_lang FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL
""")
def direction_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = documents(spark, sf_dir).select("lang").distinct()
    groups = langs.select(F.when(F.col("lang") == "en", 0).when(F.col("lang").isin("fr", "de"), 1).otherwise(2).alias("group"), F.col("lang").alias("pos"), "lang").union(spark.createDataFrame([(2, "en", "en")], "group int, pos string, lang string"))
    return pairs.expand_directions(groups).groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("times"))


@query("SELECT 'conv' AS dataset, CAST(u.conv_id AS VARCHAR) || ':' || u.turn AS sample_id, trim(u.text) AS source_text, trim(a.text) AS reference_text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND trim(u.text) <> '' AND trim(a.text) <> ''")
def parallel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    sides = {}
    for role, back in (("user", 0), ("assistant", 1)):
        one = rows.where(F.col("role") == role).select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string")).alias("id"), F.col("text").alias("sentence"), F.col("turn").alias("_ord"))
        sides[role] = readers.language_table(one)
    return pairs.parallel_corpus(sides["user"], sides["assistant"], "conv", "test", "user", "assistant").select("dataset", "sample_id", "source_text", "reference_text")


@query(f"WITH {TURNS} SELECT 'Translate the following English text into Simplified Chinese. Output only the translation' || ' Do not use Traditional Chinese.' AS instruction, trim(input) AS input, trim(output) AS output FROM t WHERE trim(input) <> '' AND trim(output) <> ''")
def alpaca_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = pairs.both_filled(turns(spark, sf_dir), "input", "output")
    return pairs.alpaca(good, names.candidate_instruction(F.lit("eng_Latn"), F.lit("zho_Hans"))).drop("_ord")


@query(rf"WITH {TURNS} SELECT 'Instruction: Translate the following English text into Thai. Output only the translation.' || chr(10) || 'Input: ' || trim(regexp_replace(input, '\s+', ' ', 'g')) || chr(10) || 'Response: ' || trim(regexp_replace(output, '\s+', ' ', 'g')) AS text FROM t")
def iir_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.alpaca(turns(spark, sf_dir), names.sentence_instruction(F.lit("eng_Latn"), F.lit("tha_Thai")))
    return pairs.blocks(rows).drop("_ord")


@query(f"""
WITH {TURNS}, n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) - 1) // 4 AS chunk FROM t)
SELECT CAST(conv_id % 3 AS BIGINT) AS part, CAST(chunk AS BIGINT) AS chunk, 'Refine.' AS instruction, 'Source paragraph:' || chr(10) || string_agg(input, chr(10) ORDER BY conv_id, turn) || chr(10) || chr(10) || 'Initial translation:' || chr(10) || string_agg(output, chr(10) ORDER BY conv_id, turn) || chr(10) AS input, string_agg(output, chr(10) ORDER BY conv_id, turn) AS output
FROM n GROUP BY conv_id % 3, chunk
""")
def draft_refine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("part", F.col("conv_id") % 3)
    return sampling.draft_refine(sampling.chunked(rows, 4, ["part"]), "Refine.", F.col("tgt_lines")).select("part", "chunk", "instruction", "input", "output")


@query("""
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS src, p_type AS tgt FROM part), f AS (SELECT lower(src) AS key, lower(tgt) AS k, min(p_partkey) AS o, min_by(tgt, p_partkey) AS v FROM p GROUP BY 1, 2),
s AS (SELECT lower(src) AS key, min_by(src, p_partkey) AS source_text FROM p GROUP BY 1), r AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY o) AS n FROM f)
SELECT source_text, string_agg(v, ';' ORDER BY n) AS candidates, min_by(v, n) AS target_text, CAST(0.82 AS DOUBLE) AS confidence FROM r JOIN s USING (key) WHERE n <= 4 GROUP BY source_text
""")
def lexicon_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("src"), F.col("p_type").alias("tgt"), F.col("p_partkey").alias("_ord"))
    made = lexicon.word_list_lexicon(words, "eng_Latn", "spa_Latn", 4)
    return made.select("source_text", F.array_join("target_candidates", ";").alias("candidates"), "target_text", "confidence")


def _part_lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    first = part.select(F.col("p_brand").alias("source_text"), F.array(F.split("p_name", " ")[0], F.split("p_name", " ")[1]).alias("target_candidates"), F.lit("").alias("target_text"), F.col("p_partkey").alias("_ord"))
    second = part.select(F.split("p_name", " ")[0].alias("source_text"), F.array("p_type").alias("target_candidates"), F.lit("").alias("target_text"), F.col("p_partkey").alias("_ord"))
    return first, second


@query("""
WITH a AS (SELECT p_brand AS src, p_partkey AS o, unnest([1, 2]) AS pos, p_name FROM part), h AS (SELECT src, o, pos, split_part(p_name, ' ', pos) AS hop FROM a),
b AS (SELECT lower(split_part(p_name, ' ', 1)) AS k, p_partkey AS o2, p_type AS v FROM part),
m AS (SELECT lower(src) AS key, src, h.o, pos, hop, o2, v FROM h JOIN b ON lower(h.hop) = b.k WHERE length(h.hop) >= 3),
w AS (SELECT key, min(o) AS o FROM m GROUP BY key), x AS (SELECT m.* FROM m JOIN w USING (key, o)),
f AS (SELECT key, lower(v) AS lv, min(pos * 1000000000 + o2) AS r, min_by(v, pos * 1000000000 + o2) AS v FROM x GROUP BY 1, 2), n AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY r) AS n FROM f),
t AS (SELECT key, min(src) AS source_text, max_by(hop, pos) AS pivot_text FROM x GROUP BY key)
SELECT source_text, pivot_text, string_agg(v, ';' ORDER BY n) AS candidates FROM n JOIN t USING (key) WHERE n <= 3 GROUP BY ALL
""")
def pivot_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _part_lexicon(spark, sf_dir)
    made = lexicon.pivot_lexicon(first, second, "spa_Latn", "zho_Hans", 3)
    return made.select("source_text", "pivot_text", F.array_join("target_candidates", ";").alias("candidates"))


def _part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("src_lang"), F.lit("y").alias("tgt_lang"), F.col("p_name").alias("source_text"), F.col("p_type").alias("target_text"), (F.col("p_retailprice") / 10000).alias("confidence"), F.lower("p_name").alias("norm_key"), F.col("p_partkey").alias("_ord"))


MATCH = "contains(lower(p_name), 'red') OR contains('red', lower(p_name))"


LEXICON_TERMS = ("red", "e", "blue metal and more", "zz")
TERM_MATCH = "(contains(lower(p_name), t) OR contains(t, lower(p_name)))"


@query(f"""
WITH t AS (SELECT unnest(['red', 'e', 'blue metal and more', 'zz']) AS t), m AS (SELECT * FROM t JOIN part ON p_brand = 'Brand#4' AND {TERM_MATCH})
SELECT t AS term, p_partkey AS entry, count(*) OVER (PARTITION BY t) AS total_matches, count(*) OVER (PARTITION BY t) > 4 AS has_more FROM m QUALIFY row_number() OVER (PARTITION BY t ORDER BY lower(p_name) <> t, p_retailprice DESC, length(p_name), p_type, p_partkey) BETWEEN 2 AND 4
""")
def lookup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pages of several terms from a stored index of the parts' names."""
    stored = lookup_index.store(_part_index(spark, sf_dir), scratch_path(spark, "lexicon"))
    out = None
    for term in LEXICON_TERMS:
        one = stored.lookup("Brand#4", "y", term, 3, 1).select(F.lit(term).alias("term"), F.col("_ord").alias("entry"), "total_matches", "has_more")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT p_partkey AS entry, p_name AS source_text, (SELECT count(*) FROM part WHERE p_brand = 'Brand#4' AND ({MATCH})) AS total_matches, 2 + 3 < (SELECT count(*) FROM part WHERE p_brand = 'Brand#4' AND ({MATCH})) AS has_more FROM part WHERE p_brand = 'Brand#4' AND ({MATCH}) ORDER BY lower(p_name) <> 'red', p_retailprice DESC, length(p_name), p_type, p_partkey LIMIT 3 OFFSET 2")
def lookup_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lookup(_part_index(spark, sf_dir), "Brand#4", "y", "red", 3, 2).select(F.col("_ord").alias("entry"), "source_text", "total_matches", "has_more")


@query(f"SELECT p_partkey AS entry, CASE WHEN lower(p_name) = 'red' THEN 'exact' ELSE 'contains' END AS match_type FROM part WHERE {MATCH} ORDER BY lower(p_name) <> 'red', p_retailprice DESC, p_brand, p_name, p_partkey LIMIT 20")
def lookup_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.search(_part_index(spark, sf_dir), "red", top_k=20).select(F.col("_ord").alias("entry"), "match_type")


@query("""
WITH e AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS src_lang, p_name || CASE WHEN p_size % 2 = 0 THEN ' even' ELSE ' odd' END AS source_text, p_type, p_retailprice, p_partkey FROM part)
SELECT CAST(0 AS BIGINT) AS total_matches, 'other_sources' AS scope, CAST(row_number() OVER (ORDER BY p_retailprice DESC, src_lang, source_text, p_partkey) AS INTEGER) AS rank, source_text, p_type AS target_text FROM e WHERE contains(lower(source_text), 'odd') QUALIFY rank <= 5
""")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that its direction doesn't hold: suggestions from other sources."""
    even = F.col("p_size") % 2 == 0
    rows = table(spark, sf_dir, "part").select(F.when(even, "a").otherwise("b").alias("src_lang"), F.lit("y").alias("tgt_lang"), F.concat("p_name", F.when(even, " even").otherwise(" odd")).alias("source_text"), F.col("p_type").alias("target_text"), F.array("p_type").alias("target_candidates"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("_ord"))
    found = lexicon.lookup_with_fallback(lexicon.loaded(rows), "a", "y", "Odd", 5, 0, 5)
    made = [(found["total_matches"], found["fallback_scope"], i, r["source_text"], r["target_text"]) for i, r in enumerate(found["fallback_results"], 1)]
    return spark.createDataFrame(made, "total_matches long, scope string, rank int, source_text string, target_text string")


@query("SELECT lang AS src_lang, source AS tgt_lang, count(*) AS size FROM documents GROUP BY ALL")
def pair_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.inventory(documents(spark, sf_dir).select(F.col("lang").alias("src_lang"), F.col("source").alias("tgt_lang")))


@query("SELECT 'Translate the following English dictionary term into Spanish. Output only the best translation.' AS instruction, p_name || chr(10) || 'Candidates: ' || p_type || '; ' || p_brand AS input, p_type AS output, p_brand AS all_last FROM part")
def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lit("t").alias("source"), F.lit("eng_Latn").alias("src_lang"), F.lit("spa_Latn").alias("tgt_lang"), F.col("p_name").alias("source_text"), F.col("p_type").alias("target_text"), F.array("p_type", "p_brand").alias("target_candidates"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("pivot_text"))
    return lexicon.term_pairs(rows, 2, True).select("instruction", "input", "output", F.element_at("meta.all_targets", -1).alias("all_last"))


def _as_results(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("d").alias("dataset"), F.lit("a").alias("src_lang"), F.lit("b").alias("tgt_lang"), F.col("doc_id").cast("string").alias("sample_id"), "_ord")


@query("SELECT CAST(doc_id AS VARCHAR) AS sample_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").withColumn("_ord", F.col("doc_id"))
    return incremental.pending(_as_results(documents(spark, sf_dir)), _as_results(done)).select("sample_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'b' || item_id, 'extra' FROM benchmark")
def missing_and_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results: the labels, and benchmark items that no document asked for."""
    items = _as_results(documents(spark, sf_dir))
    others = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("doc_id"), F.col("item_id").alias("_ord"))
    done = _as_results(table(spark, sf_dir, "labels").withColumn("_ord", F.col("doc_id"))).unionByName(_as_results(others))
    return incremental.pending(items, done).select("sample_id", F.lit("missing").alias("kind")).union(incremental.extra(items, done).select("sample_id", F.lit("extra").alias("kind")))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, CAST(quality AS VARCHAR) AS hypothesis FROM documents d JOIN labels l USING (doc_id)")
def reassemble_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").withColumn("_ord", F.col("doc_id"))
    done = _as_results(marks).join(marks.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").cast("string").alias("hypothesis")), "sample_id")
    old = done.withColumn("hypothesis", F.lit("old")).withColumn("_ord", F.lit(-1).cast("long"))
    return incremental.matched(_as_results(documents(spark, sf_dir)), done.unionByName(old)).select("sample_id", "hypothesis")


ROUTES = [("en", "src1", "m1", 0), ("en", "src1", "m2", 1), ("fr", "src2", "m3", 2), ("de", "src3", " ", 3), ("", "src4", "m4", 4)]


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'm2' ELSE 'm3' END AS routed_model FROM documents WHERE (lang = 'en' AND source = 'src1') OR (lang = 'fr' AND source = 'src2')")
def route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    experts = spark.createDataFrame(ROUTES, "src_lang string, tgt_lang string, adapter_name string, _ord int")
    items = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("src_lang"), F.col("source").alias("tgt_lang"))
    return pairs.routed(items, experts).select("doc_id", "routed_model")


@query("SELECT doc_id, lang AS src_lang, source AS tgt_lang FROM documents WHERE (lang = 'en' AND source = 'src1') OR (lang = 'es' AND source = 'src0')")
def supported_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("en", "src1"), ("es", "src0")], "src_lang string, tgt_lang string")
    items = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("src_lang"), F.col("source").alias("tgt_lang"))
    return pairs.supported_only(items, known).select("doc_id", "src_lang", "tgt_lang")


@query("SELECT part, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM (SELECT 0 AS part, text AS value FROM documents UNION ALL SELECT 1, text FROM benchmark) WHERE trim(value) <> '' GROUP BY part")
def union_all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col("text").alias("value")) for t in ("documents", "benchmark")]
    return sampling.weighted_union(parts).groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("""
WITH RECURSIVE w AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS lang, unnest([2, 1, 1, 1]) AS w, unnest([1, 2, 3, 4]) AS k), n AS (SELECT w.lang, w.k, count(doc_id) AS n, CAST(floor(50 * first(w.w) / 5) AS BIGINT) AS c FROM w LEFT JOIN documents d ON d.lang = w.lang GROUP BY w.lang, w.k),
a(l) AS (SELECT list(struct_pack(p := lang, n := n, c := least(n, c)) ORDER BY k) FROM n
  UNION ALL SELECT list_transform(l, lambda x, i: struct_pack(p := x.p, n := x.n, c := x.c + CASE WHEN x.c < x.n AND len(list_filter(l[1:i - 1], lambda y: y.c < y.n)) < 50 - list_sum(list_transform(l, lambda y: y.c)) THEN 1 ELSE 0 END)) FROM a WHERE list_sum(list_transform(l, lambda y: y.c)) < 50 AND len(list_filter(l, lambda y: y.c < y.n)) > 0),
t AS (SELECT unnest(l) AS x FROM (SELECT l FROM a ORDER BY list_sum(list_transform(l, lambda y: y.c)) DESC LIMIT 1))
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(concat_ws('|', '42', lang, CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents) JOIN t ON x.p = lang WHERE r <= x.c
""")
def weighted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = documents(spark, sf_dir).select("doc_id", "lang")
    return sampling.weighted_mixture(pools, {"en": 2.0, "fr": 1.0, "de": 1.0, "es": 1.0}, 50, 42, "lang", "doc_id")


def _mix_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = documents(spark, sf_dir).select(F.col("lang").alias("src_lang"), F.lit("x").alias("tgt_lang"), "source").distinct()
    return every.withColumns({"enabled": F.col("source") != "src0", "limit": F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", None).otherwise(3).cast("long")})


MIXED = "m AS (SELECT lang AS src_lang, 'x' AS tgt_lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha1(concat_ws('|', '9', lang, 'x', source, CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents WHERE source NOT IN ('src0', 'src1') QUALIFY source = 'src2' OR r <= 3)"


@query(f"WITH {MIXED} SELECT src_lang, tgt_lang, source, doc_id FROM m")
def per_direction_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("lang").alias("src_lang"), F.lit("x").alias("tgt_lang"), "source", "doc_id")
    return sampling.direction_mixture(rows, _mix_config(spark, sf_dir), 9, "doc_id")


@query(f"WITH {MIXED}, e AS (SELECT DISTINCT lang AS src_lang, 'x' AS tgt_lang, source FROM documents), c AS (SELECT src_lang, tgt_lang, source, count(*) AS n FROM m GROUP BY ALL) SELECT src_lang, tgt_lang, CAST(sum(coalesce(n, 0)) AS BIGINT) AS num_rows, string_agg(source || '=' || coalesce(n, 0), ',' ORDER BY source) AS counts FROM e LEFT JOIN c USING (src_lang, tgt_lang, source) GROUP BY ALL")
def mixture_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sampling.mixture_manifest(per_direction_mixture(spark, sf_dir), _mix_config(spark, sf_dir))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("source_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return made.select("src_lang", "tgt_lang", "num_rows", flat.alias("counts"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1(concat_ws('|', '3', CAST(doc_id AS VARCHAR))), doc_id) AS place FROM documents QUALIFY place <= 50")
def shuffled_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a full shuffle."""
    head = sampling.shuffle(documents(spark, sf_dir).select("doc_id"), 3, "doc_id").limit(50)
    return head.withColumn("place", F.row_number().over(sampling.Window.orderBy(sampling.draw(3, F.col("doc_id")), "doc_id")).cast("long"))


SEGMENTS = "s AS (SELECT source AS corpus, lang AS pair, quality AS score FROM documents JOIN labels USING (doc_id)), p AS (SELECT source AS corpus, lang AS pair, avg(n_chars) AS bleu, count(*) AS num FROM documents GROUP BY ALL)"


@query(f"""
WITH {SEGMENTS}, a AS (SELECT CASE WHEN grouping(corpus, pair) = 0 THEN 'pair' WHEN grouping(corpus, pair) = 1 THEN 'corpus' ELSE 'overall' END AS level, corpus, pair, round(sum(bleu * num) / sum(num), 6) AS bleu, CAST(sum(num) AS BIGINT) AS num FROM p GROUP BY ROLLUP (corpus, pair)),
b AS (SELECT CASE WHEN grouping(corpus, pair) = 0 THEN 'pair' WHEN grouping(corpus, pair) = 1 THEN 'corpus' ELSE 'overall' END AS level, corpus, pair, round(avg(score), 6) AS comet FROM s GROUP BY ROLLUP (corpus, pair))
SELECT a.level, a.corpus, a.pair, bleu, num, comet FROM a LEFT JOIN b ON a.level = b.level AND a.corpus IS NOT DISTINCT FROM b.corpus AND a.pair IS NOT DISTINCT FROM b.pair
""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("corpus"), F.col("lang").alias("pair"), "n_chars")
    scored = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("score", F.col("quality").cast("double"))
    by_pair = docs.groupBy("corpus", "pair").agg(F.avg("n_chars").alias("bleu"), F.count("*").alias("num"))
    out = metrics.rollup_metrics(by_pair, scored)
    return out.select("level", "corpus", "pair", F.round("bleu", 6).alias("bleu"), "num", F.round("comet", 6).alias("comet"))


@query(f"""
WITH {TURNS}, w AS (SELECT conv_id, turn, conv_id % 5 AS g, string_split(trim(regexp_replace(input, '\\s+', ' ', 'g')), ' ') AS h, string_split(trim(regexp_replace(output, '\\s+', ' ', 'g')), ' ') AS r FROM t),
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT conv_id, turn, g, n, array_to_string(h[i:i + n - 1], chr(1)) AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM w, n WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, array_to_string(r[i:i + n - 1], chr(1)) AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM w, n WHERE len(r) >= n) GROUP BY ALL),
m AS (SELECT hg.g, hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS m, sum(hg.c) AS t FROM hg LEFT JOIN rg USING (conv_id, turn, n, gram) GROUP BY ALL),
l AS (SELECT g, sum(len(h)) AS hl, sum(len(r)) AS rl, count(*) AS num FROM w GROUP BY g),
z AS (SELECT g, n, m, t, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY n) AS zeros FROM m),
s AS (SELECT g, sum(CASE WHEN m > 0 THEN ln(100.0 * m / t) ELSE ln(100.0 / (pow(2, zeros) * t)) END) AS logs, sum(m) AS hits, count(*) AS orders FROM z GROUP BY g)
SELECT CAST(g AS BIGINT) AS part, round(CASE WHEN hits = 0 OR orders < 4 THEN 0 ELSE CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * exp(logs / 4) END, 6) AS bleu, num FROM s JOIN l USING (g)
""")
def corpus_bleu_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select((F.col("conv_id") % 5).alias("part"), F.col("_ord").alias("id"), metrics.tokenized(F.col("input"), F.lit("none")).alias("hyp"), metrics.tokenized(F.col("output"), F.lit("none")).alias("ref"))
    return metrics.corpus_bleu(rows, ["part"], "id").select("part", F.round("bleu", 6).alias("bleu"), "num")


def _metric_rows(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    means = docs.groupBy("source", "lang").agg(F.avg(column).alias("m"))
    return means.select(F.lit("flores").alias("corpus"), names.pair_of(F.col("source"), F.col("lang")).alias("pair"), F.round("m", 6).cast("string").alias("bleu"), F.lit(0).alias("_ord"))


@query("WITH d AS (SELECT lang, ['en', 'fr', 'de', 'es'][doc_id % 4 + 1] AS tgt, quality FROM documents JOIN labels USING (doc_id)) SELECT lang AS src, " + ", ".join(f"round(avg(quality) FILTER (tgt = '{t}'), 6) AS {t}" for t in ("en", "fr", "de", "es")) + " FROM d GROUP BY lang")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean labels as scores of directions from a document's language into others."""
    langs = ("en", "fr", "de", "es")
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("tgt", F.element_at(F.array(*[F.lit(x) for x in langs]), (F.col("doc_id") % 4 + 1).cast("int")))
    means = docs.groupBy("lang", "tgt").agg(F.round(F.avg("quality"), 6).cast("string").alias("bleu"))
    return metrics.score_matrix(means.select(F.lit("flores").alias("corpus"), names.pair_of(F.col("lang"), F.col("tgt")).alias("pair"), "bleu", F.lit(0).alias("_ord")), "flores", langs)


@query("SELECT source || '->' || lang AS pair, round(round(avg(toxic), 6) - round(avg(quality), 6), 6) AS delta FROM documents JOIN labels USING (doc_id) GROUP BY source, lang")
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (metrics.long_scores(_metric_rows(spark, sf_dir, c), "flores") for c in ("quality", "toxic"))
    return metrics.score_delta(a, b).select("pair", F.round("delta", 6).alias("delta"))


@query("WITH m AS (SELECT round(avg(quality), 6) AS q, round(avg(toxic), 6) AS t FROM documents JOIN labels USING (doc_id) GROUP BY source, lang) SELECT round(min(q), 6) AS vmin, round(max(q), 6) AS vmax, round(max(abs(t - q)), 6) AS scale FROM m")
def global_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (metrics.long_scores(_metric_rows(spark, sf_dir, c), "flores") for c in ("quality", "toxic"))
    return metrics.global_scale(a).crossJoin(F.broadcast(metrics.delta_scale(metrics.score_delta(a, b)))).select("vmin", "vmax", F.round("scale", 6).alias("scale"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS pair, CAST(o_orderkey AS INTEGER) AS step, o_totalprice AS comet FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("pair"), F.col("o_orderkey").cast("int").alias("step"), F.col("o_totalprice").alias("comet"), F.col("o_orderkey").alias("_ord"))
    return metrics.best_checkpoint(rows).select("pair", "step", "comet")


@query("""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT * FROM c WHERE length(t) >= 100 ORDER BY doc_id LIMIT 200),
g AS (SELECT *, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 0.9 * length(replace(t, ' ', '')) AS good FROM s)
SELECT count(*) AS rows_seen, count(*) FILTER (good) AS rows_passing, round(count(*) FILTER (good) / count(*), 6) AS pass_ratio, (SELECT string_agg(left(t, 400), '|' ORDER BY doc_id) FROM (SELECT * FROM g WHERE good ORDER BY doc_id LIMIT 3)) AS samples FROM g
""")
def pass_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.presence(documents(spark, sf_dir).select("text", "_ord"), 200, 100, text.script_ratio(F.col("text"), "latin") >= 0.9, 3)
    return out.select("rows_seen", "rows_passing", F.round("pass_ratio", 6).alias("pass_ratio"), F.array_join("samples", "|").alias("samples"))


@query("SELECT p_partkey, lower(p_name) AS key FROM part")
def normalize_key_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_key(F.col("p_name")).alias("key"))


@query("SELECT doc_id, sha1(text) AS hash, length(text) AS n FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha1("text").alias("hash"), F.length("text").cast("long").alias("n"))


@query("""
WITH RECURSIVE k AS (SELECT DISTINCT source || '|' || lang AS key FROM documents), s(key, i, h) AS (SELECT key, 1, CAST(0 AS BIGINT) FROM k UNION ALL SELECT key, i + 1, (h * 131 + unicode(substr(key, i, 1))) & 4294967295 FROM s WHERE i <= length(key))
SELECT key, xor(CAST(42 AS BIGINT), h) & 2147483647 AS seed FROM s WHERE i = length(key) + 1
""")
def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = documents(spark, sf_dir).select(F.concat_ws("|", "source", "lang").alias("key")).distinct()
    return keys.select("key", text.stable_seed(F.col("key"), 42).alias("seed"))


@query("SELECT source, CASE WHEN len(l) > 2 THEN array_to_string(l[:2], ', ') || ', ... (+' || (len(l) - 2) || ' more)' ELSE array_to_string(l, ', ') END AS hint FROM (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY source)")
def supported_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each source as a hint of two."""
    langs = documents(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("l"))
    return langs.select("source", names.pairs_hint(F.col("l"), 2).alias("hint"))


@query(f"""
WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN left(text, 400) WHEN 1 THEN 'short' END AS named, CASE WHEN doc_id % 3 <> 2 THEN text END AS note, source FROM documents),
c AS (SELECT doc_id, {stripped_sql("named")} AS a, {stripped_sql("note")} AS b, {stripped_sql("source")} AS c FROM n),
l AS (SELECT doc_id, CASE WHEN length(a) >= 100 THEN a WHEN coalesce(length(a), -1) >= greatest(coalesce(length(b), -1), coalesce(length(c), -1)) THEN a WHEN coalesce(length(b), -1) >= coalesce(length(c), -1) THEN b ELSE c END AS text FROM c)
SELECT doc_id, md5(text) AS text FROM l WHERE length(text) >= 100
""")
def resolve_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a known name, and where that is too short, the longest column of the row."""
    third = F.col("doc_id") % 3
    rows = documents(spark, sf_dir).select(F.when(third == 2, F.substring("text", 1, 400)).when(third == 1, "short").alias("text"), F.when(third != 2, F.col("text")).alias("note"), "source", F.col("doc_id").alias("_ord"))
    found = pairs.resolve_text(rows, ["body", "text"], 100)
    return found.select(F.col("_ord").alias("doc_id"), F.md5("text").alias("text"))


@query("SELECT 'test:' || (row_number() OVER (ORDER BY p_partkey) - 1) AS sample_id, p_name AS source_text, p_type AS reference_text FROM part QUALIFY p_size % 2 = 0")
def english_centric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a target are dropped after they were numbered: the parts written as several files of JSON lines, and read."""
    wide = table(spark, sf_dir, "part").select(F.col("p_name").alias("English"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("spa-Latn"), "p_partkey")
    path = scratch_path(spark, "wide")
    wide.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.json(path)
    rows = readers.read_jsonl(spark, path, "English string, `spa-Latn` string", numbered=True)
    return pairs.english_centric_items(rows, "d", "test", "spa_Latn").select("sample_id", "source_text", "reference_text")


@query("SELECT line, value FROM (SELECT row_number() OVER (ORDER BY event_id) AS line, CASE WHEN event_id % 50 = 7 THEN left(props, 4) ELSE props END AS value, event_id FROM events) WHERE event_id % 50 = 7")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as a file of JSON lines, some of them cut off: those are named by their number."""
    path = scratch_path(spark, "lines")
    cut = F.when(F.col("event_id") % 50 == 7, F.substring("props", 1, 4)).otherwise(F.col("props"))
    table(spark, sf_dir, "events").select("event_id", cut.alias("value")).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(path)
    return readers.malformed_lines(spark, path, "k int").select("line", "value")


@query("SELECT p_partkey, p_name AS input, p_type AS output FROM part WHERE p_size > 5")
def translation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("en"), F.col("p_name"), F.lit("es"), F.when(F.col("p_size") > 5, F.col("p_type"))).alias("translation"))
    return pairs.translation_pair(rows, "en", "es").select("p_partkey", "input", "output")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS src, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS tgt FROM part")
def oriented_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, tgt = pairs.oriented(F.col("p_name"), F.col("p_type"), F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", src.alias("src"), tgt.alias("tgt"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("_ord"))
    return pairs.keep_last(rows, ["user_id"]).select("user_id", "event_type")


@query("SELECT CASE WHEN min(lang) = max(lang) THEN min(lang) END AS pair FROM documents UNION ALL SELECT CASE WHEN min(lang) = max(lang) THEN min(lang) END FROM documents WHERE lang = 'fr'")
def single_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return metrics.single_pair(docs, F.col("lang")).union(metrics.single_pair(docs.where("lang = 'fr'"), F.col("lang")))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 10")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = documents(spark, sf_dir).select("lang", "doc_id", "_ord", F.sha1(F.col("doc_id").cast("string")).alias("hash"))
    done = table(spark, sf_dir, "labels").select(F.sha1(F.col("doc_id").cast("string")).alias("source_hash"))
    return sampling.fill_quota(sources, done, 10).select("lang", "doc_id")


@query("SELECT lang, count(DISTINCT source) AS n FROM documents WHERE lang IN ('en', 'xx', 'fr') GROUP BY lang UNION ALL SELECT 'xx', -1")
def language_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = spark.createDataFrame([("en",), ("xx",), ("fr",)], "lang string")
    there = pairs.existing_languages(asked, docs.select("lang").distinct())
    counts = docs.join(F.broadcast(there), "lang").groupBy("lang").agg(F.countDistinct("source").alias("n"))
    return counts.unionByName(pairs.missing_languages(asked, docs.select("lang").distinct()).withColumn("n", F.lit(-1).cast("long")))


@query(f"WITH {TURNS} SELECT conv_id, turn, output AS input, input AS output, sha1(input) AS reversed_from FROM t")
def reversed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = writers.reversed_pairs(turns(spark, sf_dir), F.lit("Back."))
    return made.select("_ord.conv_id", "_ord.turn", "input", "output", "meta.reversed_from")


@query(f"WITH {TURNS} SELECT conv_id, turn, 'Translate the following English text into Spanish. Output only the translation.' || chr(10) || chr(10) || input AS prompt, '<' || input || '>' AS hypothesis FROM t")
def stub_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote translation with a translator that puts the text in brackets."""
    inst = names.sentence_instruction(F.lit("eng_Latn"), F.lit("spa_Latn"))
    asked = turns(spark, sf_dir).select("conv_id", "turn", names.prompt(inst, F.col("input")).alias("prompt"))
    return remote.translate(asked, lambda p: f"<{p.split(chr(10) * 2, 1)[1]}>", "prompt", retries=0).drop("error")


@query(f"WITH {TURNS} SELECT conv_id, turn, round(length(input) / greatest(length(output), 1), 6) AS score FROM t")
def stub_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment scores with a scorer of length ratios."""
    rows = turns(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("").alias("source_text"), F.col("input").alias("hypothesis"), F.col("output").alias("reference_text"))
    scored = remote.score_segments(rows, lambda s, h, r: [len(a) / max(len(b), 1) for a, b in zip(h, r, strict=True)], "id")
    return scored.select(F.split("id", ":")[0].cast("long").alias("conv_id"), F.split("id", ":")[1].cast("long").alias("turn"), F.round("score", 6).alias("score"))


from . import table_queries  # noqa: E402, F401  registers the rest
