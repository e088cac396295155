"""Translation metrics: tokenizers, corpus BLEU, segment-score means, roll-ups, matrices, checkpoint choice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, normalize_space, strip
from ..storage import bounded_batches

ORDER = 4

#: Tokens of both sides whose grams are counted at a time; a longer single row is counted alone.
CHUNK_TOKENS = 1 << 17


def _mteval(c: Column) -> Column:
    """The language-independent part of the public mteval-v13a tokenization."""
    out = F.concat(F.lit(" "), c, F.lit(" "))
    out = F.regexp_replace(out, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([\.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([\.,])([^0-9])", " $1 $2")
    return F.regexp_replace(out, r"([0-9])(-)", "$1 $2 ")


def tokenize_13a(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("<skipped>"), F.lit("")), r"-\n", ""), r"\n", " ")
    for code, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return normalize_space(_mteval(out))


def tokenize_zh(c: Column) -> Column:
    """Each Chinese character or full-width mark apart, the rest as by mteval."""
    return normalize_space(_mteval(F.regexp_replace(strip(c), r"([⺀-⿟　-〿㇀-㇯㐀-䶿一-鿿豈-﫿︰-﹏＀-￯])", " $1 ")))


def tokenize_char(c: Column) -> Column:
    return normalize_space(F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", ""), r"(?s)(.)", "$1 "))


def tokenize_intl(c: Column) -> Column:
    """Punctuation apart unless between digits, symbols always apart."""
    out = F.regexp_replace(c, r"(\P{N})(\p{P})", "$1 $2 ")
    out = F.regexp_replace(out, r"(\p{P})(\P{N})", " $1 $2")
    return normalize_space(F.regexp_replace(out, r"(\p{S})", " $1 "))


#: Tokenizers by name; others (sentence pieces, Thai words) are registered by whoever has their models.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"none": normalize_space, "13a": tokenize_13a, "zh": tokenize_zh, "char": tokenize_char, "intl": tokenize_intl}

#: Names under which registered tokenizers are reported, where these differ.
REPORTED: dict[str, str] = {}


def register_tokenizer(name: str, apply: Callable[[Column], Column], reported: str | None = None) -> None:
    """Makes a tokenizer known: apply gives a text's tokens with spaces between."""
    TOKENIZERS[name] = apply
    if reported:
        REPORTED[name] = reported


#: Thai characters, those that never begin a word's part of their own (vowels and marks beside a consonant), and what stands alone between Thai: Latin words, numbers, line ends, others.
THAI, CLINGING = "\u0e00-\u0e7f", frozenset("\u0e30\u0e31\u0e32\u0e33\u0e34\u0e35\u0e36\u0e37\u0e38\u0e39\u0e3a\u0e45\u0e47\u0e48\u0e49\u0e4a\u0e4b\u0e4c\u0e4d\u0e4e")
_THAI_PARTS = re.compile(f"([{THAI}]+)|([A-Za-z-]+)|([0-9]+(?:[.,][0-9]+)*)|(\\s+)|([^{THAI}A-Za-z0-9\\s-]+)")


def _trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        if word:
            node[""] = True
    return root


def thai_path(text: str, root: dict) -> list[str]:
    """text as words of the trie: as few characters as can be lie outside of words, then as few pieces as can be are made, then the first is the longest. What lies outside stays together.

    Words end where the next character can begin one. The best way from each place to the end is worked out backwards.
    """
    n = len(text)
    cost: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # characters outside, pieces; from here to the end
    step, known = [0] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        outside, pieces = cost[i + 1]
        joins = i + 1 < n and not known[i + 1]
        best, step[i] = (outside + 1, pieces + (not joins)), 1
        node, j = root, i
        while j < n and (node := node.get(text[j])) is not None:
            j += 1
            if "" in node and (j == n or text[j] not in CLINGING):
                one = cost[j][0], cost[j][1] + 1
                if one <= best:
                    best, step[i], known[i] = one, j - i, True
        cost[i] = best
    out, i, open_ = [], 0, False
    while i < n:
        piece = text[i : i + step[i]]
        if known[i] or not open_:
            out.append(piece)
        else:
            out[-1] += piece
        open_ = not known[i]
        i += step[i]
    return out


def thai_words(words: Sequence[str]) -> Callable[[Column], Column]:
    """A tokenizer by a list of Thai words: Thai text by thai_path; Latin words, numbers and other marks apart, white space dropped.

    register_tokenizer("pythai_newmm", thai_words(words)) lets the automatic choice use it for Thai targets.
    """
    root = _trie(words)

    def apply(c: Column) -> Column:
        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            coded = texts.dictionary_encode()
            done = []
            for t in coded.dictionary.to_pylist():
                parts = [] if t is None else [p for m in _THAI_PARTS.finditer(t) if not m[4] for p in (thai_path(m[1], root) if m[1] else [m[0]])]
                done.append(None if t is None else " ".join(parts))
            return pa.array(done, pa.string()).take(coded.indices)

        return run(c)

    return apply


def sentence_pieces(model: str) -> Callable[[Column], Column]:
    """A tokenizer by a sentence-piece model, a file that every executor has at this path; each worker loads it once."""

    def apply(c: Column) -> Column:
        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            encode = _pieces_of(model)
            return pa.array([None if t is None else " ".join(encode(t)) for t in texts.to_pylist()], pa.string())

        return run(c)

    return apply


@cache
def _pieces_of(model: str) -> Callable[[str], list[str]]:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    return lambda text: processor.encode(text, out_type=str)


def available_tokenizer(name: Column, target: Column) -> Column:
    """The tokenizer to use and the name to report for one chosen by policy, by what is registered."""
    thai, chinese = target.startswith("tha_"), target.startswith("zho_") | target.startswith("cmn_")

    def pair(use: str, said: str) -> Column:
        return F.struct(F.lit(use).alias("use"), F.lit(said).alias("said"))

    said = name
    for known, shown in REPORTED.items():
        said = F.when(name == known, F.lit(shown)).otherwise(said)
    own = F.when(name.isin(*TOKENIZERS), F.struct(name.alias("use"), said.alias("said")))
    pieces = F.when(chinese, pair("zh", "zh_spbleu_fallback")).when(thai, pair("pythai_newmm", "pythai_newmm_spbleu_fallback") if "pythai_newmm" in TOKENIZERS else pair("intl", "intl_thai_fallback")).otherwise(pair("13a", "13a_spbleu_fallback"))
    return F.coalesce(own, F.when(name == "flores200", pieces), F.when(name == "pythai_newmm", pair("intl", "intl_thai_fallback")), pair("13a", "13a"))


def tokenized(c: Column, name: Column) -> Column:
    """Tokens of c by the tokenizer named in each row."""
    text = strip(F.coalesce(c, F.lit("")))
    out = None
    for known, apply in TOKENIZERS.items():
        out = F.when(name == known, apply(text)) if out is None else out.when(name == known, apply(text))
    return F.filter(F.split(out, " "), lambda t: t != "")


def segmented(rows: DataFrame, name: Column) -> DataFrame:
    """Hypotheses and references as their tokens, for inspection."""
    return rows.withColumns({
        "hypothesis_segmented": F.array_join(tokenized(F.col("hypothesis"), name), " "), "reference_segmented": F.array_join(tokenized(F.col("reference_text"), name), " "), "segmentation_tokenizer": name, "segmentation_error": F.lit(None).cast("string"),
    })


def _matches(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """Clipped matches of n-grams, n = 1..ORDER, of each pair of token lists (nulls count as empty): n x ORDER.

    Grams are numbered across the batch, the next order's from the last one's and a token; how often a row has each is
    counted by sorting, and the lesser counts of both sides are summed by row.
    """
    sides, lens = [], []
    for lists in (hyp, ref):
        lens.append(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
        sides.append(lists.flatten())
    coded = pa.chunked_array(sides).combine_chunks().dictionary_encode() if len(sides[0]) + len(sides[1]) else None
    out = np.zeros((len(hyp), ORDER), np.int64)
    if coded is None:
        return out
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(len(x)), x) for x in lens])
    from_ref = np.arange(len(token)) >= len(sides[0])
    after = np.concatenate([np.repeat(np.cumsum(x), x) - np.arange(x.sum()) for x in lens])  # tokens from here to the row's end
    gram, at = token, np.arange(len(token))
    for n in range(ORDER):
        if n:
            longer = after[at] > n
            at, gram = at[longer], gram[longer]
            gram = np.unique(gram * len(coded.dictionary) + token[at + n], return_inverse=True)[1].astype(np.int64)
        if not len(at):
            break
        key = row[at] * (int(gram.max()) + 1) + gram
        mine, count = np.unique(key[~from_ref[at]], return_counts=True)
        theirs, other = np.unique(key[from_ref[at]], return_counts=True)
        both, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        np.add.at(out[:, n], both // (int(gram.max()) + 1), np.minimum(count[i], other[j]))
    return out


def _matches_by_chunks(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """_matches over as many rows at a time as have CHUNK_TOKENS: counting takes many times the memory of what is counted."""
    ends = np.cumsum(sum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) for lists in (hyp, ref)))
    out, at = np.zeros((len(hyp), ORDER), np.int64), 0
    while at < len(hyp):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_TOKENS, "right")))
        out[at:to] = _matches(hyp.slice(at, to - at), ref.slice(at, to - at))
        at = to
    return out


def clipped_matches(hyp: Column, ref: Column) -> Column:
    """Matches of 1- to 4-grams, each counted as often as both token arrays have it: an array of four, worked out row by row."""

    @F.arrow_udf("array<bigint>")
    def run(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        found = _matches_by_chunks(hyps, refs)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * ORDER, pa.int32()), pa.array(found.ravel()))

    return run(hyp, ref)


def bleu_statistics(rows: DataFrame, keys: Sequence[str], id_col: str | None = None) -> DataFrame:
    """keys, num, hyp_len, ref_len, m1..m4 (clipped matches) and t1..t4 (n-grams of the hypotheses), from rows with hyp, ref token arrays.

    A row's matches are counted in place; only sums are exchanged, once.
    """
    bounded_batches(rows)
    size = {side: F.coalesce(F.size(F.coalesce(side, F.array().cast("array<string>"))), F.lit(0)) for side in ("hyp", "ref")}
    each = rows.select(*keys, size["hyp"].alias("_h"), size["ref"].alias("_r"), clipped_matches(F.col("hyp"), F.col("ref")).alias("_m"))
    sums = [F.sum(F.col("_m")[n - 1]).alias(f"m{n}") for n in range(1, ORDER + 1)] + [F.sum(F.greatest(F.col("_h") - (n - 1), F.lit(0))).alias(f"t{n}") for n in range(1, ORDER + 1)]
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("num"), F.sum("_h").alias("hyp_len"), F.sum("_r").alias("ref_len"), *sums)


def bleu_score() -> Column:
    """BLEU (0 to 100) from the columns of bleu_statistics: exponential smoothing of empty matches; orders without n-grams give 0."""
    logs, zeros = [], F.lit(0)
    for n in range(1, ORDER + 1):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        zeros = zeros + F.when((t > 0) & (m == 0), 1).otherwise(0)
        logs.append(F.when(m > 0, F.log(100.0 * m / t)).otherwise(F.log(100.0 / (F.pow(F.lit(2.0), zeros) * t))))
    total = logs[0]
    for one in logs[1:]:
        total = total + one
    brevity = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    nothing = (F.col("m1") + F.col("m2") + F.col("m3") + F.col("m4") == 0) | (F.col("t4") == 0) | (F.col("hyp_len") == 0)
    return F.when(nothing, 0.0).otherwise(brevity * F.exp(total / ORDER))


def corpus_bleu(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """keys, bleu, num from rows with hyp, ref token arrays."""
    return bleu_statistics(rows, keys, id_col).withColumn("bleu", bleu_score())


def evaluate(hypotheses: DataFrame, policy: str = "auto", score: str | None = None, id_col: str = "_ord") -> DataFrame:
    """A row per corpus and direction: BLEU by the policy's tokenizer, mean segment score (null without), count."""
    from ..functions import names

    corpus = F.coalesce(F.nullif(F.col("eval_corpus"), F.lit("")), F.col("dataset"), F.lit("?"))
    pair = F.coalesce(F.nullif(F.col("eval_pair"), F.lit("")), names.pair_of(F.col("src_lang"), F.col("tgt_lang")))
    rows = hypotheses.withColumn("corpus", corpus).withColumn("pair", pair)
    chosen = available_tokenizer(names.tokenizer_for(F.col("corpus"), F.col("pair"), F.lit(policy)), names.target_of(F.col("pair")))
    rows = rows.withColumn("_t", chosen)
    tokens = rows.select("corpus", "pair", id_col, F.col("_t.said").alias("said"), tokenized(F.col("hypothesis"), F.col("_t.use")).alias("hyp"), tokenized(F.col("reference_text"), F.col("_t.use")).alias("ref"))
    bleu = corpus_bleu(tokens, ["corpus", "pair", "said"], id_col).select("corpus", "pair", "bleu", F.col("said").alias("bleu_tokenizer"), "num")
    if not score:
        return bleu.withColumn("comet", F.lit(None).cast("double"))
    means = rows.groupBy("corpus", "pair").agg(F.avg(score).alias("comet"))
    return bleu.join(means, ["corpus", "pair"], "left")


def rollup_metrics(pairs: DataFrame, segments: DataFrame | None = None, score: str = "score") -> DataFrame:
    """level (pair, corpus, overall), corpus, pair, bleu, num, comet.

    Above a pair, BLEU is the mean of the pairs' by their counts (tokenizers differ), the segment score the mean over all segments.
    """
    grouped = pairs.rollup("corpus", "pair").agg(F.sum(F.col("bleu") * F.col("num")).alias("w"), F.sum("num").alias("num"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "pair").when(F.col("g") == 1, "corpus").otherwise("overall")
    out = grouped.select(level.alias("level"), "corpus", "pair", F.when(F.col("num") > 0, F.col("w") / F.col("num")).otherwise(0.0).alias("bleu"), "num")
    if segments is None:
        return out.withColumn("comet", F.lit(None).cast("double"))
    means = segments.rollup("corpus", "pair").agg(F.avg(score).alias("comet"), F.grouping_id().alias("g2")).withColumnsRenamed({"corpus": "c2", "pair": "p2"})
    level2 = F.when(F.col("g2") == 0, "pair").when(F.col("g2") == 1, "corpus").otherwise("overall")
    means = means.withColumn("level2", level2)
    return out.join(means, (F.col("level") == F.col("level2")) & F.col("corpus").eqNullSafe(F.col("c2")) & F.col("pair").eqNullSafe(F.col("p2")), "left").select("level", "corpus", "pair", "bleu", "num", "comet")


def metrics_document(rolled: DataFrame, policy: str) -> dict:
    """The nested metrics document; a row per direction, so small."""
    by: dict = {"by_corpus": {}, "overall": {}, "bleu_tokenize_policy": policy}
    for r in rolled.collect():
        value = {"bleu": r.bleu, "num": r.num, "comet": r.comet}
        if r.level == "overall":
            by["overall"] = {"bleu": r.bleu, "comet": r.comet}
        else:
            corpus = by["by_corpus"].setdefault(r.corpus, {"by_pair": {}, "overall": {}})
            if r.level == "corpus":
                corpus["overall"] = value
            else:
                corpus["by_pair"][r.pair] = value
    return by


def with_scores(bleu: DataFrame, scores: DataFrame) -> DataFrame:
    """Metrics rows with their segment score as text, empty where there is none."""
    joined = bleu.join(scores, ["corpus", "pair"], "left")
    return joined.withColumn("comet", F.coalesce(F.col("comet").cast("string"), F.lit("")))


def score_matrix(metrics: DataFrame, corpus: str, languages: Sequence[str], metric: str = "bleu") -> DataFrame:
    """src and a column per target language: the last value that is a number."""
    from ..functions import names

    value = F.col(metric).try_cast("double")
    rows = metrics.where((F.col("corpus") == corpus) & value.isNotNull()).select(names.source_of(F.col("pair")).alias("src"), names.target_of(F.col("pair")).alias("tgt"), value.alias("v"), "_ord")
    return rows.where(F.col("src").isin(*languages)).groupBy("src").pivot("tgt", list(languages)).agg(F.max_by("v", "_ord"))


def long_scores(metrics: DataFrame, corpus: str, metric: str = "bleu") -> DataFrame:
    """pair, value: the last number of each pair."""
    value = F.col(metric).try_cast("double")
    return metrics.where((F.col("corpus") == corpus) & value.isNotNull()).groupBy("pair").agg(F.max_by(value, "_ord").alias("value"))


def score_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair, a, b, delta where both runs have a value."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "pair").withColumn("delta", F.col("b") - F.col("a"))


def delta_scale(delta: DataFrame) -> DataFrame:
    """The greatest absolute difference; 1 for none or zero."""
    return delta.agg(F.coalesce(F.nullif(F.max(F.abs("delta")), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def global_scale(values: DataFrame) -> DataFrame:
    """Least and greatest value; 0 and 1 for none."""
    return values.agg(F.coalesce(F.min("value"), F.lit(0.0)).alias("vmin"), F.coalesce(F.max("value"), F.lit(1.0)).alias("vmax"))


def wanted_steps(candidates: DataFrame, steps: Sequence[int]) -> DataFrame:
    """Candidates of one of the training steps; a candidate without a step is none of them."""
    return candidates.where(F.col("step").isin(*steps)) if steps else candidates.limit(0)


def run_totals(results: DataFrame) -> DataFrame:
    """src_lang, tgt_lang, num, failed: rows and errors of each direction, and over all (null, null)."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in results.columns else F.lit(0).cast("long")
    counts = results.groupBy("src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("num"), failed.alias("failed"))
    total = counts.agg(F.lit(None).cast("string").alias("src_lang"), F.lit(None).cast("string").alias("tgt_lang"), F.sum("num").alias("num"), F.sum("failed").alias("failed"))
    return counts.union(total)


def best_checkpoint(candidates: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """The row of highest score, then highest step, then first in order, of each key."""
    row = F.struct(*[F.col(c) for c in candidates.columns if c not in keys])
    return candidates.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col("comet"), -F.col("step"), F.col("_ord"))).alias("r")).select(*keys, "r.*")


def selected_experts(experts: DataFrame, best: DataFrame, existing: DataFrame) -> DataFrame:
    """Experts with their best checkpoint and a status: missing_eval, checkpoint_missing or ok."""
    joined = experts.join(best.select("pair", F.col("step").alias("best_step"), F.col("comet").alias("best_comet"), F.col("path").alias("best_path")), "pair", "left")
    joined = joined.join(existing.select(F.col("path").alias("best_path"), F.lit(True).alias("there")), "best_path", "left")
    status = F.when(F.col("best_step").isNull(), "missing_eval").when(F.col("there").isNull(), "checkpoint_missing").otherwise("ok")
    return joined.select(*experts.columns, F.col("best_step").cast("string").alias("best_step"), F.format_string("%.6f", "best_comet").alias("best_comet"), F.col("best_path").alias("best_adapter_path"), status.alias("status"))


def single_pair(rows: DataFrame, pair: Column) -> DataFrame:
    """The one pair that all rows agree on; null if there are several or none."""
    found = rows.agg(F.min(pair).alias("a"), F.max(pair).alias("b"))
    return found.select(F.when(F.col("a") == F.col("b"), F.col("a")).alias("pair"))


def language_counts(rows: DataFrame, lang: Column) -> DataFrame:
    """language, n by descending count, then name; no language counts as (missing)."""
    name = F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("(missing)"))
    return rows.groupBy(name.alias("language")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")
