"""Bilingual lexicons: records, word-list and dictionary builds, English pivots, exports, ranked lookup with fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..storage import bounded_broadcast, written
from ..functions.text import casefold, has_any, normalize_key, normalize_lookup_key, normalize_space, to_simplified, traditional_characters, usable_pivot

#: A record holds no more candidates than this.
MOST_CANDIDATES = 8

FIELDS = ("source", "src_lang", "tgt_lang", "source_text", "target_text", "target_candidates", "confidence", "relation", "source_url", "license_note")


def distinct_by_key(rows: DataFrame, keys: Sequence[str], value: str, limit: int | None = None, order: str = "_ord") -> DataFrame:
    """keys, values: each group's filled values, the first surface form of each normalised key, by order, up to limit.

    First forms are found by aggregation per (group, key); only distinct values of a group meet.
    """
    clean = rows.select(*keys, normalize_space(F.col(value)).alias("_v"), F.col(order).alias("_o")).where("_v <> ''").withColumn("_k", normalize_key(F.col("_v")))
    first = clean.groupBy(*keys, "_k").agg(F.min(F.struct("_o", "_v")).alias("_f"))
    if limit is not None:  # no task is sent more than limit values of a group by any other, and no array is longer
        first = first.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_f"))).where(F.col("_place") <= limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_f._o", "_f._v"))), lambda x: x["_v"])
    return first.groupBy(*keys).agg(listed.alias("values"))


def records(groups: DataFrame, source: str, src_lang: str, tgt_lang: str, confidence: float, url: str = "", license_note: str = "", pivot: str | None = None) -> DataFrame:
    """Lexicon entries from source_text and values (distinct, in order); at most eight candidates, the first is the target. Rows without one go."""
    best = F.slice("values", 1, MOST_CANDIDATES)
    out = groups.where(F.size("values") > 0).select(
        F.lit(source).alias("source"), F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"), normalize_space(F.col("source_text")).alias("source_text"), best[0].alias("target_text"), best.alias("target_candidates"),
        F.lit(float(confidence)).alias("confidence"), F.lit("translation").alias("relation"), F.lit(url).alias("source_url"), F.lit(license_note).alias("license_note"),
        (normalize_space(F.col(pivot)) if pivot else F.lit(None).cast("string")).alias("pivot_text"), *[c for c in ("_ord",) if c in groups.columns],
    )
    return out


def word_list_lexicon(pairs: DataFrame, src_lang: str, tgt_lang: str, max_candidates: int = 8, url: str = "", license_note: str = "", traditional: str | None = None) -> DataFrame:
    """Entries from src, tgt word pairs: grouped by case-folded source (its first surface form), in order of first appearance.

    Chinese terms that keep one of the traditional characters (default: those that Unicode's rules change) go.
    """
    src, tgt = F.col("src"), F.col("tgt")
    src, tgt = (to_simplified(src) if src_lang == "zho_Hans" else src), (to_simplified(tgt) if tgt_lang == "zho_Hans" else tgt)
    rows = pairs.select(src.alias("src"), tgt.alias("tgt"), "_ord")
    for col, lang in (("src", src_lang), ("tgt", tgt_lang)):
        if lang == "zho_Hans":
            rows = rows.where(~has_any(F.col(col), traditional_characters(pairs.sparkSession) if traditional is None else traditional))
    rows = rows.withColumn("key", casefold(F.col("src")))
    values = distinct_by_key(rows, ["key"], "tgt", max_candidates)
    surface = rows.groupBy("key").agg(F.min_by("src", "_ord").alias("source_text"), F.min("_ord").alias("_ord"))
    return records(values.join(surface, "key"), "muse", src_lang, tgt_lang, 0.82, url, license_note)


def dictionary_forward(entries: DataFrame, url: str = "", license_note: str = "") -> DataFrame:
    """Chinese-English entries from simplified, defs: the first of equal keys."""
    keyed = entries.withColumn("key", normalize_key(F.col("simplified")))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("simplified", "defs"), "_ord").alias("r"), F.min("_ord").alias("_ord"))
    flat = first.select("key", F.col("r.simplified").alias("source_text"), "_ord", F.posexplode("r.defs").alias("pos", "value")).withColumn("at", F.struct("_ord", "pos"))
    values = distinct_by_key(flat, ["key"], "value", MOST_CANDIDATES, "at")
    return records(values.join(first.select("key", F.col("r.simplified").alias("source_text"), "_ord"), "key"), "cc_cedict", "zho_Hans", "eng_Latn", 0.9, url, license_note)


def dictionary_backward(entries: DataFrame, url: str = "", license_note: str = "") -> DataFrame:
    """English-Chinese entries: definitions grouped by key, with the terms they define in order."""
    flat = entries.select("simplified", "_ord", F.posexplode("defs").alias("pos", "def")).withColumn("at", F.struct("_ord", "pos")).withColumn("key", normalize_key(F.col("def")))
    surface = flat.groupBy("key").agg(F.min_by("def", "at").alias("source_text"), F.min("at").alias("_ord"))
    values = distinct_by_key(flat, ["key"], "simplified", MOST_CANDIDATES, "at")
    return records(values.join(surface, "key"), "cc_cedict", "eng_Latn", "zho_Hans", 0.88, url, license_note)


def _candidates(lexicon: DataFrame) -> Column:
    return F.when(F.size("target_candidates") > 0, F.col("target_candidates")).otherwise(F.array(F.coalesce("target_text", F.lit(""))))


def pivot_lexicon(first: DataFrame, second: DataFrame, src_lang: str, tgt_lang: str, max_candidates: int = 8, license_note: str = "") -> DataFrame:
    """Two-hop entries: first's targets (the pivot language) meet second's sources by normalised key.

    Stop-words and short keys don't pivot; candidates keep the order of pivots, then of second's entries; the first entry
    of a source key that gets any candidate stays; pivot_text is its last pivot that matched.

    Both sides are reduced before they meet: second to the first max_candidates distinct values of each pivot (as many as any
    entry can take from it), first to the entry of each source key that wins. So no pair of a common pivot's entries is formed.
    """
    left = first.select(normalize_space(F.col("source_text")).alias("source_text"), "_ord", _candidates(first).alias("c")).where("source_text <> ''").withColumn("key", normalize_key(F.col("source_text")))
    hops = left.select("key", "source_text", "_ord", F.posexplode("c").alias("pos", "pivot")).withColumn("k", normalize_key(F.col("pivot"))).where(usable_pivot(F.col("k")))
    # as scalars, so that the least can be kept in a hash table's row
    entries = second.select(normalize_key(F.col("source_text")).alias("k"), F.col("_ord").alias("o2"), F.posexplode(_candidates(second)).alias("p2", "value"))
    filled = entries.withColumn("value", normalize_space(F.col("value"))).where(usable_pivot(F.col("k")) & (F.col("value") != "")).withColumn("vk", normalize_key(F.col("value")))
    forms = filled.groupBy("k", "vk").agg(F.min(F.struct("o2", "p2", "value")).alias("f"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("f.o2", "f.p2", "f.value"))
    index = written(forms.withColumn("place", place).where(F.col("place") <= max_candidates).select("k", "vk", "f"), "pivot-index")
    pivots = index.select("k").distinct()
    usable = written(hops.join(pivots, "k", "left_semi"), "pivot-hops")
    wins = written(usable.groupBy("key").agg(F.min("_ord").alias("_ord")), "pivot-winners")
    own = usable.join(wins, ["key", "_ord"])
    about = own.groupBy("key", "_ord").agg(F.first("source_text").alias("source_text"), F.max_by("pivot", "pos").alias("pivot"))
    met = own.select("key", "k", "pos").join(index, "k").groupBy("key", "vk").agg(F.min(F.struct("pos", "f")).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list("at")), lambda x: x["f"]["value"])
    values = met.groupBy("key").agg(F.slice(listed, 1, max_candidates).alias("values"))
    kept = values.join(about, "key")
    url = f"pivot:dict_terms_{src_lang}__eng_Latn + dict_terms_eng_Latn__{tgt_lang}" if src_lang != "zho_Hans" else f"pivot:dict_terms_zho_Hans__eng_Latn + dict_terms_eng_Latn__{tgt_lang}"
    return records(kept, "english_pivot_dictionary", src_lang, tgt_lang, 0.62, url, license_note, "pivot")


def term_pairs(lexicon: DataFrame, hints: int = 0, include_meta: bool = False) -> DataFrame:
    """Alpaca rows of a lexicon; with hints, the first candidates stand beside the term; with include_meta, where it came from."""
    text = normalize_space(F.col("source_text"))
    if hints > 0:
        text = F.concat(text, F.lit("\nCandidates: "), F.array_join(F.slice("target_candidates", 1, hints), "; "))
    meta = [F.struct("src_lang", "tgt_lang", "source", "confidence", F.col("target_candidates").alias("all_targets"), "pivot_text").alias("meta")] if include_meta else []
    good = lexicon.where((normalize_space(F.col("source_text")) != "") & (normalize_space(F.col("target_text")) != ""))
    order = [c for c in ("_ord",) if c in lexicon.columns]
    return good.select(names.term_instruction(F.col("src_lang"), F.col("tgt_lang")).alias("instruction"), text.alias("input"), normalize_space(F.col("target_text")).alias("output"), *meta, *order)


def loaded(rows: DataFrame) -> DataFrame:
    """Loose rows as typed entries: blanks for texts, 0.0 for confidence, the target as only candidate; rows without languages or source go. Adds the lookup key once."""
    text = {c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in FIELDS if c not in ("target_candidates", "confidence")}
    have = rows.withColumns({c: e for c, e in text.items() if c in rows.columns}).withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
    have = have.withColumn("target_candidates", F.when(F.size("target_candidates") > 0, F.col("target_candidates")).otherwise(F.array("target_text")))
    return have.where("src_lang <> '' and tgt_lang <> '' and source_text <> ''").withColumn("norm_key", normalize_lookup_key(F.col("source_text")))


def inventory(index: DataFrame) -> DataFrame:
    return index.groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("size")).orderBy("src_lang", "tgt_lang")


def _matches(index: DataFrame, key: str) -> Column:
    """Either key holds the other; the empty key is held by all."""
    return F.col("norm_key").contains(key) | F.lit(key).contains(F.col("norm_key"))


def lookup(index: DataFrame, src_lang: str, tgt_lang: str, key: str, top_k: int = 20, offset: int = 0) -> DataFrame:
    """One page of a direction's matches: exact first, then by confidence, shortness, target and load order, with the total and whether more follow."""
    if top_k < 1 or offset < 0:
        raise ValueError("top_k must be 1 or more, offset 0 or more")
    found = index.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang)).where(_matches(index, key))
    ranked = found.orderBy((F.col("norm_key") != key).asc(), F.desc("confidence"), F.length("source_text"), "target_text", "_ord").offset(offset).limit(top_k)
    total = F.broadcast(found.agg(F.count(F.lit(1)).alias("total_matches")))  # one row
    return ranked.crossJoin(total).withColumns({"has_more": F.lit(offset + top_k) < F.col("total_matches"), "match_type": F.lit("contains")})


def search(index: DataFrame, key: str, src_lang: str | None = None, tgt_lang: str | None = None, top_k: int = 10) -> DataFrame:
    """The best matches over all directions: exact first, then by confidence, languages and source."""
    found = index.where(_matches(index, key))
    for name, value in (("src_lang", src_lang), ("tgt_lang", tgt_lang)):
        if value:
            found = found.where(F.col(name) == value)
    marked = found.withColumn("match_type", F.when(F.col("norm_key") == key, "exact").otherwise("contains"))
    return marked.orderBy((F.col("match_type") != "exact").asc(), F.desc("confidence"), "src_lang", "tgt_lang", "source_text", "_ord").limit(top_k)


def _parts(rows: DataFrame, key: str, sizes: Column) -> DataFrame:
    """rows with each distinct piece of the key of each of the sizes, as gram."""
    cuts = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(0)), F.lit(1)), lambda i: F.substring(F.col(key), i, n))))
    none = F.expr("cast(array() as array<string>)")
    return rows.select("*", F.explode(F.array_distinct(F.when(F.length(key) >= F.array_min(sizes), cuts).otherwise(none))).alias("gram"))


def _pieces(large: DataFrame) -> DataFrame:
    """gram, l, lk: each piece of up to GRAM characters of the keys lk."""
    return written(_parts(large, "lk", F.filter(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: n <= F.length("lk"))).select("gram", "l", "lk"), "pieces")


def _held_by(small: DataFrame, have: DataFrame) -> DataFrame:
    """s, l: ids of small (s, sk) and of the keys with those pieces that hold sk, for keys that aren't empty.

    A key is held only where its rarest piece of GRAM characters (the whole key, if shorter) is; that piece is the join's key.
    """
    often = have.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = _parts(small.where("sk <> ''"), "sk", F.array(F.least(F.length("sk"), F.lit(GRAM))))
    least = own.join(often, "gram", "left").groupBy("s", "sk").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return written(least, "anchors").join(have, "gram").where(F.col("lk").contains(F.col("sk"))).select("s", "l")


#: Characters of the pieces by which containment is looked up.
GRAM = 3


def lookup_terms(index: DataFrame, terms: DataFrame, top_k: int = 10) -> DataFrame:
    """The best top_k entries of the whole index for each row of terms (term_id, key): either key holds the other, ranked as in search, with rank and match_type.

    Entries are numbered in order of rank first. Of entries with one key only top_k can be among a term's best, so no more are
    looked at; and a term of up to GRAM characters takes the first top_k that have it, so that one letter doesn't meet the
    whole index. Longer terms, and keys that terms hold, meet by a join on rare pieces, never all against all. An empty term
    takes the first top_k of all, and of empty entries, which every term holds, the first top_k stand for the rest.
    """
    from .sampling import numbered

    by = F.struct((-F.col("confidence")).alias("c"), F.col("src_lang").alias("s"), F.col("tgt_lang").alias("t"), F.col("source_text").alias("x"), F.col("_ord").alias("o"))
    entries = written(numbered(index.withColumn("_by", by), [], "_by").drop("_by").withColumnRenamed("_n", "e"), "entries")
    asked = written(terms.select(F.col("term_id").alias("t"), F.col("key").alias("tk")), "terms")
    same = F.row_number().over(Window.partitionBy("ek").orderBy("e"))
    slim = written(entries.select("e", F.col("norm_key").alias("ek")).withColumn("p", same).where(F.col("p") <= top_k).drop("p"), "first-of-keys")
    have = _pieces(slim.select(F.col("e").alias("l"), F.col("ek").alias("lk")))
    short = asked.where(F.length("tk").between(1, GRAM))
    heads = have.join(bounded_broadcast(short.select(F.col("tk").alias("gram")).distinct()), "gram", "left_semi")
    heads = heads.withColumn("p", F.row_number().over(Window.partitionBy("gram").orderBy("l"))).where(F.col("p") <= top_k)
    near = heads.join(short, F.col("gram") == F.col("tk")).select("t", F.col("l").alias("e"))
    inner = _held_by(asked.where(F.length("tk") > GRAM).select(F.col("t").alias("s"), F.col("tk").alias("sk")), have).select(F.col("s").alias("t"), F.col("l").alias("e"))
    outer = _held_by(slim.select(F.col("e").alias("s"), F.col("ek").alias("sk")), _pieces(asked.select(F.col("t").alias("l"), F.col("tk").alias("lk")))).select(F.col("l").alias("t"), F.col("s").alias("e"))
    few = slim.orderBy("e").limit(top_k).select("e", F.lit(True).alias("of_blank")).union(slim.where("ek = ''").select("e", F.lit(False)))  # top_k rows each at most
    blank = asked.join(F.broadcast(few), ~F.col("of_blank") | (F.col("tk") == "")).select("t", "e")
    met = near.union(inner).union(outer).union(blank).distinct()
    whole = met.join(asked, "t").join(entries, "e").withColumn("match_type", F.when(F.col("norm_key") == F.col("tk"), "exact").otherwise("contains"))
    rank = F.row_number().over(Window.partitionBy("t").orderBy((F.col("match_type") != "exact").asc(), "e"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= top_k).select(F.col("t").alias("term_id"), "rank", "match_type", *[c for c in index.columns if c != "norm_key"])


def lookup_with_fallback(index: DataFrame, src_lang: str, tgt_lang: str, term: str, top_k: int = 20, offset: int = 0, fallback_top_k: int = 10) -> dict:
    """The lookup's page as plain data; without a match, suggestions from the same source's other targets, else from other sources.

    Limits of three and six times the suggestions hold before those that don't qualify are taken out. An unknown direction is an error.
    """
    from ..functions.text import lookup_key

    if index.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang)).isEmpty():
        raise ValueError(f"no such direction: {src_lang}->{tgt_lang}")
    key = lookup_key(term)
    drop = ("norm_key", "_ord", "total_matches", "has_more")
    page = lookup(index, src_lang, tgt_lang, key, top_k, offset).collect()
    total = page[0]["total_matches"] if page else index.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang)).where(_matches(index, key)).count()
    out = {"query": term, "src_lang": src_lang, "tgt_lang": tgt_lang, "match_type": "contains", "total_matches": total, "offset": offset, "top_k": top_k, "has_more": offset + top_k < total, "results": [{k: v for k, v in r.asDict().items() if k not in (*drop, "match_type")} for r in page]}
    if total:
        return out | {"fallback_used": False}
    same = [r.asDict() for r in search(index, key, src_lang, None, max(fallback_top_k * 3, fallback_top_k)).collect()]
    same = [r for r in same if (r["src_lang"], r["tgt_lang"]) != (src_lang, tgt_lang)][:fallback_top_k]
    scope, found = "same_src_other_targets", same
    if not same:
        scope = "other_sources"
        found = [r.asDict() for r in search(index, key, None, None, max(fallback_top_k * 6, fallback_top_k)).collect()]
        found = [r for r in found if r["src_lang"] != src_lang][:fallback_top_k]
    clean = [{k: v for k, v in r.items() if k not in drop} for r in found]
    return out | {"fallback_used": bool(found), "fallback_scope": scope, "fallback_results": clean}


def tool_schema(pairs_hint: str | None = None) -> list[dict]:
    """The lookup as a function-calling tool."""
    about = "Look up a term in one direction. Matches hold the term or are held by it, come ranked and paged, and fall back to other directions if there are none."
    fields = {"src_lang": "string", "tgt_lang": "string", "term": "string", "top_k": "integer", "offset": "integer", "fallback_top_k": "integer"}
    return [{"type": "function", "function": {"name": "lookup_dictionary", "description": about + (f" Directions: {pairs_hint}" if pairs_hint else ""), "parameters": {"type": "object", "properties": {k: {"type": t} for k, t in fields.items()}, "required": ["src_lang", "tgt_lang", "term"]}}}]


def dispatcher(index: DataFrame) -> dict:
    """Tool names and what they call."""
    return {
        "lookup_dictionary": lambda **a: lookup_with_fallback(index, str(a["src_lang"]), str(a["tgt_lang"]), str(a["term"]), int(a.get("top_k", 20)), int(a.get("offset", 0)), int(a.get("fallback_top_k", 10))),
        "list_dictionary_pairs": lambda **a: [r.asDict() for r in inventory(index).collect()],
    }
