"""A stored lexicon index: what a lookup reads instead of the whole lexicon.

Entries are numbered once in order of rank, within their direction and over all. Postings hold each piece of up to GRAM characters
of a key (the empty piece too) with the entries that have it, in files by a hash bucket of the piece and by level: the ranks
below FIRST_LEVEL, then up to twice that, and so on. A lookup reads the bucket of one piece, the longest or rarest of its
term, level by level until its page is full, so that a term of one letter reads a few ranks of it and never all. Entries that
the term holds are found by the term's own pieces among the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bounded_broadcast, written
from .sampling import numbered

GRAM, FIRST_LEVEL = 3, 1024
#: Entries for which there is a bucket of files, and the most buckets.
BUCKET_ENTRIES, MOST_BUCKETS = 50_000, 4096
#: Entries kept for each piece in order of rank, for tables of terms; a lookup of more goes to the postings.
HEAD = 64


def bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _level(rank: Column) -> Column:
    """0 for ranks below FIRST_LEVEL, then one more each time they double."""
    return F.when(rank < FIRST_LEVEL, 0).otherwise(F.length(F.bin(rank)) - (FIRST_LEVEL.bit_length() - 1)).cast("int")


def _of_length(key: Column, n: int) -> Column:
    """The pieces of n characters of a key."""
    places = F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1)))
    return F.filter(F.transform(places, lambda i: F.substring(key, i, n)), lambda p: F.length(p) == n)


def pieces(key: Column, most: int = GRAM) -> Column:
    """The distinct pieces of 0 to most characters of a key."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_of_length(key, n) for n in range(1, most + 1)]))


def store(index: DataFrame, path: str, buckets: int | None = None) -> StoredLexicon:
    """Writes the index of typed entries (lexicon.loaded, or src_lang, tgt_lang, source_text, confidence, norm_key, _ord and others) below path, a folder that all executors share.

    buckets: of files; by default as many as the entries call for.
    """
    spark, entries = index.sparkSession, index.count()
    buckets = buckets or min(MOST_BUCKETS, 1 + entries // BUCKET_ENTRIES)
    spark.createDataFrame([(buckets, entries)], "buckets int, entries long").coalesce(1).write.parquet(f"{path}/about")
    text = F.col("target_text") if "target_text" in index.columns else F.lit("")
    order = F.struct((-F.col("confidence")).alias("c"), F.length("source_text").alias("l"), text.alias("t"), F.col("_ord").alias("o"))
    over_all = F.struct((-F.col("confidence")).alias("c"), F.col("src_lang").alias("s"), F.col("tgt_lang").alias("t"), F.col("source_text").alias("x"), F.col("_ord").alias("o"))
    ranked = numbered(index.withColumn("_by", order), ["src_lang", "tgt_lang"], "_by").withColumnRenamed("_n", "r").drop("_by")
    ranked = numbered(ranked.withColumn("_by", over_all), [], "_by").withColumnRenamed("_n", "g").drop("_by")
    ranked.withColumn("part", F.pmod("g", F.lit(buckets)).cast("int")).repartition("part").sortWithinPartitions("part", "g").write.partitionBy("part").parquet(f"{path}/entries")
    slim = spark.read.parquet(f"{path}/entries").select("src_lang", "tgt_lang", "r", "g", "norm_key")
    slim.withColumn("b", bucket(F.col("norm_key"), buckets)).repartition("b").sortWithinPartitions("b", "norm_key", "g").write.partitionBy("b").parquet(f"{path}/keys")
    cut = written(slim.withColumn("piece", F.explode(pieces(F.col("norm_key")))).withColumn("b", bucket(F.col("piece"), buckets)), "lexicon-pieces")
    for name, rank in (("direction", "r"), ("all", "g")):
        # a hot piece's postings are dealt by level and salt, not by the piece alone
        laid = cut.withColumn("level", _level(F.col(rank)))
        laid.repartition("b", "level", F.pmod(F.xxhash64("g"), F.lit(4))).sortWithinPartitions("b", "level", "piece", rank).write.partitionBy("b", "level").parquet(f"{path}/by-{name}")
    cut.groupBy("b", "piece", "src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("n")).repartition("b").sortWithinPartitions("b", "piece").write.partitionBy("b").parquet(f"{path}/counts")
    place = F.row_number().over(Window.partitionBy("b", "piece").orderBy("g"))  # cut before the exchange: no more than HEAD rows a piece and task are sent
    cut.withColumn("place", place).where(F.col("place") <= HEAD).repartition("b").sortWithinPartitions("b", "piece", "place").write.partitionBy("b").parquet(f"{path}/heads")
    return StoredLexicon(spark, path, buckets, entries)


def open_stored(spark: SparkSession, path: str) -> StoredLexicon:
    """An index that store() has written before."""
    return StoredLexicon(spark, path, *spark.read.parquet(f"{path}/about").first())


@dataclass(frozen=True)
class StoredLexicon:
    """An index that store() has written."""

    spark: SparkSession
    path: str
    buckets: int
    size: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _buckets(self, texts: Sequence[str]) -> dict[str, int]:
        """Buckets of a term's pieces: Spark's xxhash64 of a string is XXH64 of its bytes with seed 42, as a signed number."""
        return {t: _signed(xxhash.xxh64_intdigest(t.encode(), 42)) % self.buckets for t in texts}

    def held(self, key: str, direction: tuple[str, str] | None = None) -> DataFrame:
        """src_lang, tgt_lang, r, g, norm_key of the entries that the key holds, itself included."""
        own = sorted({key[i:j] for i in range(len(key) + 1) for j in range(i, len(key) + 1)})
        at = self._buckets(own)
        return self._of(self.table("keys").where(F.col("b").isin(sorted(set(at.values()))) & F.col("norm_key").isin(own)), direction).drop("b")

    @staticmethod
    def _of(rows: DataFrame, direction: tuple[str | None, str | None] | None) -> DataFrame:
        for name, value in zip(("src_lang", "tgt_lang"), direction or (None, None), strict=True):
            if value:
                rows = rows.where(F.col(name) == value)
        return rows

    def anchor(self, key: str) -> tuple[str, int, int]:
        """The piece by which a key's holders are found, its bucket, and how many entries have it: the key, if it is short, else its rarest piece."""
        own = [key] if len(key) <= GRAM else sorted({key[i : i + GRAM] for i in range(len(key) - GRAM + 1)})
        at = self._buckets(own)
        n = self.table("counts").where(F.col("b").isin(sorted(set(at.values()))) & F.col("piece").isin(own)).groupBy("piece").agg(F.sum("n").alias("n"))
        found = {r.piece: r.n for r in n.collect()}
        piece = min(own, key=lambda p: (found.get(p, 0), p))
        return piece, at[piece], found.get(piece, 0)

    def holders(self, key: str, ranks: str = "direction", direction: tuple[str | None, str | None] | None = None, levels: Sequence[int] | None = None, anchor: tuple[str, int, int] | None = None) -> DataFrame:
        """The entries whose longer key holds the key, of some levels or all."""
        piece, at, _ = anchor or self.anchor(key)
        rows = self.table(f"by-{ranks}").where((F.col("b") == at) & (F.col("piece") == piece))
        if levels is not None:
            rows = rows.where(F.col("level").isin(list(levels)))
        rows = self._of(rows, direction).where(F.length("norm_key") > len(key))
        return rows.where(F.col("norm_key").contains(key)) if len(key) > GRAM else rows

    def count(self, key: str, direction: tuple[str | None, str | None] | None = None, anchor: tuple[str, int, int] | None = None) -> int:
        """How many entries match: for short keys from the counts, without a look at postings."""
        own = self.held(key, direction)
        inside, exact = own.agg(F.count(F.lit(1)), F.count_if(F.col("norm_key") == key)).first()
        if len(key) <= GRAM:
            at = self._buckets([key])[key]
            n = self._of(self.table("counts").where((F.col("b") == at) & (F.col("piece") == key)), direction).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            return inside + n - exact
        return inside + self.holders(key, direction=direction, anchor=anchor).count()

    def first(self, key: str, n: int, ranks: str, direction: tuple[str | None, str | None] | None = None, anchor: tuple[str, int, int] | None = None) -> list[int]:
        """Numbers (g) of the first n matches: exact ones, then by rank (r within a direction, g over all).

        Where many entries have the key's piece, levels are read one by one until there are enough; else all at once.
        """
        rank = "r" if ranks == "direction" else "g"
        anchor = anchor or self.anchor(key)
        top = max(self.size.bit_length() - FIRST_LEVEL.bit_length() + 1, 0)
        columns = ["g", "norm_key"] if rank == "g" else ["r", "g", "norm_key"]
        have, last = self.held(key, direction).select(*columns), -1 if anchor[2] > 2 * FIRST_LEVEL else top
        if last == top and anchor[2]:
            have = have.unionByName(self.holders(key, ranks, direction, None, anchor).select(*columns))
        found = 0
        while found < n and last < top:
            last += 1
            some = self.holders(key, ranks, direction, [last], anchor).select(*columns).orderBy(rank).limit(n)
            some = written(some, "postings", F.count(F.lit(1)).alias("n"))
            found += some.measured["n"]
            have = have.unionByName(some)
        return [r.g for r in have.orderBy((F.col("norm_key") != key).asc(), rank).limit(n).collect()]  # a page

    def _entries(self, page: Sequence[int]) -> DataFrame:
        """The whole entries of a page of numbers."""
        return self.table("entries").where(F.col("part").isin(sorted({g % self.buckets for g in page})) & F.col("g").isin(list(page))).drop("part")

    def lookup(self, src_lang: str, tgt_lang: str, key: str, top_k: int = 20, offset: int = 0) -> DataFrame:
        """As lexicon.lookup: one page of a direction's matches with total_matches, has_more and match_type."""
        if top_k < 1 or offset < 0:
            raise ValueError("top_k must be 1 or more, offset 0 or more")
        direction = src_lang, tgt_lang
        anchor = self.anchor(key)
        total = self.count(key, direction, anchor)
        page = self.first(key, offset + top_k, "direction", direction, anchor)[offset:]
        found = self._entries(page).orderBy((F.col("norm_key") != key).asc(), "r").drop("r", "g")
        return found.withColumns({"total_matches": F.lit(total).cast("long"), "has_more": F.lit(offset + top_k < total), "match_type": F.lit("contains")})

    def search(self, key: str, src_lang: str | None = None, tgt_lang: str | None = None, top_k: int = 10) -> DataFrame:
        """As lexicon.search: the best matches over all directions, or those of a language."""
        page = self.first(key, top_k, "all", (src_lang, tgt_lang))
        mark = F.when(F.col("norm_key") == key, "exact").otherwise("contains")
        return self._entries(page).withColumn("match_type", mark).orderBy((F.col("norm_key") != key).asc(), "g").drop("r", "g")

    def lookup_terms(self, terms: DataFrame, top_k: int = 10) -> DataFrame:
        """As lexicon.lookup_terms, for a table of terms (term_id, key).

        Terms of up to GRAM characters read the heads of their pieces, top_k rows at most each; longer ones the postings of
        their rarest piece; what a term holds is found by its pieces of any length among the keys.
        """
        if top_k > HEAD:
            raise ValueError(f"top_k is {HEAD} at most")
        asked = written(terms.select(F.col("term_id").alias("t"), F.col("key").alias("tk")), "terms")
        short, long = asked.where(F.length("tk") <= GRAM), asked.where(F.length("tk") > GRAM)
        heads = self.table("heads").where(F.col("place") <= top_k)
        near = bounded_broadcast(short.select("t", "tk", bucket(F.col("tk"), self.buckets).alias("b")))
        from_heads = heads.join(near, (F.col("piece") == F.col("tk")) & (heads["b"] == near["b"])).select("t", "tk", "g", "norm_key")
        own = long.withColumn("piece", F.explode(F.array_distinct(_of_length(F.col("tk"), GRAM)))).withColumn("b", bucket(F.col("piece"), self.buckets))
        often = self.table("counts").groupBy("b", "piece").agg(F.sum("n").alias("n"))
        rarest = own.join(often, ["b", "piece"], "left").groupBy("t", "tk").agg(F.min_by(F.struct("b", "piece"), F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("a"))
        anchors = bounded_broadcast(written(rarest.select("t", "tk", F.col("a.b").alias("b"), F.col("a.piece").alias("piece")), "anchors"))
        from_postings = self.table("by-all").join(anchors, ["b", "piece"]).where(F.col("norm_key").contains(F.col("tk"))).select("t", "tk", "g", "norm_key")
        parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("tk")), lambda i: F.transform(F.sequence(F.lit(1), F.length("tk") - i + 1), lambda n: F.substring(F.col("tk"), i, n))))
        parts = F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.length("tk") > 0, parts).otherwise(F.array().cast("array<string>"))))
        inside = asked.withColumn("norm_key", F.explode(parts)).withColumn("b", bucket(F.col("norm_key"), self.buckets))
        from_keys = self.table("keys").join(inside, ["b", "norm_key"]).select("t", "tk", "g", "norm_key")
        met = from_heads.union(from_postings).union(from_keys).distinct()
        rank = F.row_number().over(Window.partitionBy("t").orderBy((F.col("norm_key") != F.col("tk")).asc(), "g"))
        best = met.withColumn("rank", rank).where(F.col("rank") <= top_k)
        best = bounded_broadcast(written(best.select("t", "tk", "g", "rank"), "ranked-terms"))
        found = self.table("entries").join(best, "g").withColumn("match_type", F.when(F.col("norm_key") == F.col("tk"), "exact").otherwise("contains"))
        return found.select(F.col("t").alias("term_id"), "rank", "match_type", *[c for c in found.columns if c not in ("t", "tk", "rank", "match_type", "g", "r", "part", "norm_key")])
