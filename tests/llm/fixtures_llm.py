"""Small tables with the awkward cases: nulls, empties, ties, repeats, long texts, clashing names."""

import random


def words(rng, n, size=400):
    return [f"{chr(97 + rng.randrange(26))}{rng.randrange(size)}" for _ in range(n)]


def documents(seed=1):
    rng = random.Random(seed)
    base = [" ".join(words(rng, n)) for n in (0, 1, 3, 12, 34, 35, 36, 60, 90, 200, 500)]
    passage = " ".join(words(rng, 50))
    texts = [*base, None, "", "   ", base[8], base[8], base[8]]
    texts += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 25))}" for _ in range(6)]
    texts.append(f"{passage} {' '.join(words(rng, 5))} {passage}")
    long = words(rng, 20000)
    texts.append(" ".join(long))
    changed = list(long)
    changed[9000] = "edited"
    texts.append(" ".join(changed))
    texts += ["same " * 80, "same " * 80, "same " * 79 + "other"]
    near = words(rng, 300)
    for k in range(5):
        one = list(near)
        one[k * 50] = f"changed{k}"
        texts.append("\n".join([" ".join(one[:150]), " ".join(one[150:])]))
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "null id " + passage, "en", "s1", 5), (None, "null id " + passage, "en", "s1", 5)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = (
    "key", "h", "size", "hash", "words", "_row", "score", "rank", "source_size", "doc", "bands", "bucket", "slot", "shard", "law", "place", "_number", "_id", "_doc", "_key", "_own", "_body", "_o0", "_k1", "n_hit", "spans", "crc", "hits",
    "copies", "_copies", "draw", "weight", "target", "class_key", "text_md5", "a.b", "x`y", "id", "path", "own", "share", "predicted", "held_out",
)


def table(spark, seed=1, extra=False):
    df = spark.createDataFrame(documents(seed), SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
