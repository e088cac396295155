"""Encoding and decoding held against the tokenizers library, and its parts against plain Python."""

import random

import fixtures_llm as fx
import numpy as np
import pytest

from weftline.llm import bpe as B
from weftline.llm import registry as R

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
ODD = [
    "", "a", " hello  world\n\n  it's we'll 's 'street don't''s \"'s x 're\t'd 12a  ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>\n", "a" * 750, "日本語テキスト" * 30, "é x  y ", "\x1c\x1d \x85a", " ", "  ", "\n 's", "a 's", "'S 'T x'LL",
    "''s", "'", "s'", "<|endoftext|", "   z", "𝔘𝔫𝔦 😀😀 👨‍👩‍👧 �\u0000\u0001", "x" * 5000 + " y", "\n\n\n", "a\r\n\tb", "'re're're", " 're", "1's", "　日", "٣٤ ½ ⅷ", "՘Ᲊ",
]


@pytest.fixture(scope="module")
def tables():
    return B.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABC 0123'\".,\n\té日  "
    out = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(1500)]
    out += ["".join(rng.choice("ab") for _ in range(rng.randrange(300))) for _ in range(200)]
    return out + ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x1F000, 0x1FAFF)])) for _ in range(50)) for _ in range(300)]


def test_ids_and_texts_of_the_library(tables, library):
    all_ = texts()
    want = library.encode_batch(all_, add_special_tokens=False)
    ids, offs = B.encode_batch(all_, B.Words(tables))
    for i, text in enumerate(all_):
        assert ids[offs[i] : offs[i + 1]].tolist() == want[i].ids, text
    assert B.decode_batch(ids, offs, tables) == library.decode_batch([w.ids for w in want], skip_special_tokens=False)


def test_classes_of_all_characters(tables):
    """Letter, number, space or other, as the library cuts."""
    cut = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 20000):
        some = every[i : i + 20000]
        line = "\n".join(f"a{c}!1" for c in some)
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        starts = B.cut_words(points, np.array([0, len(points)]), tables.classes)
        assert starts.tolist() == [a for _, (a, _) in cut.pre_tokenize_str(line)]


def test_compatible_pairs_are_what_merging_leaves(tables):
    rng = np.random.default_rng(5)
    ids = np.flatnonzero(tables.sound)
    a, b = rng.choice(ids, 4000), rng.choice(ids[:2000], 4000)
    good = B.Tables.compatible(tables, a, b, np.full(len(a), B._NEVER))
    body = lambda i: tables.data[tables.starts[i] : tables.starts[i + 1]].tobytes()
    for x, y, g in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        assert g == (B._merged(body(x) + body(y), tables) == [x, y])
    assert 0 < good.sum() < len(good)


def test_sound_tokens_are_made_of_their_bytes(tables):
    for i in range(0, 50256, 37):
        word = tables.data[tables.starts[i] : tables.starts[i + 1]].tobytes()
        assert bool(tables.sound[i]) == (B._merged(word, tables) == [i])


def test_side_by_side_is_exact(tables):
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abetheing \xe9\xff") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    ids, of = B._merged_side_by_side(words, tables)
    order = np.argsort(of, kind="stable")
    for k, w in enumerate(words):
        assert ids[order][of[order] == k].tolist() == B._merged(w, tables)


def test_words_start_anew(tables, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 3)
    known = B.Words(tables)
    a = B.encode_batch(["one two three four five"], known)[0]
    b = B.encode_batch(["six one"], known)[0]
    again = B.Words(tables)
    assert a.tolist() == B.encode_batch(["one two three four five"], again)[0].tolist() and b.tolist() == B.encode_batch(["six one"], B.Words(tables))[0].tolist() and len(known.seen) == 2


def test_operator_keeps_rows(spark, tables, library):
    df = fx.table(spark, extra=True)
    got = B.decode_ids(B.encode_texts(df, tables), PATH)
    assert set(got.columns) == {*df.columns, "ids", "decoded"} and got.count() == len(fx.documents())
    for r in got.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert B.encode_texts(fx.empty(spark), tables).count() == 0 and B.encode_texts(fx.empty(spark), tables, decoded_col="back").count() == 0
    both = B.encode_texts(df, tables, out_col="x`y", decoded_col="a.b")
    assert set(both.columns) == set(df.columns) and all(r["a.b"] == (r.text or "") and r["x`y"] == library.encode(r.text or "", add_special_tokens=False).ids for r in both.collect())
    odd = B.decode_ids(spark.createDataFrame([(1, None), (2, []), (3, [15496, None, 99999999, 50256])], "i int, ids array<int>"), tables)
    assert {r.i: r.decoded for r in odd.collect()} == {1: "", 2: "", 3: "Hello<|endoftext|>"}


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        B.read_vocabulary(public.path("word_bpe_49k.json"))


def test_query(spark, tmp_path, library):
    import hashlib

    rows = fx.documents() + [(5000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, fx.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in R.op12_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
