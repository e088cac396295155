"""Byte-level BPE encoding and decoding (12): speculate and verify.

Texts are cut into words by the byte-level pattern (vectorised over code points), and each different word of a chunk is
encoded once. Proposal: the longest token that matches, from left to right, by a trie walked at all places at once.
Verification: byte pair merging leaves a sequence of tokens as it is if no merge crosses a border of two neighbours, and
that hangs on the two alone; so each different pair of neighbours is tested, all pairs at once. Only words with a pair that
fails, or with a token that merging would not make of its own bytes, are merged step by step.

Everything is a map over texts: the tables made from the vocabulary (a few MB, whatever the size of the corpus) go with the
task, texts stay where they are.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, quoted, strings, text_or_empty

#: Code points' classes.
OTHER, LETTER, NUMBER, SPACE = range(4)
_NEVER = np.int64(1) << 40
#: What follows an apostrophe in the pattern's contractions. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Letters and numbers that came after Unicode 16, whose classes the tokenizers library uses. Fixed values.
SINCE_UNICODE_16 = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Different words whose ids a task keeps, at most; and their bytes.
KEPT_WORDS, KEPT_BYTES = 1 << 18, 1 << 25
#: Bytes of a word up to which failing words are merged side by side.
SHORT = 64


def _byte_names() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it is visible Latin-1, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = np.arange(lo, hi, dtype=np.uint32).tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[lo + m.start() : lo + m.end()] = kind
    for a, b in SINCE_UNICODE_16:
        table[a : b + 1] = OTHER
    return table


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in sorted keys; -1 if it isn't there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


@dataclass(frozen=True)
class Tables:
    """A vocabulary: tokens' bytes, merges by pair, the trie, and how each token comes about."""

    data: np.ndarray  # all tokens' bytes
    starts: np.ndarray  # by id, and one more
    pair_keys: np.ndarray  # left << 32 | right, sorted
    pair_rank: np.ndarray
    pair_made: np.ndarray
    rank: np.ndarray  # by id: of the merge that makes it; -1 for single bytes
    left: np.ndarray
    right: np.ndarray
    sound: np.ndarray  # by id: merging its bytes gives the token itself
    edges: np.ndarray  # node << 8 | byte, sorted
    child: np.ndarray
    token_of: np.ndarray  # by node, -1 for none
    single: np.ndarray  # id of each byte
    special: dict[str, int]
    classes: np.ndarray

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_rank.tolist(), self.pair_made.tolist(), strict=True), strict=True))

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Whether merging, up to rank below, never joins a piece at the end of token a with one at the start of token b.

        The pieces at the border are followed back in time, the later made of the two coming apart first. Two pieces that stood
        there together would have been joined if a merge of both has a rank before either was merged on; of equal ranks the
        left place goes first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until, y_until = below.astype(np.int64), below.astype(np.int64) + 0
        y_until = np.where(y_until < _NEVER, y_until - 1, y_until)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            at = _find(self.pair_keys, u << 32 | v)
            r = np.where(at >= 0, self.pair_rank[at], _NEVER)
            bad = (r < x_until[live]) & (r <= y_until[live])
            good[live[bad]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ~bad & ((ru >= 0) | (rv >= 0))
            live, u, v, ru, rv = live[go], u[go], v[go], ru[go], rv[go]
            from_left = ru > rv
            i, j = live[from_left], live[~from_left]
            x_until[i], x[i] = ru[from_left], self.right[u[from_left]]
            y_until[j], y[j] = rv[~from_left], self.left[v[~from_left]]
        return good


def read_vocabulary(path: str) -> Tables:
    """Tables of a byte-level BPE vocabulary in a tokenizers JSON file, read on the driver.

    Raises ValueError for parts that these tables don't cover: other models, normalisers or patterns, dropout, unknown
    tokens, added tokens that take white space with them or stand for words.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut, back = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd or spec["normalizer"] or spec["post_processor"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or back.get("type") != "ByteLevel":
        raise ValueError("not a plain byte-level BPE vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that reach beyond their own characters")
    names, vocab = _byte_names(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *special.values()]) + 1
    bodies = [b""] * n
    for name, i in [*vocab.items(), *special.items()]:
        bodies[i] = bytes(names[c] for c in name) if all(c in names for c in name) else name.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    sides = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    keys = sides[:, 0] << 32 | sides[:, 1]
    order = np.argsort(keys, kind="stable")
    rank, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    rank[sides[:, 2]], left[sides[:, 2]], right[sides[:, 2]] = np.arange(len(sides)), sides[:, 0], sides[:, 1]
    made_by = np.bincount(sides[:, 2], minlength=n)
    single = np.array([vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])], np.int64)
    classes = _class_table()
    blank = np.zeros(0, np.int64)
    half = Tables(blank, blank, keys[order], order.astype(np.int64), sides[order, 2], rank, left, right, blank, blank, blank, blank, single, special, classes)
    sound = np.zeros(n, bool)
    sound[single] = made_by[single] == 0
    for i in np.argsort(rank, kind="stable")[np.count_nonzero(rank < 0) :]:  # parts come before wholes
        sound[i] = made_by[i] == 1 and sound[left[i]] and sound[right[i]] and max(rank[left[i]], rank[right[i]]) < rank[i]
    whole = np.flatnonzero(sound & (rank >= 0))
    sound[whole] = half.compatible(left[whole], right[whole], rank[whole])
    for i in whole[np.argsort(rank[whole], kind="stable")]:  # a token of parts that merging doesn't make isn't made either
        sound[i] &= sound[left[i]] and sound[right[i]]
    edge: dict[int, int] = {}
    token_of = [-1]
    for i in np.flatnonzero(sound).tolist():
        node = 0
        for byte in bodies[i]:
            node = edge.setdefault(node << 8 | byte, len(token_of))
            if node == len(token_of):
                token_of.append(-1)
        token_of[node] = i
    edges = np.fromiter(edge, np.int64, len(edge))
    by = np.argsort(edges)
    child = np.fromiter(edge.values(), np.int64, len(edge))
    starts = np.append(0, np.cumsum([len(b) for b in bodies])).astype(np.int64)
    return Tables(np.frombuffer(b"".join(bodies), np.uint8), starts, half.pair_keys, half.pair_rank, half.pair_made, rank, left, right, sound, edges[by], child[by], np.array(token_of, np.int64), single, special, classes)


def cut_words(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of words among the code points of texts that begin at bounds (n + 1): runs of letters, numbers or others, each with one blank before it, contractions, and white space.

    Of white space before a word the last character stands alone, or goes with the word if it is a blank.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    new = np.empty(n, bool)
    new[0], new[1:] = True, kind[1:] != kind[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    new[edges] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    what = kind[at]
    first = np.zeros(n + 1, bool)
    first[edges] = first[n] = True
    white = what == SPACE
    ends_text = first[end]
    start = np.zeros(n + 1, bool)
    start[at] = True
    last_blank = white & ~ends_text & (points[end - 1] == 0x20)
    alone = white & ~ends_text
    start[end[alone] - 1] = True  # the last character of white space before a word, or the word with it
    joined = end[last_blank]
    start[joined] = False
    marks = np.flatnonzero((what == OTHER) & (end - at == 1) & (points[at] == 0x27) & ~ends_text & start[at])
    marks = marks[what[marks + 1] == LETTER] if len(marks) else marks
    for tail in CONTRACTIONS:
        if not len(marks):
            break
        after = end[marks]
        fits = end[marks + 1] - after >= len(tail)
        for k, c in enumerate(tail):
            fits &= points[np.minimum(after + k, n - 1)] == ord(c)
        hit = after[fits]
        start[hit] = False
        start[hit + len(tail)] = True
        marks = marks[~fits]
    return np.flatnonzero(start[:n])


def _merged(word: bytes, t: Tables) -> list[int]:
    """Exact merging: always the merge of the least rank, of equal ones the leftmost; a heap of pairs over a linked list."""
    ids = [int(t.single[b]) for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(ids) and (m := t.merges.get(ids[i] << 32 | ids[after[i]])):
            heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))

    for i in range(len(ids)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = t.merges[a << 32 | b][1], -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [i for i in ids if i >= 0]


def _merged_side_by_side(words: list[bytes], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one after the other, and each one's word: exact merging, one merge of each word a round."""
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    ids = t.single[np.frombuffer(b"".join(words), np.uint8)]
    done_ids, done_of = [], []

    def ranked(at: np.ndarray) -> None:
        ok = at + 1 < len(ids)
        at = at[ok]
        found = _find(t.pair_keys, ids[at] << 32 | ids[at + 1])
        rank[at] = np.where((found >= 0) & (of[at] == of[at + 1]), t.pair_rank[found], _NEVER)

    rank = np.full(len(ids), _NEVER)
    ranked(np.arange(len(ids)))
    made = t.pair_made[np.argsort(t.pair_rank)]
    while len(ids):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        best = np.minimum.reduceat(np.where(rank < _NEVER, rank * len(ids) + np.arange(len(ids)), _NEVER * len(ids)), first)
        open_ = best < _NEVER * len(ids)
        at = best[open_] % len(ids)
        ids[at] = made[rank[at]]
        stay = np.repeat(open_, np.diff(np.append(first, len(ids))))
        done_ids.append(ids[~stay])
        done_of.append(of[~stay])
        stay[at + 1] = False
        moved = np.cumsum(stay) - 1
        ids, of, rank = ids[stay], of[stay], rank[stay]
        if len(ids):
            rank[moved[at]] = _NEVER
            ranked(moved[at])
            before = moved[at] - 1
            ranked(before[before >= 0])
    return np.concatenate(done_ids), np.concatenate(done_of)


def _proposed(data: np.ndarray, ends: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Place and id of the tokens by longest match, through all words (that end at ends) as one chain."""
    n = len(data)
    stop = np.repeat(ends, np.diff(np.append(0, ends)))
    token, length = np.full(n, -1, np.int64), np.ones(n, np.int64)
    at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(at):
        edge = _find(t.edges, node << 8 | data[at + depth])
        at, node = at[edge >= 0], t.child[edge[edge >= 0]]
        depth += 1
        found = t.token_of[node]
        hit = found >= 0
        token[at[hit]], length[at[hit]] = found[hit], depth
        more = at + depth < stop[at]
        at, node = at[more], node[more]
    follow, places, i = (np.arange(n) + length).tolist(), [], 0
    while i < n:
        places.append(i)
        i = follow[i]
    places = np.array(places, np.int64)
    return places, token[places]


def encode_words(words: list[bytes], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ids of nonempty words, one after the other, and where each word's begin (n + 1)."""
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    places, ids = _proposed(data, ends, t)
    of = np.searchsorted(ends, places, "right")
    failed = np.zeros(len(words), bool)
    failed[of[ids < 0]] = True
    inner = np.flatnonzero((of[1:] == of[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
    pairs, back = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
    good = t.compatible(pairs >> 32, pairs & 0xFFFFFFFF, np.full(len(pairs), _NEVER))
    failed[of[inner[~good[back]]]] = True
    keep = ~failed[of]
    ids, of = ids[keep], of[keep]
    again = np.flatnonzero(failed)
    short = np.array([i for i in again.tolist() if len(words[i]) <= SHORT], np.int64)
    exact = [(_merged(words[i], t), i) for i in again.tolist() if len(words[i]) > SHORT]
    all_ids, all_of = [ids, *(np.array(e, np.int64) for e, _ in exact)], [of, *(np.full(len(e), i) for e, i in exact)]
    if len(short):
        found, which = _merged_side_by_side([words[i] for i in short.tolist()], t)
        all_ids.append(found)
        all_of.append(short[which])
    all_ids, all_of = np.concatenate(all_ids), np.concatenate(all_of)
    order = np.argsort(all_of, kind="stable")
    return all_ids[order], np.searchsorted(all_of[order], np.arange(len(words) + 1))


class Words:
    """The ids of all different words so far, each encoded once; started anew when there are too many."""

    def __init__(self, t: Tables) -> None:
        self.t, self.clear = t, True

    def index(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number, the ids of all numbered words one after the other, and where each one's begin."""
        if self.clear:
            self.seen, self.ids, self.first, self.clear = defaultdict(), np.zeros(0, np.int64), np.zeros(1, np.int64), False
            self.seen.default_factory = self.seen.__len__  # a new word gets the next number
        seen, old = self.seen, len(self.seen)
        at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        ids, first = encode_words(list(islice(seen, old, None)), self.t)
        self.ids, self.first = np.concatenate([self.ids, ids]), np.concatenate([self.first, first[1:] + len(self.ids)])
        self.clear = len(seen) > KEPT_WORDS or len(self.ids) > KEPT_BYTES // 8
        return at, self.ids, self.first


def encode_batch(texts: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, one after the other, and where each text's begin (n + 1)."""
    t = known.t
    marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(t.special, key=len, reverse=True)) + ")") if t.special else None
    pieces, owner = [], []  # ordinary texts in turn with added tokens
    for i, text in enumerate(texts):
        for piece in marks.split(text) if marks and any(s in text for s in t.special) else (text,):
            if piece:
                pieces.append(piece)
                owner.append(i)
    added = np.array([t.special.get(p, -1) for p in pieces], np.int64)
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    bounds = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
    body = "".join(pieces).encode()
    starts = cut_words(points, bounds, t.classes)
    piece_of = np.searchsorted(bounds, starts, "right") - 1
    whole = added[piece_of] >= 0
    keep = ~whole | (starts == bounds[piece_of])  # an added token is one word
    starts, piece_of, whole = starts[keep], piece_of[keep], whole[keep]
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offset = np.append(0, np.cumsum(width))
    cuts = [*offset[starts].tolist(), len(body)]
    words = [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    index, ids, first = known.index(words)
    count = np.where(whole, 1, np.diff(first)[index]) if len(words) else np.zeros(0, np.int64)
    begin = np.append(0, np.cumsum(count)).astype(np.int64)
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    flat = ids[np.minimum(np.repeat(first[index], count) + inside, max(len(ids) - 1, 0))] if len(words) else np.zeros(0, np.int64)
    flat[begin[:-1][whole]] = added[piece_of[whole]]
    text_of = np.array(owner, np.int64)[piece_of] if len(words) else np.zeros(0, np.int64)
    return flat, begin[np.searchsorted(text_of, np.arange(len(texts) + 1))]


def decode_batch(ids: np.ndarray, offs: np.ndarray, t: Tables) -> list[str]:
    """Texts of rows of ids; ids that the vocabulary lacks are passed over, bytes that are no UTF-8 become U+FFFD."""
    known = (ids >= 0) & (ids < len(t.starts) - 1)
    ids = np.where(known, ids, 0)
    lens = np.where(known, t.starts[ids + 1] - t.starts[ids], 0)
    ends = np.append(0, np.cumsum(lens)).astype(np.int64)
    at = np.arange(ends[-1]) + np.repeat(t.starts[ids] - ends[:-1], lens)
    body, cut = t.data[at].tobytes(), ends[offs].tolist()
    return [body[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]


def encode_texts(docs: DataFrame, vocabulary: str | Tables, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with out_col (replaced if it is there): the token ids of each whole text, an array of int; with decoded_col also the text that they stand for, by the same worker.

    vocabulary: a file of the driver, see read_vocabulary, or its tables. Added tokens within a text are found first, the
    longest of several. A null or empty text has no ids; texts of any length are encoded whole; bytes that are no UTF-8 count
    as U+FFFD. All rows and columns stay as they are, repeated ones too; an empty table gives an empty result.
    """
    t = vocabulary if isinstance(vocabulary, Tables) else read_vocabulary(vocabulary)
    bounded_batches(docs)
    known = Words(t)

    def encoded(column: pa.Array) -> tuple[pa.Array, list[str]]:
        data, offs = strings(column)
        ids, begins, last, back = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, []
        for i, j in chunks(offs):
            part, begin = encode_batch([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[i:j], offs[i + 1 : j + 1], strict=True)], known)
            ids.append(part.astype(np.int32))
            if decoded_col:
                back += decode_batch(part, begin, t)
            begins.append(begin[1:] + last)
            last += len(part)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(begins).astype(np.int32)), pa.array(np.concatenate(ids))), back

    if decoded_col is None:
        return docs.withColumn(out_col, F.arrow_udf(lambda column: encoded(column)[0], "array<int>")(text_or_empty(text_col)))

    def both(column: pa.Array) -> pa.Array:
        ids, back = encoded(column)
        return pa.StructArray.from_arrays([ids, pa.array(back, pa.string())], names=["ids", "decoded"])

    made = F.arrow_udf(both, "struct<ids:array<int>,decoded:string>")(text_or_empty(text_col))
    kept = [F.col(quoted(c)) for c in docs.columns if c not in (out_col, decoded_col)]
    return docs.select(*kept, made.alias(out_col)).select(*kept, F.col(quoted(out_col))["ids"].alias(out_col), F.col(quoted(out_col))["decoded"].alias(decoded_col))


def decode_ids(rows: DataFrame, vocabulary: str | Tables, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col (replaced if it is there): the text that ids stand for, added tokens included; '' for none or null, null ids within an array are passed over."""
    t = vocabulary if isinstance(vocabulary, Tables) else read_vocabulary(vocabulary)
    bounded_batches(rows)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        offs = np.asarray(column.offsets).astype(np.int64)
        values = column.values.slice(offs[0], offs[-1] - offs[0]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        offs = offs - offs[0]
        return pa.array([s for i, j in chunks(offs * 4) for s in decode_batch(values[offs[i] : offs[j]], offs[i : j + 1] - offs[i], t)], pa.string())

    return rows.withColumn(out_col, decode(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
