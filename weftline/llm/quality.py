"""Quality classifier (3): a generalised additive model with pairwise interactions, learned by cyclic boosting.

Features are counted from a text's bytes and words with numpy, whole texts in Arrow batches. Each feature is cut into
quantile bins; rounds of boosting visit the features in turn and fit one shallow tree (a few splits of the bins) to the
loss gradient, added into that feature's lookup table. Then the pairs of features whose two-way tables reduce the
remaining loss most are boosted in the same way. A score is the logistic of the intercept plus one table entry per
feature and pair: vectorised bin additions.

Learning uses at most SAMPLE labelled rows, the least by a hash of their ids (a documented bound); everything else runs
over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, gram_hashes, strings, text_or_empty, word_bounds, word_hashes

#: Most labelled rows that the fit takes in; the driver holds this many rows of features.
SAMPLE = 20_000
BINS = 24
FEATURES = (
    "words", "bytes_per_word", "letter_share", "digit_share", "upper_share", "space_share", "line_share", "mark_share", "pipe_share", "symbol_share",
    "stop_share", "comma_share", "sentence_words", "wide_share", "short_word_share", "long_word_share", "distinct_share", "same_as_last_share",
    "same_pair_share", "top_word_share", "longest_run", "capital_word_share", "words_per_line", "line_repeat_share", "marked_word_share", "word_length_spread",
)


def _byte_classes() -> np.ndarray:
    """A row per class, a column per byte value."""
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    digit, upper = (b >= 48) & (b <= 57), (b >= 65) & (b <= 90)
    space, line = np.isin(b, [9, 11, 12, 13, 32]), b == 10
    stop, comma, pipe = np.isin(b, [33, 46, 63]), b == 44, b == 124
    mark = np.isin(b, [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63])
    symbol = ~(letter | digit | space | line | mark)
    return np.stack([letter, digit, upper, space, line, mark, pipe, symbol, stop, comma, b >= 192])


_CLASSES = _byte_classes()


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; an empty text is all zeros."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offs).astype(float)
    bytes_ = np.maximum(size, 1)
    counts = np.zeros((len(_CLASSES), n))
    for k, table in enumerate(_CLASSES):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        counts[k] = total[offs[1:]] - total[offs[:-1]]
    letter, digit, upper, space, line, mark, pipe, symbol, stop, comma, wide = counts
    ws, we, bounds = word_bounds(data, offs)
    words = np.diff(bounds).astype(float)
    w1 = np.maximum(words, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(values))
        return total[bounds[1:]] - total[bounds[:-1]]

    lens = (we - ws).astype(float)
    hashes = word_hashes(data, ws, we)
    row = np.repeat(np.arange(n), np.diff(bounds))
    same = np.zeros(len(ws), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    runs = np.zeros(len(ws))
    if len(ws):
        idx = np.arange(len(ws))
        runs = idx - np.maximum.accumulate(np.where(same, 0, idx)) + 1.0
    longest = np.zeros(n)
    np.maximum.at(longest, row, runs)

    def distinct(values: np.ndarray, of: np.ndarray, top: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number of distinct values of each row, and the count of the commonest."""
        if not len(values):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((values, of))
        v, r = values[order], of[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])))
        most = np.zeros(n)
        np.maximum.at(most, r[first], np.diff(np.append(first, len(v))).astype(float))
        return np.bincount(r[first], minlength=n).astype(float), most

    kinds, top = distinct(hashes, row)
    pair = gram_hashes(hashes, 2)
    inside = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, int)
    pair_kinds, _ = distinct(pair[inside], row[inside])
    pairs = np.bincount(row[inside], minlength=n).astype(float) if len(inside) else np.zeros(n)
    # lines: runs of bytes between line feeds
    breaks = np.zeros(256, bool)
    breaks[10] = True
    ls, le, lb = word_bounds(data, offs, breaks)
    line_row = np.repeat(np.arange(n), np.diff(lb))
    lines = np.maximum(np.diff(lb), 1).astype(float)
    # a line's hash: the sum of its words' hashes, each turned by its place in the line
    line_kinds = lines.copy()
    if len(ls) and len(ws):
        of_line = np.searchsorted(ls, ws, "right") - 1
        place = (np.arange(len(ws)) - np.searchsorted(ws, ls)[of_line]).astype(np.uint64)
        total = np.zeros(len(ls), np.uint64)
        np.add.at(total, of_line, hashes * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)))
        line_kinds = np.maximum(distinct(total, line_row)[0], 1)
    first_byte, last_byte = (data[ws], data[we - 1]) if len(ws) else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    capital = (first_byte >= 65) & (first_byte <= 90)
    marked = np.isin(last_byte, [33, 44, 46, 58, 59, 63])
    mean = per_text(lens) / w1
    spread_ = np.sqrt(np.maximum(per_text(lens * lens) / w1 - mean * mean, 0))
    columns = (
        np.log1p(words), mean, letter / bytes_, digit / bytes_, upper / bytes_, space / bytes_, line / bytes_, mark / bytes_, pipe / bytes_, symbol / bytes_,
        stop / bytes_, comma / bytes_, np.log1p(words / (stop + 1)), wide / bytes_, per_text(lens <= 3) / w1, per_text(lens > 12) / w1, kinds / w1, per_text(same) / w1,
        1 - pair_kinds / np.maximum(pairs, 1), top / w1, np.log1p(longest), per_text(capital) / w1, np.log1p(words / lines), 1 - line_kinds / lines, per_text(marked) / w1, spread_,
    )
    for k, c in enumerate(columns):
        out[:, k] = np.where(size > 0, c, 0.0)
    return out


@dataclass
class AdditiveModel:
    """intercept + sum of tables[f][bin of f] + sum of pair tables."""

    cuts: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, smooth: float) -> np.ndarray:
    """A tree with a few leaves over ordered bins, from gradient and curvature sums: best split first. The step of each bin."""
    parts = [(0, len(g))]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))

    def gain(a: int, b: int) -> tuple[float, int]:
        cuts = np.arange(a + 1, b)
        if not len(cuts):
            return 0.0, a
        lg, lh, tg, th = cg[cuts] - cg[a], ch[cuts] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        value = lg**2 / (lh + smooth) + (tg - lg) ** 2 / (th - lh + smooth) - tg**2 / (th + smooth)
        value = np.where((lh >= least) & (th - lh >= least), value, 0)
        best = int(np.argmax(value))
        return float(value[best]), int(cuts[best])

    while len(parts) < leaves:
        found = [(gain(a, b), (a, b)) for a, b in parts]
        (value, cut), (a, b) = max(found, key=lambda x: x[0][0])
        if value <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting of logistic loss. With no rows, or one class only, the model is a constant."""
    model = AdditiveModel()
    rows, width = x.shape
    for f in range(width):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if rows else np.zeros(0)
        model.cuts.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if rows else 0.5
    model.intercept = float(np.log(mean / (1 - mean)))
    if rows < 2 or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(rows, model.intercept)
    least, smooth = max(1.0, 0.001 * rows * mean * (1 - mean)), 1.0
    for _ in range(rounds):
        for f in range(width):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(b[:, f], y - p, size), np.bincount(b[:, f], p * (1 - p), size), 4, least, smooth)
            model.tables[f] += step
            z += step[b[:, f]]
    coarse = [np.minimum(b[:, f] * 8 // max(1, len(model.tables[f])), 7) for f in range(width)]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for f in range(width):
        for g in range(f):
            cell = coarse[f] * 8 + coarse[g]
            gs, hs = np.bincount(cell, y - p, 64), np.bincount(cell, p * (1 - p), 64)
            gains.append((float((gs**2 / (hs + smooth)).sum()), f, g))
    model.pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[g]))) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-z))
            table = model.pair_tables[k]
            cell = b[:, f] * table.shape[1] + b[:, g]
            gs = np.bincount(cell, y - p, table.size).reshape(table.shape)
            hs = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            # a tree of depth two: the cut of f after which cuts of g on either side gain most
            step, most = np.zeros(table.shape), -1.0
            for cut in np.unique(np.linspace(0, table.shape[0], 9).astype(int)[:-1]):
                one, gain = np.zeros(table.shape), 0.0
                for lo, hi in ((0, cut), (cut, table.shape[0])):
                    if lo < hi:
                        one[lo:hi] = _tree(gs[lo:hi].sum(0), hs[lo:hi].sum(0), 3, least, smooth)
                        gain += float((one[lo:hi] * gs[lo:hi]).sum())
                if gain > most:
                    step, most = one, gain
            step *= rate
            table += step
            z += step.ravel()[cell]
    return model


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = strings(batch.column(0))
            for i, j in chunks(offs):
                x = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.int32()), pa.array(x.ravel())), batch.column(1).slice(i, j - i)], names=["x", "y"])

    return rows.mapInArrow(run, "x array<double>, y int")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fits on labelled rows with crc32(id as text) mod 5 not 0, the least sample of them by a hash of the id.

    Rows with a null label, id or text are not learned from. Of several texts of one id one counts, the least by a hash, and
    equal labels of an id count once, so that the driver holds sample rows at most. With no rows left the model is a constant.
    """
    bounded_batches(docs)
    key = F.col(id_col).cast("string")
    chosen = labels.where(F.col(label_col).isNotNull() & (F.crc32(key) % 5 != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = _feature_rows(one.select("text", "y")).collect()  # sample rows at most
    found = sorted((tuple(r.x), r.y) for r in rows)
    x = np.array([f[0] for f in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([f[1] for f in found], float))


def _scorer(model: AdditiveModel):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, offs = strings(texts)
        parts = [model.score(features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in chunks(offs)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_texts(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row.

    Null texts score as empty ones; texts of any length are read whole. No other column is an input of the score. Repeated
    rows and ids are scored each, equal texts alike; a score equal to the threshold is predicted 1. An empty table gives an
    empty result.
    """
    bounded_batches(docs)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    out = docs.select(F.col(id_col), held.alias("held_out"), _scorer(model)(text_or_empty(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the documents that the model scores below the threshold, all columns kept, whatever their names.

    A null text is judged as an empty one; repeated rows stay or go together; an empty table stays empty.
    """
    bounded_batches(docs)
    return docs.where(_scorer(model)(text_or_empty(text_col)) >= threshold)
