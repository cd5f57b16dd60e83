"""Quality classifier: a generalised additive model with pairwise interactions (operator 2).

Features of a text's surface are cut into bins at quantiles. Boosting goes round the features in turn;
each step fits a shallow tree (two cuts, three leaves) to the gradient on one feature's bins and
adds it to that feature's lookup table. Pairs of features with the largest remaining gain on coarse
grids then get tables of their own in the same way, from trees that cut each feature once. A score is
the logistic of the intercept plus one table entry for each feature and pair: additions over bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: Bins of a feature; bins of a feature in a pair; pairs.
BINS, COARSE, PAIRS = 64, 12, 10
#: Rounds over the features and over the pairs, and the share of a tree that is added.
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
#: Weight in the leaves, against tables that follow single rows.
RIDGE = 2.0

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "symbol", "bar", "bang", "white", "distinct_words", "repeats", "line_copies", "ended", "top_word", "distinct_pairs", "longest", "non_ascii", "marked_words", "lines")
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*@^~<>{}[]\\/=+_"
_LETTERS = _UPPER + bytes(range(97, 123))


def features(raw: bytes) -> list[float]:
    """Surface features of a whole UTF-8 text; all 0 for an empty one."""
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = raw.split()
    m = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: n - len(raw.translate(None, chars))
    upper, letters = without(_UPPER), max(without(_LETTERS), 1)
    counts = Counter(words)
    ascii_n = sum(map(len, words))
    return [
        np.log1p(n), np.log1p(len(words)), ascii_n / m, upper / letters, without(_DIGITS) / n, without(_SYMBOLS) / n, raw.count(b"|") / m, raw.count(b"!") / m, 1 - ascii_n / n,
        len(counts) / m, sum(map(bytes.__eq__, words, words[1:])) / m, 1 - len(set(lines)) / max(len(lines), 1), sum(w.endswith(b".") for w in words) / m,
        max(counts.values(), default=0) / m, len(set(zip(words, words[1:]))) / max(m - 1, 1), max(map(len, words), default=0), (n - len(raw.decode("utf-8", "replace"))) / n,
        sum(w[-1:] in b"#$%&*!" for w in words) / m, len(lines) / m,
    ]


class Additive:
    """Lookup tables of features and pairs of features."""

    def __init__(self, intercept: float, cuts: list, tables: list, pairs: list):
        self.intercept, self.cuts, self.tables, self.pairs = intercept, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for i, j, cut_i, cut_j, table in self.pairs:
            total += table[np.searchsorted(cut_i, x[:, i], side="right"), np.searchsorted(cut_j, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    """Places between distinct values, at quantiles."""
    at = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)
    return at[at > x.min()] if len(x) else at


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of the best tree of two cuts over gradient and weight sums of bins."""
    step = np.zeros(len(g))
    spans = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, 0)
        for a, b in spans:
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gain = _gain(gl, hl) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl) - _gain(g[a:b].sum(), h[a:b].sum())
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in spans:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _quad(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each side of a grid once."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c: np.ndarray) -> tuple:
        a, right, low, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, right - a, low - a, total - right - low + a

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gq, hq = quarters(gc), quarters(hc)
    gain = sum(_gain(a, b) for a, b in zip(gq, hq)) - _gain(gc[-1, -1], hc[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(gq, hq)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit on feature rows and labels 0 and 1. Without rows, or of one label only, the score is constant."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    intercept = float(np.log(share / (1 - share)))
    cuts = [_quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if not len(y) or y.min() == y.max():
        return Additive(intercept, cuts, tables, [])
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            if len(table) < 2:
                continue
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]
    coarse = [_quantiles(x[:, j], COARSE) for j in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * shape[1] + cells[j], v, shape[0] * shape[1]).reshape(shape)

    found = sorted(((_quad(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda t: (-t[0], t[1:]))[:PAIRS]
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in found if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            g, h = slopes()
            step = RATE * _quad(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[cells[i], cells[j]]
    return Additive(intercept, cuts, tables, pairs)


def _featured(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(raw) for raw in common.utf8(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(keep))), pa.array(rows, pa.list_(pa.float64()))], [id_col, *keep, "x"])

    return df.select(id_col, text_col, *keep).mapInArrow(common.tidy(work), f"{id_col} {id_type}{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, held: int = 1, folds: int = 3, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled rows whose crc32 of the id as text, modulo ``folds``, isn't ``held``.

    Null ids and labels are left out; an id with several labels takes the one that most of its rows have.
    """
    common.small_batches(docs.sparkSession)
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (common.crc_mod(id_col, folds) != held)).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen = label.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most ``sample`` ids
    found = _featured(rows, id_col, text_col, ["y"]).orderBy(F.xxhash64(id_col), id_col, "x").limit(sample).select("y", "x").collect()
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in found], float))


def score(df: DataFrame, model: Additive, held: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, held_out, score, predicted of every row, and the columns of ``keep``. A null text counts as empty; each row is scored by itself."""
    spark = df.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = list(keep)
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in kept)
    id_type = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col), F.col(text_col), (common.crc_mod(id_col, folds) == held).alias("held_out"), *kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(raw) for raw in common.utf8(batch.column(1).to_pylist())]).reshape(-1, len(FEATURES))
            p = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(batch.column(3 + i) for i in range(len(kept)))], [id_col, "held_out", "score", "predicted", *kept])

    return plain.mapInArrow(common.tidy(work), f"{id_col} {id_type}, held_out boolean, score double, predicted int{kinds}")


def op2_quality(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
