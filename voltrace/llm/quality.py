"""Document quality by a generalised additive model with pairwise interactions.

Every text is described by a few surface features, computed for a batch at
once. Boosting goes round the features: each step fits one shallow tree to the
gradient histogram of a single feature's bins and adds it to that feature's
lookup table. The strongest pairs of features, by the gain of a two-way
histogram of what is left, then get tables of their own in the same way. A
score is the logistic of a sum of table entries, looked up for a batch at once.

The model is fitted on the driver from the features (not the texts) of at most
``FIT_ROWS`` labelled rows, chosen by a hash of the id; every row is scored.

Edge cases: null and empty texts have all-zero features and get the score of
such a text; null labels or ids are not learned from; with nothing to learn
from every score is 0.5, with one class its smoothed share; repeated labels
count each; clashing ``score`` columns are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import HASH, batchwise, chunks, window_starts, words_of

FIT_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 120
RATE = 0.12
LEAVES = 4
L2 = 2.0
#: Least share of the rows in a leaf.
LEAF = 0.002

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "word_spread", "short_words", "upper", "digits", "symbols", "shouts", "stops", "accents",
    "words_with_symbols", "lines", "repeated_lines", "distinct_words", "echoes", "top_word", "distinct_trigrams",
)

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-" for b in range(256)])
_SHOUT = np.array([chr(b) in "!?" for b in range(256)])
_STOP = np.array([chr(b) in ".;:" for b in range(256)])
_HIGH = np.array([b >= 0xC0 for b in range(256)])
_LINE = np.array([b != 10 for b in range(256)])


def _share_of_new(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and of the most frequent one, in each run."""
    new, top = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for k in np.flatnonzero(np.diff(first)):
        s = np.sort(h[first[k] : first[k + 1]])
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        new[k] = len(at) / len(s)
        top[k] = np.diff(np.append(at, len(s))).max() / len(s)
    return new, top


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document of a chunk."""
    per_doc = lambda mask, cut=off: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[cut])
    w = words_of(data, off)
    n_bytes, n_words = np.diff(off), np.diff(w.first)
    some, words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    size = w.end - w.start
    mean = per_doc_sum(size, w.first) / words
    spread = np.sqrt(np.maximum(per_doc_sum(size * size, w.first) / words - mean**2, 0))
    longest = np.zeros(len(n_words))
    full = n_words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(size, w.first[:-1][full])
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data] | _SHOUT[data], dtype=np.int64)))
    marked = symbol[w.end] > symbol[w.start]
    echo = np.zeros(len(w.hash), bool)
    echo[1:] = w.hash[1:] == w.hash[:-1]
    echo[w.first[:-1][full]] = False
    lines = words_of(data, off, _LINE)
    new_lines, _ = _share_of_new(lines.hash, lines.first)
    new_words, top = _share_of_new(w.hash, w.first)
    at, doc = window_starts(w.first, 3)
    tri = HASH.windows(w.hash, 3)[at]
    new_tri, _ = _share_of_new(tri, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n_words))))))
    letters = np.maximum(per_doc(_LETTER[data]), 1)
    n_lines = np.diff(lines.first)
    return np.stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), mean, np.log1p(longest), spread, per_doc_sum(size <= 3, w.first) / words,
            per_doc(_UPPER[data]) / letters, per_doc(_DIGIT[data]) / some, per_doc(_SYMBOL[data]) / some, per_doc(_SHOUT[data]) / some, per_doc(_STOP[data]) / words, per_doc(_HIGH[data]) / some,
            per_doc_sum(marked, w.first) / words, n_lines / words, np.where(n_lines > 0, 1 - new_lines, 0), new_words, per_doc_sum(echo, w.first) / words, top, new_tri,
        ],
        1,
    )


def per_doc_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[first])


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges and lookup tables of features and pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {i for p in self.pairs for i in p}}
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    ga, ha = g.sum() - a, h.sum() - b
    gain = a * a / (b + L2) + ga * ga / (ha + L2) - g.sum() ** 2 / (h.sum() + L2)
    gain[(b < least) | (ha < least)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float, leaves: int = LEAVES) -> np.ndarray:
    """Value for each bin of the best tree of a few leaves on a histogram, grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_split(g[a:b], h[a:b], least), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the better two-level tree: a cut along one axis, then one along the other on either side."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, cut = _split(a.sum(1), b.sum(1), least)
        for top in {cut, *range(2, len(a), 3)} - {0}:
            out, gain = np.zeros_like(a), -(a.sum() ** 2) / (b.sum() + L2)
            for rows in (slice(0, top), slice(top, None)):
                x, y = a[rows].sum(0), b[rows].sum(0)
                _, k = _split(x, y, least)
                for cols in (slice(0, k), slice(k, None)):
                    gain += x[cols].sum() ** 2 / (y[cols].sum() + L2)
                    out[rows, cols] = x[cols].sum() / (y[cols].sum() + L2)
            if gain > best[0]:
                best = (float(gain), out.T if flip else out)
    return best


def fit_model(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost round the features, then round the strongest pairs."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return AdditiveModel(start, edges, tables, [], coarse, [])
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(n, start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    least = max(1.0, LEAF * n) * 0.05
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slope()
            step = RATE * shallow_tree(np.bincount(b, g, len(tables[k])), np.bincount(b, h, len(tables[k])), least)
            tables[k] += step
            total += step[b]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    width = [len(e) + 1 for e in coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slope()
        at = small[i] * width[j] + small[j]
        return tuple(np.bincount(at, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (g, h))

    gains = sorted(((pair_tree(*cells(i, j), least)[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((width[i], width[j])) for i, j in pairs]
    for _ in range(ROUNDS // 3):
        for (i, j), table in zip(pairs, pair_tables, strict=True):
            step = RATE * pair_tree(*cells(i, j), least)[1]
            table += step
            total += step[small[i], small[j]]
    return AdditiveModel(start, edges, tables, pairs, coarse, pair_tables)


def _featured(docs: DataFrame, rest: list[str], text: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("features", T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in chunks(batch, text):
                x = features(data, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in rest), flat], [*rest, "features"])

    return docs.select(*rest, text).transform(batchwise, run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, text: str = "text", doc_id: str = "doc_id") -> AdditiveModel:
    """Fit on at most ``fit_rows`` rows of ``labels`` (id and a 0/1 label) and their documents."""
    chosen = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(doc_id, F.col(label).cast("int").alias("label")).orderBy(F.xxhash64(doc_id), "label").limit(fit_rows)
    joined = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)  # at most fit_rows ids
    rows = _featured(joined, ["label"], text).toArrow()
    x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the same model whatever the order of rows
    return fit_model(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with a ``score`` from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rest = [c for c in docs.columns if c not in (text, "score")]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in rest), pa.array(held.value.score(features(data, off)))], [*rest, "score"])

    return docs.select(*rest, text).transform(batchwise, run, schema)
