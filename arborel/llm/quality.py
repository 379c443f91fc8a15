"""Quality classifier: histogram gradient-boosted trees over text statistics.

Each text becomes a row of statistics, computed for whole texts with numpy.
Boosting on binned statistics fits trees of one fixed depth, kept as flat
arrays in heap order, so that scoring walks all texts through all trees with
array lookups.  The fit sees a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, mix64, pieces, span_hashes, word_spans

#: Classes of bytes, whose shares are statistics.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "sign": b"#$%&*@^~+=",
    "bar": b"|<>{}[]\\/_",
    "quote": b"'\"()-`",
}
_CLASS = np.full(256, len(_CLASSES), np.int64)  # the rest: control and non-ASCII bytes
for _i, _b in enumerate(_CLASSES.values()):
    _CLASS[list(_b)] = _i
_N = len(_CLASSES) + 1

STATISTICS = [f"share_{c}" for c in [*_CLASSES, "other"]] + ["log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "distinct_fives", "distinct_lines", "line_words", "long_words"]


def _distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and occurrences of the most frequent one."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    if not len(v):
        return np.zeros(n), np.zeros(n)
    head = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])]))
    run = np.diff(np.append(head, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, r[head], run)
    return np.bincount(r[head], minlength=n).astype(float), most


_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a run; an empty text is all zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n) * _N, size)
    counts = np.bincount(row + _CLASS[data], minlength=n * _N).reshape(n, _N)
    starts, ends, words = word_spans(data, offsets)
    lengths = (ends - starts).astype(float)
    n_words = np.diff(words)
    some = np.maximum(n_words, 1)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words])
    mean = sums(lengths) / some
    hashes = span_hashes(LOWER[data], starts, ends)
    kinds, most = _distinct(hashes, words)
    fives = np.zeros(n)
    if len(hashes) >= 5:
        h = np.zeros(len(hashes) - 4, np.uint64)
        for j in range(5):
            h = mix64(h + hashes[j : len(h) + j])
        inside = np.minimum(np.repeat(words[1:], n_words)[: len(h)] - 5, len(h)) >= np.arange(len(h))
        upto = np.concatenate([[0], np.cumsum(inside)])[np.minimum(words, len(h))]
        distinct, _ = _distinct(h[inside], upto)
        fives = distinct / np.maximum(np.diff(upto), 1)
    first, last, lines = word_spans(data, offsets, _LINE)
    same, _ = _distinct(span_hashes(data, first, last), lines)
    n_lines = np.maximum(np.diff(lines), 1)
    columns = [*(counts / np.maximum(size, 1)[:, None]).T, np.log1p(size), np.log1p(n_words), mean, np.sqrt(np.maximum(sums(lengths**2) / some - mean**2, 0)), kinds / some, most / some, fives, same / n_lines, np.log1p(n_words / n_lines), sums(lengths > 20) / some]
    return np.column_stack(columns).astype(np.float32)


@dataclass
class Forest:
    """Trees of one depth in heap order: inner nodes (trees, 2**depth - 1), leaves (trees, 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, damp: float = 1.0, least: int = 5) -> Forest:
    """Fit logistic loss by second-order boosting on histograms of binned columns."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])).astype(np.float32) for j in range(d)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    flat = binned + np.arange(d) * bins
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    raw = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf, np.float32)
        for level in range(depth):
            k, first = 1 << level, (1 << level) - 1
            cell = ((at - first)[:, None] * (d * bins) + flat).ravel()
            shape = (k, d, bins)
            hist = [np.bincount(cell, np.repeat(w, d), k * d * bins).reshape(shape).cumsum(2) for w in (g, h, np.ones(n))]
            gl, hl, cl = hist
            gt, ht, ct = (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + damp) + (gt - gl) ** 2 / (ht - hl + damp) - gt**2 / (ht + damp)
            gain[(cl < least) | (ct - cl < least)] = 0
            best = gain.reshape(k, -1).argmax(1)
            for node in range(k):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + node], threshold[first + node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        at -= len(feature)
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + damp)
        raw += leaf[at]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in pieces(batch, 1):
            s = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists], names=["label", "rank", "statistics"])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000, **options) -> Forest | None:
    """A forest from at most `most` labelled texts, those of the least hashes of the id.

    Null labels and ids teach nothing; several labels of one document all
    count, and so do several texts with one id, up to `most` in all: of the
    pairs of a label and a text those of the least hashes.  Without labelled
    rows the result is None.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("key"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("key", F.lit(11)), "key", "label").limit(most)
    texts = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # At most `most` pairs of integers are broadcast.
    pairs = texts.join(F.broadcast(chosen), "key").select("label", "text", F.xxhash64("key", "text", F.lit(11)).alias("rank"))
    # Ids that repeat give more pairs than labels, so the bound holds once more for what is collected.
    rows = pairs.mapInArrow(_statistics, "label int, rank long, statistics array<float>").orderBy("rank", "label").limit(most).toPandas()
    if not len(rows):
        return None
    x, y = np.stack(rows["statistics"].to_numpy()).astype(np.float32), (rows["label"].to_numpy() == 1).astype(float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of rows
    return boost(x[order], y[order], **options)


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, forest: Forest | None, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document row: doc_id, score (0 to 1), predicted (1 from the threshold on).

    Null texts count as empty; empty texts have statistics too (zeros).
    Without a forest every score is 0.5.  Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch, 1):
                s = np.full(b - a, 0.5) if sent.value is None else sent.value.score(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)
