"""A quality classifier: histogram gradient-boosted trees over document statistics.

Each statistic is cut into at most BINS bins at quantiles of the sample. Trees
of fixed depth are grown level by level from histograms of gradients; a tree is
complete, so the whole model is three arrays (feature and threshold by tree and
inner node, value by tree and leaf), and a batch walks all trees at once by
``node = 2 * node + 1 + (x > threshold)``.

Bounds: at most SAMPLE labelled documents to learn from, TREES trees of DEPTH
levels. A score needs the text alone.

Cases: null and empty texts have the statistics zero and get a score like any
other; a sample without both labels gives its smoothed share as every score;
repeated rows get equal scores; empty tables give no rows; other columns pass
through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats, labelled, textkit
from .shared import map_chunks

SAMPLE, BINS, TREES, DEPTH = 20_000, 64, 100, 4
RATE, RIDGE, LEAST = 0.1, 1.0, 8  # step, of leaf values, texts in a leaf


@dataclass
class Trees:
    start: float
    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    value: np.ndarray      # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        while inner and node.size and node.flat[0] < inner:  # complete trees: all rows are on one level
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.start + self.value[tree, node - inner].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column, increasing values; a bin holds the values up to its edge."""
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not n or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = bin_edges(x, bins)
    code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    cell = code + np.arange(m) * bins  # of one node's histogram
    margin = np.full(n, start)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            flat = ((node - first)[:, None] * (m * bins) + cell).ravel()
            shape = (width, m, bins)
            hist = [np.bincount(flat, np.repeat(v, m), minlength=width * m * bins).reshape(shape).cumsum(2)
                    for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = hist, [a[:, :, -1:] for a in hist]
            gain = gl ** 2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(1) > 1e-9):
                j, b = divmod(int(best[k]), bins)
                feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + RIDGE)
        margin += value[t][leaf]
    return Trees(start, feature, threshold, value)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Trees:
    rows = labelled.sample(docs, labels, label, most).select(
        "text", "label", F.xxhash64("text", "label").alias("row"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = docstats.statistics(docstats.measure(*textkit.utf8(batch.column(0))))
        first = np.arange(len(x) + 1) * x.shape[1]
        return pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(1), textkit.lists(x.ravel(), first, pa.float64())], ["row", "label", "x"])

    # repeated rows of one doc_id can't grow the sample
    got = map_chunks(rows, one, "row bigint, label int, x array<double>").orderBy("row").limit(most).toArrow()
    x = np.array(got["x"].combine_chunks().flatten().to_numpy()).reshape(-1, len(docstats.STATISTICS))
    return grow(x, got["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Trees, column: str = "quality_score") -> DataFrame:
    """Documents with their score in a further column; a column of that name is replaced."""
    docs = docs.drop(column)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text"))
        s = model.scores(docstats.statistics(docstats.measure(*textkit.utf8(text))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, column])

    return map_chunks(docs, one, schema)
