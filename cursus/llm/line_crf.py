"""Line labelling by a linear-chain conditional random field, decoded by Viterbi.

Each line of a text is content or boilerplate. A line's features (shares of
character classes, repetition, length) and its neighbour's label decide; the
best sequence of labels of each text is found by the Viterbi recursion, run for
all texts of a batch together, line by line. The share of a text's words on
content lines decides whether it is kept.

The field is fitted by maximum likelihood (forward-backward gradients) on a
bounded sample of labelled documents: lines of documents of quality 1 are
content, lines of documents of quality 0 boilerplate. Bounds: at most SAMPLE
documents, of at most SAMPLE_LINES lines each; longer ones are left out of
fitting only.

Cases: a null or empty text has one blank line and no words, and fails the base
rules; without both labels in the sample every line is content; repeated rows
get equal results; empty tables give no rows; other columns are ignored by the
query and pass through ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats, labelled, textkit
from .shared import map_chunks

SAMPLE, SAMPLE_LINES, STEPS = 1_500, 200, 150
CONTENT_SHARE = 0.5       # of a kept text's words, at least, are on content lines
MIN_WORDS, MAX_REPEAT = 50, 50  # base rules: words at least, percent of repeated words at most
LINE_FEATURES = ("bias", "upper", "digit", "symbol", "shout", "stop", "twice", "repeat", "echo", "blank", "short",
                 "long", "ends", "bare")


def line_features(m: docstats.Measured) -> np.ndarray:
    """A row for each line of the batch, values from 0 to 1."""
    n = len(m.line_words)
    data = m.words.data
    kinds = docstats.CLASSES
    # the line feed behind a line counts with it, in a class of its own
    size = np.diff(np.append(m.lines.starts, len(data)))
    key = np.repeat(np.arange(n) * len(kinds), size) + docstats.byte_class(data)
    c = np.bincount(key, minlength=n * len(kinds)).reshape(n, len(kinds)).astype(float)
    chars = np.maximum(c.sum(1) - c[:, kinds.index("continuation")] - c[:, kinds.index("feed")], 1)
    letters = np.maximum(c[:, kinds.index("upper")] + c[:, kinds.index("lower")], 1)
    words = np.maximum(m.line_words, 1)
    echo = np.zeros(len(m.hashes), bool)
    echo[1:] = (m.hashes[1:] == m.hashes[:-1]) & (m.first_line[1:] == m.first_line[:-1])
    last = np.where(m.lines.ends > m.lines.starts, data[np.maximum(m.lines.ends, 1) - 1] if len(data) else 0, 0)
    return np.column_stack([
        np.ones(n), c[:, kinds.index("upper")] / letters, c[:, kinds.index("digit")] / chars,
        np.minimum(10 * c[:, kinds.index("symbol")] / chars, 1), np.minimum(10 * c[:, kinds.index("shout")] / chars, 1),
        np.minimum(10 * c[:, kinds.index("stop")] / chars, 1), m.twice_line, m.per_line(m.repeat_word) / words,
        m.per_line(echo) / words, m.line_words == 0, m.line_words <= 3, m.line_words >= 12,
        np.isin(last, list(b".!?;:")), c[:, kinds.index("stop")] == 0])


@dataclass
class Field:
    """Weights of features by label (0 boilerplate, 1 content), scores of label pairs and of first labels."""
    weights: np.ndarray  # features x 2
    pairs: np.ndarray    # label before x label
    first: np.ndarray

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of the lines of each text; ``first`` counts the lines before each text."""
        emit = x @ self.weights
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")  # texts with a k-th line come first at step k
        begin, longest = first[:-1][order], int(counts.max(initial=0))
        alive = np.searchsorted(-counts[order], -np.arange(1, longest + 1), side="right")
        back = np.zeros((len(x), 2), np.int8)
        best = np.zeros((len(counts), 2))
        for k in range(longest):
            at = begin[:alive[k]] + k
            if k == 0:
                best[:alive[k]] = self.first + emit[at]
                continue
            paths = best[:alive[k], :, None] + self.pairs
            back[at] = paths.argmax(1)
            best[:alive[k]] = paths.max(1) + emit[at]
        labels = np.zeros(len(x), np.int8)
        now = best.argmax(1).astype(np.int8)
        for k in range(longest - 1, -1, -1):
            at = begin[:alive[k]] + k
            labels[at] = now[:alive[k]]
            now[:alive[k]] = back[at, now[:alive[k]]]
        return labels


def fit_field(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps; expected counts come from the forward-backward recursions."""
    n, longest = len(first) - 1, int(np.diff(first).max(initial=0))
    there = np.arange(longest) < np.diff(first)[:, None]
    at = np.where(there, first[:-1, None] + np.arange(longest), 0)
    w, pairs, start = np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)
    onehot = np.eye(2)[y]
    both = there[:, 1:] & there[:, :-1]
    seen_pairs = np.einsum("ntk,ntl,nt->kl", onehot[at[:, :-1]], onehot[at[:, 1:]], both)
    seen = [x.T @ onehot, seen_pairs, onehot[first[:-1]].sum(0)]
    size = [np.zeros_like(s) for s in seen]
    params = [w, pairs, start]
    for _ in range(steps):
        emit = (x @ params[0])[at]  # texts x lines x labels
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = params[2] + emit[:, 0]
        for k in range(1, longest):
            step = np.logaddexp.reduce(fwd[:, k - 1, :, None] + params[1], axis=1) + emit[:, k]
            fwd[:, k] = np.where(there[:, k, None], step, fwd[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(params[1] + (emit[:, k + 1] + bwd[:, k + 1])[:, None, :], axis=2)
            bwd[:, k] = np.where(there[:, k + 1, None], step, 0)
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        node = np.exp(fwd + bwd - total[:, None, None]) * there[:, :, None]
        edge = np.exp(fwd[:, :-1, :, None] + params[1] + (emit + bwd)[:, 1:, None, :] - total[:, None, None, None])
        lines = np.zeros((len(x), 2))
        lines[at[there]] = node[there]
        expected = [x.T @ lines, (edge * both[:, :, None, None]).sum((0, 1)), node[:, 0].sum(0)]
        for p, s, e, g2 in zip(params, seen, expected, size):
            g = (s - e) / len(x) - ridge * p
            g2 += g * g
            p += 0.5 * g / np.sqrt(g2 + 1e-12)
    return Field(*params)


def neutral() -> Field:
    w = np.zeros((len(LINE_FEATURES), 2))
    w[0, 1] = 1.0
    return Field(w, np.zeros((2, 2)), np.zeros(2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Field:
    rows = labelled.sample(docs, labels, label, most).select(
        "text", "label", F.xxhash64("text", "label").alias("row"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = docstats.measure(*textkit.utf8(batch.column(0)))
        x = line_features(m)
        rows = pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(1), textkit.lists(x.ravel(), m.lines.first * x.shape[1], pa.float32())],
            ["row", "label", "x"])
        return rows.filter(pa.array(m.lines.counts <= SAMPLE_LINES))

    # repeated rows of one doc_id can't grow the sample
    got = map_chunks(rows, one, "row bigint, label int, x array<float>").orderBy("row").limit(most).toArrow()
    y = got["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return neutral()
    width = len(LINE_FEATURES)
    lists = got["x"].combine_chunks()
    x = lists.flatten().to_numpy().astype(float).reshape(-1, width)
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy() // width)])
    return fit_field(x, first, np.repeat(y, np.diff(first)))


RULES = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
         "n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, "
         "content_share double")


def apply_rules(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Per document the base counts, the decoded content share and whether it is kept."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = docstats.measure(*textkit.utf8(batch.column(1)))
        content = field.decode(line_features(m), m.lines.first) == 1
        base = docstats.base_rules(m)
        n = base["n_words"]
        on_content = textkit.sums(m.line_words * content, m.lines.first)
        part = np.divide(on_content, n, out=np.zeros(len(n)), where=n > 0)
        failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT * n)
        written = content & (m.line_words > 0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()),
             *[pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
             pa.array(failed), pa.array(~failed & (part >= share)),
             pa.array(textkit.sums(m.line_words > 0, m.lines.first)), pa.array(textkit.sums(written, m.lines.first)),
             pa.array(part)], [c.split()[0] for c in RULES.split(", ")])

    return map_chunks(docs.select("doc_id", "text"), one, RULES)
