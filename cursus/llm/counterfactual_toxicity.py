"""A toxicity classifier whose scores do not hang on identity terms.

Logistic regression over the presence of words and word beginnings. Texts of
the sample that name a group get counterfactual twins: each identity term is
swapped for another of its kind. The loss adds, to the log loss over texts, the
squared difference between a text's score (before the sigmoid) and its twins'.
Features are chosen by a chi-square test on the sample; identity terms are
always among the candidates, and it is the penalty that takes their weight.

Bounds: the sample holds at most SAMPLE labelled documents, the model at most
FEATURES weights. A score needs the text alone.

Cases: a null or empty text has the score of the intercept; a sample without
both labels gives its smoothed share as every score; repeated rows get equal
scores; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, textkit
from .shared import map_chunks, written

SAMPLE = 10_000     # labelled documents to learn from, at most
FEATURES = 2_048    # weights, at most
PENALTY = 4.0       # of squared score differences between twins
RIDGE = 1e-5
TWINS = 3           # counterfactuals of a text that names a group
PREFIXES = (4, 5, 6)  # bytes of the word beginnings that count as features
LEAST, CHI2 = 4, 12.0

#: Identity terms by kind; a term is swapped for others of its line.
IDENTITIES = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("male", "female", "nonbinary", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "american", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "deaf", "blind", "autistic"),
)
_KIND = {term: kind for kind in IDENTITIES for term in kind}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_KIND, key=len, reverse=True)) + r")\b", re.I)


def swapped(text: str, turn: int) -> str:
    """The text with each identity term replaced by the one ``turn`` places on in its kind."""
    def other(m: re.Match) -> str:
        kind = _KIND[m.group().lower()]
        new = kind[(kind.index(m.group().lower()) + turn) % len(kind)]
        return new.capitalize() if m.group()[0].isupper() else new
    return _TERM.sub(other, text)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature hashes of all words and the text of each: whole words, then beginnings of longer ones."""
    data, offsets = textkit.utf8(column)
    words = textkit.Words(textkit.LOWER[data], offsets, textkit.PUNCTUATION)
    prefix = textkit.PrefixHash(words.data)
    of, length = words.text, words.ends - words.starts
    keys, texts = [prefix(words.starts, words.ends)], [of]
    for n in PREFIXES:
        longer = length > n
        keys.append(textkit.mix(prefix(words.starts[longer], words.starts[longer] + n)))
        texts.append(of[longer])
    return np.concatenate(keys), np.concatenate(texts), len(offsets) - 1


def _identity_keys() -> np.ndarray:
    return np.unique(features(pa.array(sorted(_KIND)))[0])


@dataclass
class Model:
    keys: np.ndarray      # sorted hashes of the features
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """Which feature, counted from 1, may have these low 20 bits: most words are told by this alone."""
        t = np.zeros(1 << 20, bool)
        t[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return t

    def scores(self, column: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
        keys, texts, n = features(column)
        table = self.table() if table is None else table
        maybe = np.flatnonzero(table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        z = np.full(n, self.intercept)
        if len(self.keys) and len(maybe):
            k = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            hit = self.keys[at] == k
            pairs = np.unique(texts[maybe][hit] * len(self.keys) + at[hit])
            z += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], minlength=n)
        return 1 / (1 + np.exp(-z))


SAMPLE_ROWS = "row bigint, turn int, label int, keys array<bigint>"


def _sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, twins: int) -> DataFrame:
    """Distinct features of the sample's texts (turn 0) and of their twins (turn 1 and on), written once."""
    rows = labelled.sample(docs, labels, label, most).select(
        "text", "label", F.xxhash64("text", "label").alias("row"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, known, row = (batch.column(k).to_pylist() for k in range(3))
        out = [(r, 0, y, t or "") for r, y, t in zip(row, known, texts)]
        out += [(r, k, y, swapped(t, k)) for r, y, t in zip(row, known, texts) if t and _TERM.search(t)
                for k in range(1, twins + 1)]
        keys, of, n = features(pa.array([x[3] for x in out], pa.large_string()))
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        first = np.searchsorted(of[new], np.arange(n + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
             pa.array([x[2] for x in out], pa.int32()),
             textkit.lists(keys[new].view(np.int64), first, pa.int64())], ["row", "turn", "label", "keys"])

    return written(map_chunks(rows, one, SAMPLE_ROWS).dropDuplicates(["row", "turn"]), "toxicity-sample")


def _chosen(texts: DataFrame, n: int, share: float, most: int) -> np.ndarray:
    """The features whose presence differs most between the labels, by chi-square, counted by Spark."""
    counts = (texts.select("label", F.explode("keys").alias("key")).groupBy("key")
              .agg(F.count("*").alias("n"), F.sum("label").alias("n1")))
    expected = F.col("n") * F.lit(share)
    chi2 = F.pow(F.col("n1") - expected, 2) / (expected * F.lit(1 - share))
    identity = F.col("key").isin(_identity_keys().view(np.int64).tolist())
    best = (counts.select("key", "n", chi2.alias("chi2"), identity.alias("identity"))
            .where((F.col("n") >= LEAST) & ((F.col("chi2") >= CHI2) | F.col("identity")))
            .orderBy(F.col("chi2").desc(), "key").limit(most))
    return np.sort(np.array([r.key for r in best.select("key").collect()], np.int64).view(np.uint64))


def _presence(rows: DataFrame, keys: np.ndarray, most: int) -> pa.Table:
    """Row, turn, label and the chosen features (their places) of each text and twin, on the driver."""
    def one(batches):
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten().to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            first = np.searchsorted(of[hit], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), textkit.lists(at[hit], first, pa.int32())],
                                             ["row", "turn", "label", "places"])

    found = rows.select("row", "turn", "label", "keys").mapInArrow(one, "row bigint, turn int, label int, places array<int>")
    # texts of repeated doc_ids can't grow the sample
    return found.orderBy("row", "turn").limit(most).toArrow()


def _design(rows: pa.Table, width: int) -> np.ndarray:
    lists = rows["places"].combine_chunks()
    x = np.zeros((len(rows), width), np.float32)
    x[np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, penalty: float = PENALTY,
        twins: int = TWINS) -> Model:
    sample = _sample_rows(docs, labels, label, most, twins)
    n, positive = sample.where("turn = 0").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (positive + 0.5) / (n + 1)
    if positive in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    keys = _chosen(sample.where("turn = 0"), n, positive / n, FEATURES)
    rows = _presence(sample, keys, most * (twins + 1))
    turn, ids = rows["turn"].to_numpy(), rows["row"].to_numpy()
    real, twin = np.flatnonzero(turn == 0), np.flatnonzero(turn > 0)
    x = _design(rows.take(real), len(keys))
    origin = np.searchsorted(ids[real], ids[twin])  # rows are ordered
    gap = x[origin] - _design(rows.take(twin), len(keys)) if len(twin) else np.zeros((0, len(keys)), np.float32)
    w, b = descend(x, rows["label"].to_numpy()[real].astype(np.float64), gap, penalty)
    return Model(keys, w, b)


def descend(x: np.ndarray, y: np.ndarray, gap: np.ndarray, penalty: float, steps: int = 1_000) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on log loss + penalty * mean(gap @ w)**2 + ridge."""
    n, m = len(y), max(len(gap), 1)
    # a bound of the curvature, by power iteration
    v = np.ones(x.shape[1] + 1, np.float32)
    bound = 1.0
    for _ in range(30):
        u = x @ v[:-1] + v[-1]
        g = np.append(x.T @ u, u.sum()) / (4 * n)
        g[:-1] += 2 * penalty / m * (gap.T @ (gap @ v[:-1]))
        bound = float(np.linalg.norm(g)) or 1.0
        v = g / bound
    rate = 0.9 / (bound + RIDGE)
    w = np.zeros(x.shape[1] + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        z = x @ ahead[:-1].astype(np.float32) + ahead[-1]
        err = 1 / (1 + np.exp(-z)) - y
        g = np.append(x.T @ err.astype(np.float32), err.sum()) / n
        g[:-1] += 2 * penalty / m * (gap.T @ (gap @ ahead[:-1].astype(np.float32))) + RIDGE * ahead[:-1]
        new = ahead - rate * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """Documents with their score in a further column; a column of that name is replaced."""
    docs = docs.drop(column)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(batch.column(batch.schema.get_field_index("text")), table)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, column])

    table = model.table()
    return map_chunks(docs, one, schema)
