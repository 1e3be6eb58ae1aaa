import itertools
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from cursus.llm import line_crf, queries

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = SPLIT.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(covered),
            "base_failed": n < 50 or 100 * len(covered) > 50 * n}


EDGES = [None, "", " \n\t\x0b", "one", "a b c a b c", "x\nx\n\nx \nx", "é ü é ü ñ\n", "a\x1cb \x0cc", "w " * 30_000,
         "same line here\n" * 400, "#*$%&|<>" * 20, "a b a b a", "\n\n\n", "ends\n", "a b c d " * 14 + "\U0001f600"]


def test_base_counts(spark, make_docs):
    rows = [(k, t) for k, t in enumerate(EDGES)] + [(3, "one"), (None, "no id")]
    docs = make_docs(rows).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept")
    got = line_crf.apply_rules(docs, line_crf.neutral()).collect()
    assert Counter((r.doc_id, *(r[k] for k in brute_base(""))) for r in got) == Counter(
        (i, *brute_base(t).values()) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert line_crf.apply_rules(make_docs([]), line_crf.neutral()).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    field = line_crf.Field(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    counts = [1, 7, 3, 0, 9, 1]
    first = np.concatenate([[0], np.cumsum(counts)])
    x = rng.normal(size=(first[-1], 4))
    got, emit = field.decode(x, first), x @ field.weights

    def value(path, lo):
        return field.first[path[0]] + sum(emit[lo + k, p] for k, p in enumerate(path)) + sum(
            field.pairs[a, b] for a, b in itertools.pairwise(path))

    for lo, hi in itertools.pairwise(first):
        if hi > lo:
            best = max(itertools.product((0, 1), repeat=hi - lo), key=lambda p: value(p, lo))
            assert tuple(got[lo:hi]) == best


def test_fitted_field_separates_labels():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 9, 80)
    first = np.concatenate([[0], np.cumsum(counts)])
    y = np.repeat(rng.integers(0, 2, 80), counts)
    x = np.column_stack([np.ones(first[-1]), y + rng.normal(0, 0.7, first[-1])])
    field = line_crf.fit_field(x, first, y)
    alone = ((x[:, 1] > 0.5) == y).mean()  # each line by itself
    assert (field.decode(x, first) == y).mean() > alone + 0.1


def test_query_on_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {i: brute_base(x) for i, x in zip(t["doc_id"], t["text"])}
    got = queries.op1_line_crf(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r.doc_id]} == want[r.doc_id]
        assert r.kept == (not r.base_failed and r.content_share >= line_crf.CONTENT_SHARE)


def test_verdicts_follow_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op1_line_crf(spark, sf).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
