import zlib

import numpy as np

from cursus.llm import boosted_quality, docstats, queries, textkit

SF = "/root/testdata/sf0.01"


def test_traversal_equals_node_by_node_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = boosted_quality.grow(x, y, trees=30)
    want = []
    for row in x:
        total = trees.start
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        want.append(total)
    assert np.allclose(trees.margins(x), want)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.9


def test_one_label_or_none():
    x = np.zeros((10, 3))
    assert np.allclose(boosted_quality.grow(x, np.ones(10)).scores(x), 10.5 / 11)
    assert boosted_quality.grow(x[:0], np.ones(0)).scores(x).shape == (10,)


def test_held_out_accuracy_and_columns(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_boosted_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_edge_texts(make_docs, spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 60_000), (4, "a " * 60_000), (None, "x y"), (6, "!?")]
    docs = make_docs(rows).withColumnRenamed("lang", "quality").withColumnRenamed("source", "label")
    model = boosted_quality.grow(np.random.default_rng(0).random((50, len(docstats.STATISTICS))), np.arange(50) % 2)
    got = boosted_quality.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.quality_score <= 1 for r in got)
    assert len({r.quality_score for r in got if r.doc_id in (1, 2)}) == 1
    assert boosted_quality.score(make_docs([]), model).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0)], "doc_id long, quality int")
    assert len(boosted_quality.fit(docs, labels).feature) == 0


def test_statistics_do_not_depend_on_the_batch():
    import pyarrow as pa
    texts = ["A b c.\nA b c.\n", None, "x", "ÄÖÜ #1 | a a a a", "one two three " * 5, ""]
    together = docstats.statistics(docstats.measure(*textkit.utf8(pa.array(texts))))
    for k, t in enumerate(texts):
        alone = docstats.statistics(docstats.measure(*textkit.utf8(pa.array([t], pa.string()))))
        assert np.allclose(together[k], alone[0])
