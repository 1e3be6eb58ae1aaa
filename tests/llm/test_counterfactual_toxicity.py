import zlib

import numpy as np

from cursus.llm import counterfactual_toxicity as tox
from cursus.llm import queries

SF = "/root/testdata/sf0.1"


def test_swaps_stay_in_their_kind():
    assert tox.swapped("Muslims and gay men, policemen", 1) == "Jews and lesbian women, policemen"
    for kind in tox.IDENTITIES:
        assert tox.swapped(kind[0], len(kind)) == kind[0]


def _biased(make_docs, spark):
    """Toxic texts mostly name one group, neutral texts mostly another."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        group = "muslims" if rng.random() < (0.9 if toxic else 0.15) else "christians"
        filler = " ".join(f"w{j}" for j in rng.integers(0, 200, 12))
        rows.append((k, f"The {group} {filler} {'moron trash' if toxic and rng.random() < 0.8 else ''}"))
        labels.append((k, int(toxic)))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_penalty_closes_the_gap_between_groups(make_docs, spark):
    import pyarrow as pa
    docs, labels = _biased(make_docs, spark)
    texts = pa.array(["The muslims w1 w2 w3", "The christians w1 w2 w3"])
    gaps = []
    for penalty in (0.0, 20.0):
        s = tox.fit(docs, labels, penalty=penalty).scores(texts)
        gaps.append(abs(np.log(s / (1 - s)) @ [1, -1]))
    assert gaps[0] > 1.0 and gaps[1] < 0.25 * gaps[0]


def test_held_out_results(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op9_counterfactual_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.97
    clean = [p for p, y in held if y == 0]
    assert sum(clean) < 0.01 * len(clean)


def test_edge_texts(make_docs, spark):
    rows = [(1, None), (2, ""), (3, "Moron " * 40_000), (3, "Moron " * 40_000), (None, "moron"), (5, "\n\n"), (6, "the men")]
    docs = make_docs(rows).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "label")
    train, labels = _biased(make_docs, spark)
    model = tox.fit(train, labels)
    got = {(r.doc_id): r.toxicity for r in tox.score(docs, model).collect()}
    assert got[1] == got[2] == got[5] and got[3] == got[None] > 0.3
    assert tox.score(make_docs([]), model).count() == 0
    none = tox.fit(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert len(none.keys) == 0 and tox.score(docs, none).count() == 7
    assert 0 < tox.fit(docs, spark.createDataFrame([(3, 1), (6, 1)], "doc_id long, toxic int")).intercept
