import random
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import sentencepiece
from cursus.llm import mixing, pii_transducer, queries

from .test_jaccard_metric import brute

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*pipeline.DOCUMENT).collect())


def test_stages_against_brute_force(spark):
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mix", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = {r.doc_id: r.predicted for r in queries.op9_counterfactual_toxicity(spark, SF).collect()}
    after = [docs]
    for _, stage in pipeline.STAGES:
        after.append(stage(spark, after[-1], SF).cache())
        assert len(after) == 6 or after[-1].columns == docs.columns
    assert rows_of(after[1]) == Counter({r: n for r, n in rows_of(docs).items() if not score[r[0]]})

    groups = brute([(r[0], r[1]) for r in rows_of(after[1])], percent=80, n=5)
    first = {i for i, _, c in groups if c == i}
    assert rows_of(after[2]) == Counter({r: 1 for r in rows_of(after[1]) if r[0] in first})
    assert len(first) < after[1].count()

    clean = Counter()
    for (i, text, lang, source, _), n in rows_of(after[2]).items():
        new = pii_transducer.redact(text)
        clean[i, new, lang, source, len(new)] += n
    assert rows_of(after[3]) == clean

    copies = {r.doc_id: r.copies for r in mixing.mix_plan(after[3]).collect()}
    assert rows_of(after[4]) == Counter({r: copies[r[0]] for r in clean if copies[r[0]]})

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in clean}
    out = after[5].collect()
    assert all(model.decode(list(r.ids)) == texts[r.doc_id] for r in out)
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in copies.items() if n and texts[i]})
    assert len({(r.doc_id, tuple(r.ids)) for r in out}) == len(out)


def test_run_equals_the_stages_and_survives_edges(spark, make_docs, sf_tables):
    texts = [None, "", "a b", "x " * 60, "x " * 60, "mail me at a@b.cd or one", "word " * 9_000]
    docs = make_docs([(k, t, None if k % 3 else "s") for k, t in enumerate(texts)] + [(None, "no id at all", "s"), (3, "x " * 60, "s")])
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sf = sf_tables(documents=docs, labels=labels)
    out = pipeline.run(spark, sf)
    step = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        step = stage(spark, step, sf).cache()
    assert sorted(map(str, out.collect())) == sorted(map(str, step.collect()))


def test_empty_tables(spark, make_docs, sf_tables):
    sf = sf_tables(documents=make_docs([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert pipeline.run(spark, sf).count() == 0


def test_near_copies_from_four_fifths_on_leave(spark, make_docs):
    rng = random.Random(5)
    rows = []
    for k in range(0, 60, 6):
        base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(330)]
        spread = list(base)
        for at in range(20, 330, 47):  # 2.1 % of the words
            spread[at] = f"s{at}"
        other = [f"z{at}" for at in range(len(base))]
        rows += [(k, base), (k + 1, base + other[:len(base) // 5]), (k + 2, spread), (k + 3, base + other[:len(base) // 3]),
                 (k + 4, other[::-1]), (k + 5, base[:4])]
    rows = [(k, " ".join(words)) for k, words in rows]
    docs = make_docs(rows)
    first = {i for i, _, c in brute(rows, percent=80, n=5) if c == i}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()} == first
    assert not first & {k for k, _ in rows if k % 6 in (1, 2)} and first < {i for i, _, c in brute(rows) if c == i}
