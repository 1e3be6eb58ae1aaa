import hashlib
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from cursus.llm import automaton_dedup as dedup
from cursus.llm import queries

SF = "/root/testdata/sf0.01"


def brute(rows, span=50):
    """(doc_id, n_words, n_removed, sha256) of each row, from a table of all windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - span + 1):
                key = tuple(w[k:k + span])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - span + 1):
                if least[tuple(w[k:k + span])] < i:
                    gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query_on_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = brute(list(zip(t["doc_id"], t["text"])))
    assert sum(k[2] for k in want) > 0
    assert got(queries.op5_automaton_dedup(spark, SF)) == want


@pytest.mark.parametrize("contexts", [0, 3, 1_000])
def test_random_passages(make_docs, contexts):
    rng = random.Random(4)
    passages = [[rng.choice("abcd") for _ in range(rng.randint(5, 25))] for _ in range(6)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 3):] if rng.random() < 0.7 else [rng.choice("abcdef") for _ in range(9)]
        rows.append((rng.choice([k, k // 2, None]) if k % 9 == 0 else k, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += rows[:5] + [(500, None), (501, ""), (501, ""), (None, rows[7][1])]
    docs = make_docs(rows).withColumnRenamed("lang", "tid").withColumnRenamed("source", "anchor")
    result = dedup.remove_repeats(docs, span=8, gram=3, contexts=contexts)
    assert got(result) == brute(rows, 8)


def test_long_texts_and_empty_table(make_docs):
    body = " ".join(f"w{k % 997}x{k % 89}" for k in range(60_000))
    rows = [(2, body), (1, "a b " + " ".join(body.split()[30_000:30_070])), (3, "x " * 500), (4, "x " * 49), (5, "x " * 50)]
    assert got(dedup.remove_repeats(make_docs(rows))) == brute(rows)
    assert dedup.remove_repeats(make_docs([])).count() == 0


def test_automaton_gives_the_first_document_of_each_window():
    rng = random.Random(9)
    for _ in range(60):
        contexts = [(d, [rng.randint(0, 2) for _ in range(rng.randint(4, 14))]) for d in range(8)]
        found = dedup.first_documents(contexts, 4)
        for (d, words), firsts in zip(contexts, found):
            want = [min(e for e, other in contexts if any(other[j:j + 4] == words[k:k + 4] for j in range(len(other) - 3)))
                    for k in range(len(words) - 3)]
            assert firsts == want
