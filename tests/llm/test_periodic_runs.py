import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """Stretches where words q apart are equal, for each q, that have no smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(least, 2 * q):
                found.setdefault((i, e + q), q)
            i = e
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_order(doc_id, n):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return range(n)
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [i if i < a else a + (i - a) % p for i in range(n)]


def expected(doc_id, text, least=12, order=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if order:
        words = [words[i] for i in order(doc_id, len(words))]
    runs = brute_runs(words, least)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, runs, " ".join(w for i, w in enumerate(words) if i not in gone))


def of(rows):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed)
                   for r in rows), key=str)


def test_small_alphabets_equal_brute_force(make_docs):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        letters = "ab" if k % 3 else "abc"
        base = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if k % 4 == 0 and base:
            a, b = sorted(rng.choices(range(len(base)), k=2))
            base = base[:b] + base[a:b] * rng.randint(1, 5) + base[b:]
        rows.append((k, " ".join(base)))
    for least in (12, 5):
        got = periodic_runs.find_runs(make_docs(rows), least=least).collect()
        assert of(got) == sorted((expected(i, t, least) for i, t in rows), key=str)


def test_edge_rows(make_docs):
    passage = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (6, "x " + "a b " * 6 + "a c"), (7, passage), (7, passage),
            (None, "z\n" * 30), (8, " ".join([passage] * 4)), (9, "é x " * 20), (10, "n " * 30_000 + "m"),
            (11, " ".join(f"w{k} {passage}" for k in range(200))), (12, "\x1cq \x85r " * 9)]
    docs = make_docs(rows).withColumn("runs", F.lit(1)).withColumnRenamed("lang", "start")
    got = periodic_runs.find_runs(docs).collect()
    want = [expected(i, t) for i, t in rows if i != 10] + [(10, 1, 0, 30_000, 1, 30_000_000, [(0, 30_000, 1)], "n m")]
    assert of(got) == sorted(want, key=str)
    assert periodic_runs.find_runs(make_docs([])).count() == 0


def test_a_long_text_of_nested_runs():
    """Fibonacci words hold as many runs as words can, nearly."""
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    ids = np.frombuffer(b.encode(), np.uint8).astype(np.int64)
    got = periodic_runs._smallest(*periodic_runs.maximal_pairs(ids, np.zeros(len(ids), np.int64), 12))
    assert list(zip(*(x.tolist() for x in got))) == brute_runs(b)


def test_tandem_order():
    for doc_id in range(300):
        for n in (0, 1, 7, 100):
            got = periodic_runs.tandem_order(doc_id, n)
            assert list(range(n) if got is None else got) == list(brute_order(doc_id, n))


@pytest.mark.parametrize("sf", [SF])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs:
        if len(r.text or "") < 12_000:  # brute force grows with the square
            e = expected(r.doc_id, r.text, order=brute_order)
            want.append((*e[:6], sha("".join(f"{s},{n},{q}\n" for s, n, q in e[6])), sha(e[7])))
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert [got[w[0]] for w in want] == want
    assert sum(w[1] > 0 for w in want) >= 10
