import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cursus.llm import queries, spelling_variants

SF = "/root/testdata/sf0.001"


def brute_words(rows, damaged=31):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if damaged and h % damaged == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            if len(w) >= 7:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_near(words):
    near = {w: [] for w in words}
    lengths = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    for n, some in lengths.items():
        for a, b in itertools.chain(itertools.combinations(some, 2), itertools.product(some, lengths.get(n + 1, []))):
            if is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    return {w: (len(o), min(o, key=lambda x: (-words[x], x), default=None)) for w, o in near.items()}


def brute(words, ratio=10):
    near, form = brute_near(words), {}
    for w in words:
        best = near[w][1]
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w][0], words[form[w]] if form[w] is not None else None))
    return sorted(out)


def of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_words(seed, n=500):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))
        words.add(w)
        cut = rng.randrange(len(w))
        words |= {x for x in (w[:cut] + w[cut + 1:], w[:cut] + "b" + w[cut:], w[:cut] + "ÿ" + w[cut + 1:]) if len(x) >= 7}
    return {w: rng.choice([1, 2, 3, 50, 700]) + 1 for w in words}


def test_pairs_of_an_acceptor_are_all_near_pairs_once():
    for seed in range(5):
        words = sorted(some_words(seed, 200))
        raw = [w.encode("latin-1") for w in words]
        first = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        acceptor = spelling_variants.Acceptor(np.frombuffer(b"".join(raw), np.uint8), first, np.zeros(len(raw), np.int64))
        got = [tuple(sorted(p)) for i, j in acceptor.near_pairs(np.zeros(1, np.int64)) for p in zip(i.tolist(), j.tolist())]
        want = sorted((a, b) for a, b in itertools.combinations(range(len(words)), 2) if is_near(words[a], words[b]))
        assert sorted(got) == want


def test_the_acceptor_is_minimal():
    raw = sorted(a.encode() + b for a in ("ab", "cd", "e") for b in (b"ing", b"ed", b"s"))
    first = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    acceptor = spelling_variants.Acceptor(np.frombuffer(b"".join(raw), np.uint8), first, np.zeros(len(raw), np.int64))
    # the start, a, c, what follows ab, cd and e, in, ng, g (or d: e), and the end
    behind = {tuple(sorted(r[k:] for r in raw if r[:k] == p)) for w in raw for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(acceptor.final) == len(behind)


def test_crowded_states_change_no_result(spark):
    words = some_words(9, 300)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [sorted(map(tuple, spelling_variants.near_words(df, most=m, share=s).collect())) for m, s in ((1 << 16, 1), (70, 256), (3, 10**6))]
    assert got[0] == got[1] == got[2]
    assert got[0] == sorted((w, k, words[best], best) for w, (k, best) in brute_near(words).items() if k)


def test_limit_is_really_lowered(spark):
    words = some_words(9, 300)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert not spelling_variants._crowded(df, 1 << 16, 1)
    deep = spelling_variants._crowded(df, 3, 10**6)
    assert max(len(k) for _, k in deep) > 5


def test_edge_rows(make_docs):
    word = "colour"
    rows = [(1, None), (2, ""), (None, "Letterx letterx"), (None, None), (3, "Colours COLOURS colours " * 60), (3, "colourss colorse " * 9),
            (4, "colorss×÷ÀÉ colours-coloursĀcolours ǅcolours"), (5, "w" * 2_000 + " " + "w" * 2_000 + " " + "w" * 1_999),
            (6, "w" * 2_000), (7, "straße STRASSE straßen straßen naïveté naivete naivete naïveté"), (7, word * 3), (7, word * 3)]
    docs = make_docs(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n").withColumn("form", F.lit("x"))
    for damaged in (31, 0, 2):
        want = brute(brute_words(rows, damaged))
        assert of(spelling_variants.group_variants(docs, damaged=damaged)) == want
    assert any(w[1] for w in brute(brute_words(rows, 0)))
    assert spelling_variants.group_variants(make_docs([])).count() == 0


def test_forms_are_followed_to_the_last(make_docs):
    counts = {"aaaaaaa": 2, "aaaaaab": 21, "aaaaabb": 215, "aaaabbb": 2200, "aaabbbb": 22000}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    got = of(spelling_variants.group_variants(make_docs(rows), damaged=0))
    assert got == brute(counts)
    assert {r[2] for r in got} == {"aaabbbb"}


def test_query_equals_brute_force_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = of(queries.QUERIES["op12_spelling_variants"](spark, SF))
    assert got == brute(brute_words(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = con.execute(queries.ORACLE_SQL["op12_spelling_variants"])
    assert [c[0] for c in sql.description] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(sql.fetchall()) == got
