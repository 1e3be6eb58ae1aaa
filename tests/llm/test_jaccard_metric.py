import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
import pytest

from cursus.llm import jaccard_metric as jac
from cursus.llm import queries
from cursus.llm.components import components

SF = "/root/testdata/sf0.01"


def shingles(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=85, n=4):
    """(doc_id, n_shingles, component_id) of each row, from all pairs that share a shingle."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                having.setdefault(g, []).append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for j in {j for g in s for j in having[g] if j > k}:
            common = len(s & sets[j][1])
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                a, b = find(i), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query_on_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = brute(list(zip(t["doc_id"], t["text"])))
    assert any(c != i for i, _, c in want)
    assert got(queries.op4_jaccard_metric(spark, SF)) == want


def _edited(rng, words, share):
    return [rng.choice("pqrstuvw") + str(rng.randint(0, 50)) if rng.random() < share else w for w in words]


def _corpus(seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 4, 5, 8, 12, 30, 120]))] for _ in range(12)]
    passage = [f"p{k}" for k in range(25)]
    rows = []
    for k in range(260):
        words = list(rng.choice(bases))
        if rng.random() < 0.5:
            words = _edited(rng, words, 0.015)
        if rng.random() < 0.3:
            words = passage + [f"x{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.2:
            words = words[:rng.randint(1, len(words))]
        rows.append((k, " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return rows


@pytest.mark.parametrize("limit, levels", [(2_000_000, 3), (600, 2), (300, 0)])
def test_random_families(make_docs, limit, levels):
    rows = _corpus(limit)
    rows += rows[:4] + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (None, None), (903, "one"), (904, "ONE"),
                        (905, "one two three"), (906, "w " * 30_000), (907, "W\n" * 30_001), (5, "another text of row five here")]
    docs = make_docs(rows).withColumnRenamed("lang", "component").withColumnRenamed("source", "n_shingles")
    assert got(jac.similar_documents(docs, limit=limit, levels=levels)) == brute(rows)


def test_empty_table(make_docs):
    assert jac.similar_documents(make_docs([])).count() == 0


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        union = 100 * len(x) // percent
        gone = int(rng.integers(0, jac.most_different(len(x), percent) + 1))
        out = int(rng.integers(0, gone + 1))
        y = np.unique(np.append(rng.permutation(x)[out:], rng.integers(0, 1 << 63, gone - out).astype(np.uint64)))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < percent * (len(x) + len(y) - common):
            continue
        assert len(x) + len(y) - common <= max(union, 100 * len(y) // percent)
        keys, of, need = jac.part_hashes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
        shared = set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
        assert shared and len(shared) >= max(need)


def test_sets_in_few_parts_still_meet():
    # all shingles of both sets in one part: neither has enough parts that aren't empty
    x = np.arange(1, 41, dtype=np.uint64)
    y = np.append(x[2:], np.array([77, 78], np.uint64))
    keys, of, need = jac.part_hashes(np.concatenate([x, y]), np.array([0, 40, 80]))
    assert need.tolist() == [1, 1]
    assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_equal_sets_of_two_families_keep_their_links(spark):
    """Document 2 has a text of each family; the other documents of both texts stay linked, whatever the order of rows."""
    rng = random.Random(12)
    t, u = ([f"{c}{rng.randint(0, 10**6)}" for _ in range(60)] for c in "tu")
    t2, u2 = t[:-1] + ["other"], u[:-1] + ["another"]
    rows = [(1, u), (2, u2), (10, t), (11, t2), (2, t)]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = brute(rows)
    assert {c for _, _, c in want} == {1}
    for order, parts in ((rows, 1), (rows[::-1], 1), ([rows[2], rows[4], rows[0], rows[3], rows[1]], 3)):
        assert got(jac.similar_documents(spark.createDataFrame(order, "doc_id long, text string").repartition(parts))) == want


def test_large_documents_with_shared_passages_are_no_family(spark):
    """Passages that long documents share chain them in no task; near copies among them are found."""
    rng = random.Random(4)
    passages = [[f"p{k}.{j}" for j in range(120)] for k in range(8)]
    rows = []
    for k in range(60):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(900, 1800))]
        for p in rng.sample(passages, 3):
            at = rng.randrange(len(words))
            words[at:at] = p
        rows.append((k, " ".join(words)))
        if k % 6 == 0:
            rows.append((1000 + k, " ".join(words[:-40])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jac.similar_documents(df, shingle=5, percent=80)) == brute(rows, percent=80, n=5)


def test_windows_keep_all_links_in_some_cell():
    rng = np.random.default_rng(3)
    points = rng.random((300, 2))
    d = np.abs(points[:, None] - points[None, rng.choice(300, 6)]).max(2)
    cells = [set(c.tolist()) for c in jac.voronoi(d, 0.08)]
    for a in range(300):
        for b in range(a):
            if np.abs(points[a] - points[b]).max() <= 0.08:
                assert any(a in c and b in c for c in cells)
    assert max(map(len, cells)) < 300


def test_region_equals_all_pairs():
    for seed in range(6):
        texts = [t for _, t in _corpus(seed)]
        sets, first = jac.shingle_sets(pa.array(texts))
        r = jac.Region([sets[a:b] for a, b in zip(first, first[1:])])
        r.join(np.arange(len(texts)))
        want = {i: c for i, _, c in brute(list(enumerate(texts)))}
        least = {}
        for i in range(len(texts)):
            least[r.find(i)] = min(i, least.get(r.find(i), i))
        assert {i: least[r.find(i)] for i in want} == want


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 301), (301, 300), (5, 5), (400, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lists_tell_only_impossible_pairs_apart():
    rng = np.random.default_rng(8)
    sets = []
    for k in range(40):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 4000 if k % 4 == 0 else 300))).astype(np.uint64))
        sets.append(x)
        for _ in range(3):
            gone = rng.integers(0, max(len(x) // 4, 1) + 1)
            sets.append(np.unique(np.append(rng.permutation(x)[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64))))
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    near = jac.possible(np.diff(first), [np.frombuffer(c, np.uint8) for c in jac.sketches(np.concatenate(sets), first)])
    assert [len(c) for c in jac.sketches(np.arange(9000, dtype=np.uint64), np.array([0, 0, 100, 400, 9000]))] == [64, 64, 128, 4096]
    assert jac.sketches(np.zeros(300, np.uint64), np.array([0, 300])) == [b""]  # too many in a slice: told apart from none
    linked = np.zeros_like(near)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            linked[a, b] = len(x) and len(y) and 100 * common >= 85 * (len(x) + len(y) - common)
    assert (near | ~linked).all() and near.sum() < 0.2 * near.size
    label = jac.clusters(near)
    for a in range(len(sets)):
        reach = {a}
        while len(more := reach | {int(j) for i in reach for j in np.flatnonzero(near[i])}) > len(reach):
            reach = more
        assert label[a] == min(reach)


def test_long_lists_are_taken_whole(make_docs, monkeypatch):
    monkeypatch.setattr(jac, "LIST", 2)
    rows = _corpus(17)
    assert got(jac.similar_documents(make_docs(rows))) == brute(rows)


def test_order_of_rows_does_not_matter(make_docs):
    rows = _corpus(23)
    assert got(jac.similar_documents(make_docs(rows[::-1]).coalesce(1))) == brute(rows)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_shuffle_files_go_when_a_step_is_written(spark):
    import time

    from cursus.llm.shared import _FREED, written
    before, set_to = _shuffle_files(spark), spark.conf.get(_FREED, None)
    rows = spark.range(2000, numPartitions=4).selectExpr("id % 97 AS k", "id").groupBy("k").agg({"id": "max"})
    kept = written(rows, "freed")
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert kept.count() == 97 and rows.count() == 97 and spark.conf.get(_FREED, None) == set_to


@pytest.mark.parametrize("step, place", [(1, 2), (1 << 20, 4), (1 << 40, 8)])
def test_parts_are_packed_in_few_bytes_and_meet(step, place):
    texts = [" ".join(f"w{k}x{i // 2}" for k in range(40)) for i in range(100)]
    ids = np.arange(100, dtype=np.int64) * step + 5
    batch = pa.record_batch([pa.array(ids), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(jac._part_rows(8, 4, 85)([batch]))
    packed = out.filter(pa.compute.is_valid(out["docs"])).sort_by("bucket")
    sizes = [(len(k), len(d)) for k, d in zip(packed["keys"].to_pylist(), packed["docs"].to_pylist())]
    assert sizes and all(d * 4 == k * place for k, d in sizes)
    every = np.concatenate([np.frombuffer(k, np.uint32) for k in packed["keys"].to_pylist()])
    sets, first = jac.shingle_sets(pa.array(texts[::2]), 4)  # one of each two equal sets gives its parts
    assert len(every) == len(jac.part_hashes(sets, first)[0])
    # texts that share a shingle but for one word meet, whatever their ids
    near = [t.replace("w39x", "v39x") for t in texts]
    both = pa.record_batch([pa.array(np.concatenate([ids, ids + 1])), pa.array(texts + near)], ["doc_id", "text"])
    rows = pa.Table.from_batches(jac._part_rows(8, 4, 85)([both]))
    met = pa.Table.from_batches(jac._meet(rows.sort_by("bucket").to_batches()))
    lists = [set(x) for x in met["docs"].to_pylist() if x is not None]
    assert all(any({int(i), int(i) + 1} <= x for x in lists) for i in ids[::2])
