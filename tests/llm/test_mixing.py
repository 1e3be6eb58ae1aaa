import re
from collections import Counter, defaultdict

import duckdb
import pytest

from cursus.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The excess over each cap goes round by weight until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(w[s] for s in open_)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / total for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_match_repeated_resharing(spark):
    cases = [{"a": 100, "b": 1, "c": 50, "d": 7, None: 30}, {"a": 5}, {"a": 0, "b": 10}, {"b": 0},
             {str(k): (k * 37) % 101 for k in range(25)}, {"a": 10, "b": 10, "c": 10}]
    for sizes in cases:
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_edge_rows(make_docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z\tq", "a"), (3, "x y z\tq", "a"), (4, "w " * 50_000, "b"),
            (None, "one two", None), (5, "one", None)]
    docs = make_docs(rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "rate")
    plan = mixing.mix_plan(docs).collect()
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((r[0], words(r[1])) for r in rows)
    assert all(0 <= r.copies <= 2 for r in plan)
    assert mixing.mix_plan(make_docs([])).count() == 0


def test_emit_repeats_rows_and_comes_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plan = mixing.mix_plan(docs, keep=("doc_id", "text"))
    want = {(r.doc_id): r.copies for r in plan.select("doc_id", "copies").collect()}
    out = Counter(r.doc_id for r in mixing.emit(plan).select("doc_id").collect())
    assert out == Counter({k: v for k, v in want.items() if v})
    taken, target = defaultdict(int), {}
    for r in plan.select("source", "size", "copies", "target").collect():
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.25 * target[s] for s in target)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.05 * sum(target.values())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op7_mixing"]).fetchall())
    got = sorted(tuple(r) for r in queries.op7_mixing(spark, SF).select(
        "doc_id", "size", "source_size", "target", "taken").collect())
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]


def test_sql_twins_of_the_other_operators(spark):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name in sorted(queries.ORACLE_SQL):
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns)
        if name != "op7_mixing":
            assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
