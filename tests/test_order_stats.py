"""Order statistics from one index, and reports of all slices from one job."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cursus.config import TEST
from cursus.operators import panel as P
from cursus.operators import snapshot as S
from cursus.operators.order_stats import bucket, bucket_index, merge_index, order_stats
from cursus.operators.slicing import SLICE, user_slices

QUANTILES = {"q0": 0.0, "q1": 0.1, "q2": 0.5, "q3": 0.9, "q4": 1.0}
POSITIVE = {f"p_{k}": p for k, p in QUANTILES.items()}
TOPS = {"t1": 0.01, "t10": 0.10, "t100": 1.0}


def brute(values):
    """The same from sorted lists."""
    def quantile(x, p):
        if not x:
            return None
        pos = (len(x) - 1) * p
        lo = int(pos)
        return x[lo] + (pos - lo) * (x[min(lo + 1, len(x) - 1)] - x[lo])

    x = sorted(v for v in values if v is not None)
    pos = [v for v in x if v > 0]
    return ({n: quantile(x, p) for n, p in QUANTILES.items()} | {n: quantile(pos, p) for n, p in zip(POSITIVE, QUANTILES.values())}
            | {n: sum(x[len(x) - max(1, round(len(x) * p)):]) if x else None for n, p in TOPS.items()})


def close(got, want):
    for n, w in want.items():
        assert (got[n] is None) == (w is None) and (w is None or abs(got[n] - w) <= 1e-8 * max(1, abs(w))), (n, got[n], w)


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(5)
    hot = [rnd.choice([0.0, 0.0, 0.5, 1.0, round(rnd.expovariate(0.2), 3), -rnd.random(), 1e-9, 1e7]) for _ in range(3000)]
    return {"hot": hot, "one": [2.5], "zeros": [0.0] * 50, "negative": [-1.0, -2.0, -2.0], None: [1.0, None, 3.0, 3.0, 8.0],
            "ties": [1.0] * 30 + [2.0] * 30, "nothing": [None, None]}


def test_groups_equal_sorted_lists(spark, groups):
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(7)
    counted = {"n_one": F.col("v") >= 1}
    got = {r.k: r for r in order_stats(df, "v", TEST, ["k"], QUANTILES, POSITIVE, TOPS, counted).collect()}
    assert set(got) == set(groups) - {"nothing"}
    for k, r in got.items():
        x = [v for v in groups[k] if v is not None]
        close(r.asDict(), brute(x))
        assert (r.n, r.n_positive, r.n_one) == (len(x), sum(v > 0 for v in x), sum(v >= 1 for v in x))
        assert abs(float(r.total) - sum(x)) < 1e-6 * max(1, abs(sum(x)))


def test_without_keys_there_is_always_one_row(spark, groups):
    df = spark.createDataFrame([(v,) for v in groups["hot"]], "v double")
    close(order_stats(df, "v", TEST, (), QUANTILES, POSITIVE, TOPS).first().asDict(), brute(groups["hot"]))
    none = order_stats(df.where("false"), "v", TEST, (), QUANTILES, POSITIVE, TOPS).collect()
    assert len(none) == 1 and none[0].n == 0 and all(none[0][n] is None for n in (*QUANTILES, *POSITIVE, *TOPS))


def test_a_stored_index_serves_the_union_of_its_groups(spark, groups, tmp_path):
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    bucket_index(df, "v", TEST, ["k"], {"n_one": F.col("v") >= 1}).write.parquet(f"{tmp_path}/index")
    index = merge_index(spark.read.parquet(f"{tmp_path}/index").drop("k"))
    assert index.exceptAll(bucket_index(df, "v", TEST, (), {"n_one": F.col("v") >= 1})).isEmpty()
    every = [v for vs in groups.values() for v in vs]
    close(order_stats(df, "v", TEST, (), QUANTILES, POSITIVE, TOPS, index=index).first().asDict(), brute(every))


def test_buckets_are_in_the_order_of_values(spark):
    rnd = random.Random(1)
    vs = sorted([0.0, *(s * 2.0 ** rnd.uniform(-1000, 1000) for _ in range(2000) for s in (1, -1))])
    got = [r.b for r in spark.createDataFrame([(v,) for v in vs], "v double").select("v", bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("how", [{}, {"distributed_quantiles": False}])
def test_a_slice_of_all_slices_equals_the_slice_alone(base, how):
    cfg = replace(base.cfg, **how)
    sliced = S.hours_distribution_slices(base.cur, cfg).collect()
    segments, growth = S.segment_slices(base.cur, cfg).collect(), P.growth_by_slice(base.panel, base.periods).collect()
    assert {r.slice_id for r in sliced} == {0, 1, 2, 3} and len({r[:3] for r in sliced}) == len(sliced)
    for r in (r for r in sliced if r.brand in (None, "AMER")):
        one = base.restrict(brands=[r.brand] if r.brand else None, population=r.population)
        assert tuple(S.hours_distribution(one.cur, cfg).first()) == r[3:]
        if not how:
            alone = S.segment_counts(one.cur, cfg).collect()
            assert sorted(map(tuple, alone)) == sorted(x[3:] for x in segments if x[:3] == r[:3])
            alone = P.growth_accounting(one.panel, one.periods, cfg).collect()
            assert sorted(map(tuple, alone)) == sorted(x[3:] for x in growth if x[:3] == r[:3])


def test_missing_brands_and_users_of_two_populations(spark):
    rows = [("a", "B", "P", 1.0), ("a", "B", "Q", 2.0), ("b", None, "P", 0.0), (None, "B", "P", 9.0), ("c", "B", "P", None)]
    df = spark.createDataFrame(rows, "user_id string, brand string, population string, hours double")
    got = {r[:3]: (r.n_users, r.n_activated, r.hours_total, r.median_all) for r in S.hours_distribution_slices(df, TEST).collect()}
    assert got == {(0, "B", "P"): (2, 1, 1.0, 0.5), (0, "B", "Q"): (1, 1, 2.0, 2.0), (0, None, "P"): (1, 0, 0.0, 0.0),
                   (1, "B", None): (2, 1, 3.0, 1.5), (1, None, None): (1, 0, 0.0, 0.0), (2, None, "P"): (3, 1, 1.0, 0.0),
                   (2, None, "Q"): (1, 1, 2.0, 2.0), (3, None, None): (3, 1, 3.0, 0.0)}
    assert user_slices(df.where("false"), TEST).count() == 0 and S.segment_slices(df.where("false"), TEST).columns[:3] == list(SLICE)
