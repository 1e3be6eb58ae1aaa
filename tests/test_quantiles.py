"""Distributed exact quantiles equal Spark's exact percentile, group by group."""

import random

from pyspark.sql import functions as F

from cursus.operators.quantiles import exact_quantiles

PS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _expected(df, keys):
    aggs = [F.percentile("x", F.lit(p)).alias(f"q{i}") for i, p in enumerate(PS)]
    rows = (df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)).collect()
    out = {}
    for r in rows:
        g = tuple(r[k] for k in keys)
        for i, p in enumerate(PS):
            if r[f"q{i}"] is not None:
                out[(g, p)] = r[f"q{i}"]
    return out


def _got(df, keys):
    return {(tuple(r[k] for k in keys), r["p"]): r["q"] for r in exact_quantiles(df, "x", PS, keys).collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert abs(a[key] - b[key]) <= 1e-9 * max(1.0, abs(a[key])), (key, a[key], b[key])


def test_matches_percentile_grouped(spark):
    rnd = random.Random(7)
    rows = []
    # a hot group with a third of the rows, many duplicates, zeros and negatives
    for _ in range(3000):
        rows.append(("hot", round(rnd.choice([0.0, 0.5, 1.0, rnd.expovariate(0.2), -rnd.random()]), 3)))
    for g in ("a", "b", None):
        for _ in range(rnd.randint(1, 2000)):
            rows.append((g, round(rnd.lognormvariate(0, 2), 6)))
    rows += [("single", 4.25), ("pair", 1.0), ("pair", 2.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    _same(_expected(df, ["g"]), _got(df, ["g"]))


def test_matches_percentile_global_and_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 5, 5, 5, 1, 1e-9, 1e9, 3.5, 3.5, 2]], "x double")
    _same(_expected(df, []), _got(df, []))
    one = spark.createDataFrame([(7.0,)] * 1000, "x double")
    _same(_expected(one, []), _got(one, []))


def test_all_and_active_sets(spark):
    from cursus.config import TEST
    from cursus.operators.quantiles import quantiles_all_and_active
    rows = [("a", 0.0), ("a", 0.0), ("a", 2.0), ("a", 5.0), ("a", 9.5), ("b", 0.0), ("b", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["med"], r["med_act"], r["p90_act"])
           for r in quantiles_all_and_active(df, "x", {"med": 0.5}, {"med_act": 0.5, "p90_act": 0.9}, ["g"], TEST)
           .collect()}
    exp = {r["g"]: (r["med"], r["med_act"], r["p90_act"]) for r in df.groupBy("g").agg(
        F.percentile("x", F.lit(0.5)).alias("med"),
        F.percentile(F.when(F.col("x") > 0, F.col("x")), F.lit(0.5)).alias("med_act"),
        F.percentile(F.when(F.col("x") > 0, F.col("x")), F.lit(0.9)).alias("p90_act")).collect()}
    assert got == exp


def test_reports_same_in_both_exact_modes(base):
    from cursus.plans import registry
    registry.load_all()
    alt = base.restrict()
    alt.cfg = base.cfg.with_(distributed_quantiles=False)
    for name in ("hours_distribution", "group_breakdown", "pop_summary", "path_coverage"):
        a = sorted(map(tuple, registry.run_on(name, base).collect()), key=str)
        b = sorted(map(tuple, registry.run_on(name, alt).collect()), key=str)
        assert a == b, name
