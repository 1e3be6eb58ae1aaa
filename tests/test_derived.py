"""Refreshing periods keeps the derived tables equal to a full rebuild, from the touched periods and the state alone."""

import random

from pyspark.sql import functions as F

from cursus.config import TEST
from cursus.functions.clean import with_usage_measures
from cursus.operators import panel as P
from cursus.operators.periods import periods_dim
from cursus.operators.rollups import LEVELS, coarser, pairs
from cursus.operators.user_sets import distinct_users
from cursus.sources.sinks import write_usage
from cursus.streaming.derived import Derived, refresh_derived
from cursus.streaming.refresh import refresh_usage
from test_sources import NAMES, age, export

COLUMNS = ("period_index int, user_id string, course_id string, course_name string, progress_band string, hours double, contents double, "
           "certified_raw string, brand string, population string")


def _month(spark, period, users, seed=0):
    r = random.Random(seed * 1000 + period)
    rows = [(period, None if u == 0 else f"u{u}", f"c{r.randrange(4)}", "C", "Entre 0% y 20%", r.choice([0.0, None, 0.1, 2.5]), 1.0, "SI",
             TEST.reported_brands[u % 3], "Alumnos") for u in users for _ in range(2)]
    return spark.createDataFrame(rows, COLUMNS)


def _same(a, b):
    key = lambda r: tuple(map(str, r))
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(key, a.select(*cols).collect())) == sorted(map(key, b.select(*cols).collect()))


def _as_rebuilt(spark, root, usage):
    """Every table and report equals the one made from the whole of usage."""
    d = Derived(spark, root, TEST)
    usage = with_usage_measures(usage, TEST)
    periods = periods_dim(usage, None, TEST)
    finest = pairs(usage, TEST)
    for level in LEVELS:
        _same(d.table(level), finest if level == "pairs" else coarser(finest, level))
    panel = P.user_period_panel(usage, periods, TEST)
    _same(d.panel, panel)
    whole = P.growth_accounting(panel, periods, TEST)
    _same(d.growth(), whole)
    by_brand = P.growth_accounting(panel, periods, TEST, by_brand=True)
    _same(d.growth("brand").where(F.col("brand").isin(list(TEST.reported_brands))), by_brand.where("total_active + lost > 0"))
    _same(d.cohorts(), P.cohort_retention(panel, periods, TEST))
    _same(distinct_users(d.table("user_sets"), "course_id"), usage.groupBy("course_id").agg(F.count_distinct("user_id").alias("users")))


def test_a_refreshed_period_equals_a_full_rebuild(spark, tmp_path):
    out, root = f"{tmp_path}/usage", f"{tmp_path}/derived"
    months = {p: _month(spark, p, range(p, 40 - p)) for p in (5, 6, 7, 9)}
    for p in months:
        write_usage(months[p], out, pseudonymise=False)
    refresh_derived(spark, out, root, months, TEST)
    numbers = Derived(spark, root, TEST).table("user_numbers").collect()
    # delivered again with users gone and users new, and a period between
    months |= {6: _month(spark, 6, range(20, 60), seed=1), 8: _month(spark, 8, (0, 3, 77), seed=2)}
    for p in (6, 8):
        write_usage(months[p], out, pseudonymise=False)
    for _ in range(2):  # run again after it was done: nothing changes
        refresh_derived(spark, out, root, (6, 8), TEST)
        after = Derived(spark, root, TEST).table("user_numbers").collect()
        assert set(numbers) <= set(after) and len({r.number for r in after}) == len(after) == len({r.user_id for r in after})
        everything = months[5]
        for p in (6, 7, 8, 9):
            everything = everything.unionByName(months[p])
        _as_rebuilt(spark, root, everything)


def test_other_periods_of_usage_are_not_read(spark, tmp_path):
    out, root = f"{tmp_path}/usage", f"{tmp_path}/derived"
    old, new = _month(spark, 1, range(10)), _month(spark, 2, range(5, 20))
    for month in (old, new):
        write_usage(month, out, pseudonymise=False)
    refresh_derived(spark, out, root, (1, 2), TEST)
    write_usage(_month(spark, 1, range(90, 99)), out, pseudonymise=False)  # not told to the refresh
    again = _month(spark, 2, range(30), seed=3)
    write_usage(again, out, pseudonymise=False)
    refresh_derived(spark, out, root, (2,), TEST)
    _as_rebuilt(spark, root, old.unionByName(again))


def test_the_refresh_job_keeps_derived_tables(spark, tmp_path):
    land, out, ckpt, root = (f"{tmp_path}/{n}" for n in ("land", "out", "ckpt", "derived"))
    glob = f"{land}/*/*.csv"
    export(f"{land}/mar_26/consumo_por_usuario__1.csv", ["a@x.mx", "b@x.mx"])
    age(f"{land}/mar_26/consumo_por_usuario__1.csv", 300)
    export(f"{land}/abr_26/consumo_por_usuario__1.csv", ["b@x.mx"], columns=NAMES[::-1])
    refresh_usage(spark, glob, out, ckpt, TEST, pseudonymise=False, derived=root)
    _as_rebuilt(spark, root, spark.read.parquet(out))
    export(f"{land}/mar_26/consumo_por_usuario__2.csv", ["c@x.mx"])
    refresh_usage(spark, glob, out, ckpt, TEST, pseudonymise=False, derived=root)
    _as_rebuilt(spark, root, spark.read.parquet(out))
    assert distinct_users(Derived(spark, root, TEST).table("user_sets")).first()["users"] == 2
