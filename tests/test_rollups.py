"""Rollups: every report over its rollup equals the report over usage; rows, ties, missing values and small hours."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cursus.config import TEST
from cursus.operators import rollups as R
from cursus.plans.base import materialized
from cursus.plans.bundle import bundle_builders, bundle_digest
from cursus.plans.reads import READS, columns_read
from cursus.plans.registry import load_all

COLUMNS = ("period_index int, user_id string, course_id string, course_name string, template string, course_created date, "
           "brand string, center string, level string, population string, progress int, certified boolean, hours double, "
           "contents double")


def _digests(base, **how):
    return {r["report"]: tuple(r) for r in bundle_digest(bundle_builders(base, **how), places=None).collect()}


@pytest.mark.parametrize("how", [{}, {"brands": ["AMER"], "population": "Alumnos"}])
def test_every_report_is_the_same_over_its_rollup(base, how):
    mat = materialized(base)
    assert set(mat.rollups) == set(R.LEVELS)
    over, plain = _digests(mat, **how), _digests(replace(mat, rollups={}), **how)
    assert over == plain


def test_the_coarsest_table_with_the_columns_is_read(base):
    assert R.level_of(("course_id", "hours")) == "courses"
    assert R.level_of(("user_id", "hours")) == "users"
    assert R.level_of(("user_id", "course_id")) == "pairs" and R.level_of(("progress_band",)) is None
    assert all(name in load_all() and R.level_of(columns_read(name)) != "pairs" for names in READS.values() for name in names)
    mat = materialized(base)
    assert mat.reading(None) is mat and mat.reading(("user_id",)).usage is mat.rollups["users"]
    files = lambda name: [f for f in load_all()[name].over(mat).inputFiles() if "/pairs/" in f or "/usage/" in f]
    assert not files("segment_counts") and not files("top_gainers") and files("course_catalog")


def _pairs(spark, rows):
    return R.pairs(spark.createDataFrame(rows, COLUMNS), TEST)


def test_rows_with_and_without_hours_stay_apart_and_nulls_are_groups(spark):
    row = (1, "u", "c", "C", None, None, "AMER", None, None, "Alumnos", 10, True)
    rows = [(*row, 0.0, 1.0), (*row, 0.1, None), (*row, 0.2, 2.0), (*row, None, None), (*row, 0.1, 1.0),
            (1, None, *row[2:], 0.5, 1.0)]
    p = _pairs(spark, rows)
    got = {(r.user_id, r.positive): (None if r.hours is None else float(r.hours), r.rows, r.most_hours) for r in p.collect()}
    assert got == {("u", False): (0.0, 1, 0.0), ("u", True): (0.4, 3, 0.2), ("u", None): (None, 1, None), (None, True): (0.5, 1, 0.5)}
    users, courses = R.coarser(p, "users"), R.coarser(p, "courses")
    assert dict(users.dtypes)["hours"] == dict(p.dtypes)["hours"]
    assert sum(r.rows for r in users.collect()) == sum(r.rows for r in courses.collect()) == 6
    assert R.coarser(courses, "courses").exceptAll(courses).isEmpty()


def test_row_counts_means_and_medians_go_by_rows(spark):
    from cursus.functions.aggs import n_rows, row_mean, row_median
    usage = spark.createDataFrame([(10, True)] * 5 + [(90, False), (90, True), (35, None), (None, True)], "progress int, certified boolean")
    few = usage.groupBy("progress", "certified").agg(F.count(F.lit(1)).alias("rows"))
    assert few.count() < usage.count()
    measures = [df.agg(n_rows(df), n_rows(df, F.col("certified")), row_mean(df, "progress"), row_median(df, "progress")).first() for df in (usage, few)]
    assert tuple(measures[0]) == tuple(measures[1]) == (9, 7, 265 / 8, 10.0)
    none = few.limit(0)
    assert tuple(none.agg(n_rows(none), n_rows(none, F.col("certified")), row_mean(none, "progress")).first()) == (0, 0, None)


def test_no_usage_gives_empty_rollups(spark):
    p = _pairs(spark, [])
    assert [R.coarser(p, level).count() for level in R.LEVELS] == [0, 0, 0]
