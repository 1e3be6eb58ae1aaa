"""User-set index: exact counts over any cells, numbers that stay, periods delivered again, sketches within their error."""

import pytest
from pyspark.sql import functions as F

from cursus.operators import user_sets as U
from cursus.plans.base import materialized
from cursus.plans.registry import load_all, run_on

COLUMNS = "period_index int, user_id string, course_id string, brand string, population string, hours double"


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("keys", [(), ("brand",), ("course_id", "population"), ("period_index",)])
@pytest.mark.parametrize("part_users", [100, U.PART_USERS])
def test_counts_equal_count_distinct(base, keys, part_users):
    usage = base.usage.select("user_id", "hours", *U.CELL[:-1]).cache()
    index = U.user_sets(usage, U.user_numbers(usage, part_users))
    _same(U.distinct_users(index, *keys), usage.groupBy(*keys).agg(F.count_distinct("user_id")))
    low, high = 1994 * 4, 1995 * 4 + 1
    some = F.col("period_index").between(low, high)
    _same(U.distinct_users(index.where(some & F.col("active")), *keys),
          usage.where(some & (F.col("hours") > 0)).groupBy(*keys).agg(F.count_distinct("user_id")))
    usage.unpersist()


def test_a_materialised_base_answers_from_its_index(base):
    load_all()
    mat = materialized(base)
    for name in ("distinct_users_rolling", "distinct_users_course"):
        _same(run_on(name, mat), run_on(name, base))
        files = run_on(name, mat).inputFiles()
        assert any("/user_sets/" in f for f in files) and not any("/usage/" in f or "/pairs/" in f for f in files)
    sliced = mat.restrict(brands=["AMER"])
    _same(U.distinct_users(sliced.user_sets), sliced.usage.agg(F.count_distinct("user_id")))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a", "c", None, "Alumnos", 1.0), (1, "a", "c", None, "Alumnos", 1.0), (1, "b", "c", None, "Alumnos", None),
            (1, None, "c", None, "Alumnos", 2.0), (None, "a", None, None, None, 0.0)]
    for data, every, active in ((rows, 2, 1), ([], None, None)):
        df = spark.createDataFrame(data, COLUMNS)
        index = U.user_sets(df, U.user_numbers(df))
        assert U.distinct_users(index).first()["users"] == every
        assert U.distinct_users(index.where("active")).first()["users"] == active


def test_numbers_stay_when_users_are_added_and_a_period_is_replaced(spark, tmp_path):
    def month(period, *users):
        return spark.createDataFrame([(period, f"u{u}", "c", "AMER", "Alumnos", 1.0) for u in users], COLUMNS)

    first = month(1, *range(50)).unionByName(month(2, *range(30, 70)))
    numbers = U.user_numbers(first, 8)
    again = month(2, *range(60, 100))
    more = U.extend_numbers(numbers, again)
    assert more.count() == more.select("number").distinct().count() == 100
    assert numbers.exceptAll(more).isEmpty()
    assert U.extend_numbers(numbers.limit(0), again).count() == 40
    path = str(tmp_path / "sets")

    def write(index):
        index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_index").parquet(path)

    write(U.user_sets(first, numbers))
    assert U.distinct_users(spark.read.parquet(path)).first()["users"] == 70
    write(U.user_sets(again, more))
    got = spark.read.parquet(path)
    assert U.distinct_users(got).first()["users"] == 90
    assert {r.period_index: r.users for r in U.distinct_users(got, "period_index").collect()} == {1: 50, 2: 40}


def test_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).selectExpr("int(id % 7) AS period_index", "concat('u', id % 40000) AS user_id", "'c' AS course_id",
                                        "if(id % 3 = 0, 'AMER', 'EURO') AS brand", "'Alumnos' AS population", "1.0D AS hours")
    sketches = U.user_sketches(df)
    assert sketches.count() == 14
    for keys in ((), ("brand",)):
        exact = {tuple(r)[:-1]: r[-1] for r in df.groupBy(*keys).agg(F.count_distinct("user_id").alias("n")).collect()}
        near = {tuple(r)[:-1]: r[-1] for r in U.distinct_users(sketches, *keys).collect()}
        assert set(near) == set(exact)
        assert all(abs(near[k] - n) <= 4 * 0.0081 * n for k, n in exact.items())
