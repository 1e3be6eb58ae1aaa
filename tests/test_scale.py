"""Plans and layouts that keep what is shuffled, broadcast and written in proportion to the input."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from cursus.config import TEST
from cursus.operators import user_sets as U
from cursus.operators.rollups import pairs, pairs_by_period
from cursus.sources import exports, fixtures, sinks
from cursus.sources import files as FS
from cursus.functions.clean import with_usage_measures
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders with null users, null days, and rows that come twice; the other tables as they are."""
    root = tmp_path_factory.mktemp("tables")
    day = dt.datetime(1995, 3, 1)
    rows = [(1, 1, "F", 10.5, day), (1, 1, "F", 10.5, day), (2, 1, "O", 3.25, day), (3, None, "F", 1.0, day), (4, 2, None, None, day),
            (5, 2, "O", 2.0, day.replace(day=2)), (6, None, "O", 2.0, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(
        f"{root}/orders.parquet")
    return str(root)


def test_orders_are_not_broadcast(spark):
    plan = _plan(fixtures.usage_raw(spark, SF_SMALL))
    assert "SortMergeJoin [l_orderkey" in plan, plan


def test_daily_counts_users_once_a_day(spark, tables):
    got = fixtures.daily(spark, tables, TEST)
    assert "Expand" not in _plan(got)
    want = {dt.date(1995, 3, 1): (0.02525, 5, 2, 1, 0.5), dt.date(1995, 3, 2): (0.002, 1, 1, 0, 0.0), None: (0.002, 1, 0, 0, 0.0)}
    assert {r.day: (r.hours, r.contents, r.active, r.effective_raw, r.effective) for r in got.collect()} == want


def test_parts_of_the_export_layout(spark):
    cfg = TEST.with_(grain="month")  # a layout of its own
    root = exports.ensure(spark, SF_SMALL, cfg, ())
    assert not os.path.exists(f"{root}/joined") and not os.path.exists(f"{root}/month_to_month")
    assert exports.ensure(spark, SF_SMALL, cfg, ("daily",)) == root
    assert os.path.exists(f"{root}/daily") and not os.path.exists(f"{root}/joined")
    exports.ensure(spark, SF_SMALL, cfg)
    assert os.path.exists(f"{root}/current") and os.path.exists(f"{root}/roster_b")
    months = os.path.join(root, "month_to_month", "*", exports.MONTH_FILES)
    assert glob.glob(months)
    names = ("user_id", "course_id", "hours", "progress_band", "certified_raw")
    got = FS.read_csv_by_header(spark, months, cfg).select(*names)
    want = fixtures.usage_raw(spark, SF_SMALL, "month").select(*names)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_part_files_of_a_compressed_export_are_one_export():
    files = [("/r/ene_26/part-00000-a.c000.csv.gz", 2), ("/r/ene_26/part-00001-a.c000.csv.gz", 3), ("/r/ene_26/part-00000-b.c000.csv", 1)]
    assert [len(x) for x in FS.newest_exports(files).values()] == [2]


def test_usage_by_file_has_no_exchange(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "c1", 1.0, 5), ("u2", "c1", None, 6), (None, None, 2.0, 5)],
                                 "user_id string, course_id string, hours double, period_index int")
    sinks.write_usage(rows, f"{tmp_path}/a", by_file=True)
    sinks.write_usage(rows, f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    assert _rows(a) == _rows(b) and a.count() == 3


@pytest.mark.parametrize("task_rows", [1 << 18, 50])
def test_pairs_by_period_is_pairs(spark, base, task_rows):
    usage = with_usage_measures(base.usage, TEST)
    odd = usage.limit(200).withColumn("user_id", F.lit(None).cast("string"))
    usage = usage.unionByName(odd)
    got, want = pairs_by_period(usage, TEST, task_rows), pairs(usage, TEST)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert _plan(got).count("Exchange") <= 1 + _plan(usage).count("Exchange")


def test_bitmaps_are_made_after_the_exchange(spark):
    rows = spark.createDataFrame([(f"u{i % 40}", 5 + i % 2, f"c{i % 3}", "b", "p", float(i % 2)) for i in range(200)],
                                 "user_id string, period_index int, course_id string, brand string, population string, hours double")
    index = U.user_sets(rows, U.user_numbers(rows))
    lines = index._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    made = [i for i, x in enumerate(lines) if "bitmap_construct_agg" in x]
    exchange = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(bucket" in x]
    assert len(made) >= 2 and exchange and max(made) < min(exchange), "\n".join(lines)
    assert U.distinct_users(index).first()["users"] == 40
