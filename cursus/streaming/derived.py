"""Derived tables of a usage folder that is refreshed period by period.

The rollups, the numbers of users and the index of user sets (``operators.rollups``, ``operators.user_sets``) are
partitioned by period like usage. When periods are delivered again only their partitions of usage are read, and only
theirs are replaced; users seen for the first time get numbers. What depends on several periods (growth, cohorts, first
active period, distinct users) is worked out from the small index, so nothing of it can be out of date, and
no other period of usage is read.

Steps run in an order in which a job that is cut off can run again for the same periods: numbers are added
before the sets that use them, and each table's periods are replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.clean import with_usage_measures
from ..operators.panel import user_period_panel
from ..operators.periods import periods_dim
from ..operators.rollups import LEVELS, coarser, pairs_by_period
from ..operators.set_growth import cohorts_from_sets, growth_from_sets
from ..operators.user_sets import extend_numbers, user_numbers, user_sets
from ..sources.sinks import by_period


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table's files are there; a write that was cut off leaves only hidden names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName()[0] not in "._" for s in fs.listStatus(p))


def _replace(df: DataFrame, path: str, placed: bool = False) -> None:
    """Write the periods of ``df``, whose rows are together by period already if ``placed``."""
    ((df if placed else by_period(df)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("period_index").parquet(path))


def refresh_derived(spark: SparkSession, usage_path: str, root: str, periods: Iterable[int], cfg: Config) -> None:
    """Bring the derived tables below ``root`` up to date for the periods that were written to the usage folder."""
    touched = sorted(set(periods))
    usage = spark.read.parquet(usage_path).where(F.col("period_index").isin(touched))
    _replace(pairs_by_period(with_usage_measures(usage, cfg), cfg), f"{root}/pairs", placed=True)
    fresh = spark.read.parquet(f"{root}/pairs").where(F.col("period_index").isin(touched))
    numbers = f"{root}/user_numbers"
    if _written(spark, numbers):
        old = spark.read.parquet(numbers)
        extend_numbers(old, fresh).join(old.select("user_id"), "user_id", "left_anti").write.mode("append").parquet(numbers)
    else:
        user_numbers(fresh).write.mode("overwrite").parquet(numbers)
    _replace(user_sets(fresh, spark.read.parquet(numbers)), f"{root}/user_sets")
    for level in LEVELS:
        if level != "pairs":
            _replace(coarser(fresh, level), f"{root}/{level}")


@dataclass
class Derived:
    """The derived tables below a folder, and the reports that they answer."""
    spark: SparkSession
    root: str
    cfg: Config
    daily: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @property
    def periods(self) -> DataFrame:
        return periods_dim(self.table("courses"), self.daily, self.cfg)

    @property
    def panel(self) -> DataFrame:
        return user_period_panel(self.table("users"), self.periods, self.cfg)

    def growth(self, *keys: str) -> DataFrame:
        return growth_from_sets(self.table("user_sets"), self.periods, *keys)

    def cohorts(self) -> DataFrame:
        return cohorts_from_sets(self.table("user_sets"), self.periods)
