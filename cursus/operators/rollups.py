"""Pre-aggregates of usage that reports can read in its place.

Three tables, each made from the one before, so that usage is scanned once:

* ``pairs``: user x course x period, with every attribute that a report groups by;
* ``users``: user x period;
* ``courses``: course x period, by brand and population.

Their measures are mergeable: ``hours`` and ``contents`` (exact decimal sums), ``rows`` (usage rows) and ``most_hours``
(of one row). All else is a key, also ``positive``, which keeps rows with and without hours apart, so that a report's
``hours > 0`` means the same on a sum as on its rows. Missing users, courses and attributes are groups of their own.
So a report gives the same rows over a rollup as over usage, as long as it names no column that the rollup lacks:
sums, largest values and distinct sets do not change, counts of rows and means of rows go by ``rows`` (``n_rows`` and
its kin in ``functions.aggs``). Hours finer than the twelfth decimal count as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config

MEASURES = ("hours", "contents", "rows", "most_hours")
KEYS = {
    "courses": ("period_index", "course_id", "course_name", "brand", "population", "positive"),
    "users": ("period_index", "user_id", "brand", "center", "level", "population", "positive"),
    "pairs": ("period_index", "user_id", "course_id", "course_name", "template", "course_created", "brand", "center",
              "level", "population", "progress", "certified", "positive"),
}
#: Coarsest first: what a report can read is the first that has its columns.
LEVELS = tuple(KEYS)


#: Usage rows that a task groups, about.
TASK_ROWS = 1 << 18


def pairs(usage: DataFrame, cfg: Config) -> DataFrame:
    """The finest rollup, from usage rows; columns that an export lacks are no keys."""
    hours, contents = F.col("hours").cast(cfg.sum_type), F.col("contents").cast(cfg.sum_type)
    rows = usage.withColumn("positive", hours > 0)
    return rows.groupBy(*[k for k in (*KEYS["pairs"], "slice") if k in rows.columns]).agg(
        F.sum(hours).alias("hours"), F.sum(contents).alias("contents"), F.count(F.lit(1)).alias("rows"),
        F.max("hours").alias("most_hours")).drop("slice")


def pairs_by_period(usage: DataFrame, cfg: Config, task_rows: int = TASK_ROWS) -> DataFrame:
    """``pairs`` of a stored usage table, to be written by period: one exchange puts rows in the place where they are
    grouped and written.

    A period is cut into slices by user and course, as many as the longest period needs (one count a period, which reads
    no columns), so a task has whole groups of few periods. The number of tasks follows from the rows, too.
    """
    n = usage.groupBy("period_index").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    slices = F.pmod(F.xxhash64("user_id", "course_id"), F.lit(max(1, -(-(n["most"] or 0) // task_rows))))
    tasks = max(usage.sparkSession.sparkContext.defaultParallelism, 2 * (n["all"] or 0) // task_rows)
    return pairs(usage.withColumn("slice", slices).repartition(tasks, "period_index", "slice"), cfg)


def coarser(finer: DataFrame, level: str) -> DataFrame:
    """A rollup from a finer one."""
    return finer.groupBy(*[k for k in KEYS[level] if k in finer.columns]).agg(
        *[F.sum(c).cast(finer.schema[c].dataType).alias(c) for c in ("hours", "contents", "rows")],
        F.max("most_hours").alias("most_hours"))


def level_of(columns) -> str | None:
    """The coarsest rollup that has all of the columns; None if only usage has them."""
    return next((level for level in LEVELS if set(columns) <= {*KEYS[level], *MEASURES}), None)
