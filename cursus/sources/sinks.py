"""Sinks: the prepared Parquet layout, the long daily series and the manifest.

Usage is written partitioned by period_index with dynamic partition
overwrite, so re-delivering a period replaces only that period's partition
and no period is ever stored twice. Users are pseudonymised on the way out,
after brand and center were resolved from the address. The prepared layout is
published as a whole, in versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import versions

USAGE_OUT_COLUMNS = ("user_id", "course_id", "course_name", "progress_band", "hours", "contents", "template",
                     "level", "certified_raw", "center", "course_created", "brand", "population", "period_index")


def pseudonymise_users(df: DataFrame) -> DataFrame:
    return df.withColumn("user_id", C.pseudonym(F.col("user_id")))


def by_period(df: DataFrame, column: str = "period_index") -> DataFrame:
    """Rows of a period together, as a hint: adaptive execution gives a large period
    several tasks (and so files) and small periods one."""
    return df.hint("rebalance", F.col(column))


def write_usage(usage: DataFrame, path: str, pseudonymise: bool = True, by_file: bool = False) -> None:
    """Selected existing columns, zstd Parquet, one directory per period: the periods of ``usage`` replace theirs.

    With ``by_file``, rows come from files that hold one period each, and need no shuffle: a task writes a file for each
    period among the files it read, so there are no more files than files or splits were read.
    """
    cols = [c for c in USAGE_OUT_COLUMNS if c in usage.columns]
    out = usage.select(*cols)
    if pseudonymise:
        out = pseudonymise_users(out)
    out = out if by_file else by_period(out)
    (out.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("period_index").parquet(path))


def write_series(series: DataFrame, path: str) -> None:
    """The raw long daily series (no current/previous overlay)."""
    series.write.mode("overwrite").option("compression", "zstd").parquet(path)


def manifest(periods: DataFrame, mode: str) -> DataFrame:
    """One row: mode, current and previous period, partial periods (sorted)."""
    return periods.agg(
        F.lit(mode).alias("mode"),
        F.max(F.when(F.col("side") == "cur", F.col("period_index"))).alias("cur"),
        F.max(F.when(F.col("side") == "prev", F.col("period_index"))).alias("prev"),
        F.array_sort(F.collect_list(F.when(F.col("partial"), F.col("period_index")))).alias("partial"))


def write_manifest(periods: DataFrame, mode: str, path: str) -> None:
    manifest(periods, mode).coalesce(1).write.mode("overwrite").json(path)


def write_prepared(usage: DataFrame, daily: DataFrame, roster: DataFrame | None, periods: DataFrame,
                   root: str, mode: str = "calendario", keep: int = versions.KEEP) -> str:
    """Publish the whole prepared layout as a new version, which readers see at once or not at all; returns its folder."""
    tables = {"usage": lambda to: write_usage(usage, to),
              "daily": lambda to: daily.write.option("compression", "zstd").parquet(to)}
    if roster is not None:
        tables["roster"] = lambda to: pseudonymise_users(roster).write.option("compression", "zstd").parquet(to)
    tables["manifest"] = lambda to: write_manifest(periods, mode, to)
    return versions.publish(usage.sparkSession, root, tables, keep)
