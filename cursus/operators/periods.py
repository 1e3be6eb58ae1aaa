"""The period dimension: which periods exist, their list position, label, completeness and side.

The dimension has one row per period present in the usage table, so it is
bounded by the calendar span of the data (a few hundred rows for decades of
monthly snapshots); un-partitioned windows over it and broadcasting it are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C


def complete_periods(daily: DataFrame, cfg: Config) -> DataFrame:
    """Periods of the daily series that are complete.

    Every period present is complete except the last one when the last day of
    the series falls before that period's end. Returns (period_index).
    """
    per = (daily.where(F.col("day").isNotNull())
           .groupBy(C.period_of_date(F.col("day"), cfg.grain).alias("period_index"))
           .agg(F.max("day").alias("last_day")))
    w = Window.partitionBy()
    return (per.withColumn("max_period", F.max("period_index").over(w))
            .where((F.col("period_index") < F.col("max_period"))
                   | (F.col("last_day") >= C.period_end(F.col("last_day"), cfg.grain)))
            .select("period_index"))


def periods_dim(usage: DataFrame, daily: DataFrame | None, cfg: Config) -> DataFrame:
    """(period_index, pos, label, partial, side, max_pos) over the periods present in usage.

    pos is the dense position in the list of periods (the "next period" of the
    panel reports is the next listed one). current = latest complete period,
    previous = the complete one before it; periods that are not complete are
    partial and labelled with '*'.
    """
    present = usage.select("period_index").where(F.col("period_index").isNotNull()).distinct()
    if daily is not None:
        comp = complete_periods(daily, cfg).withColumn("complete", F.lit(True))
        dim = present.join(comp, "period_index", "left").withColumn(
            "complete", F.coalesce(F.col("complete"), F.lit(False)))
    else:
        dim = present.withColumn("complete", F.lit(True))
    w_all = Window.orderBy("period_index")
    w_cand = Window.partitionBy("complete").orderBy(F.col("period_index").desc())
    rn = F.row_number().over(w_cand)
    return (dim.withColumns({
        "pos": (F.row_number().over(w_all) - 1).cast("int"),
        "rn": rn,
    }).withColumn("max_pos", F.max("pos").over(Window.partitionBy())).select(
        F.col("period_index").cast("int").alias("period_index"),
        F.col("pos"),
        F.concat(C.period_label(F.col("period_index"), cfg.grain),
                 F.when(~F.col("complete"), F.lit("*")).otherwise(F.lit(""))).alias("label"),
        (~F.col("complete")).alias("partial"),
        F.when(F.col("complete") & (F.col("rn") == 1), F.lit("cur"))
         .when(F.col("complete") & (F.col("rn") == 2), F.lit("prev")).alias("side"),
        F.col("max_pos"),
    ))


def period_sides(periods: DataFrame) -> DataFrame:
    """The two rows of the period dimension that are current and previous."""
    return periods.where(F.col("side").isNotNull())
