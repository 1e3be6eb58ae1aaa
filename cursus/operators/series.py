"""Daily platform series: union of exports, calendar fill, rolling means,
seasonality and year-over-year comparison.

A daily series has one row per calendar day, so it is bounded by the
calendar span (about 365 rows per year) whatever the size of the underlying
data; the un-partitioned windows over it run in one small task by design.
The daily series itself is an aggregation of the events, computed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions.aggs import dsum, median, r6


def series_union(sources: list[DataFrame]) -> DataFrame:
    """Union of (day, hours) sources listed from lowest to highest priority;
    rows without a day are dropped and the highest-priority source wins per day."""
    parts = [s.select(F.col("day"), F.col("hours"), F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.where(F.col("day").isNotNull()).groupBy("day")
            .agg(F.max_by("hours", "priority").alias("hours")))


def calendar(series: DataFrame) -> DataFrame:
    """Every day from the first to the last day of the series."""
    return series.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("day"))


def series_calendar_fill(series: DataFrame) -> DataFrame:
    """Absent days inside the range become 0 hours."""
    return calendar(series).join(series, "day", "left").select(
        "day", F.coalesce(F.col("hours"), F.lit(0.0)).alias("hours"))


def series_gaps(series: DataFrame) -> DataFrame:
    """Reindexed to the daily calendar; missing days keep a null (gaps stay visible)."""
    return calendar(series).join(series, "day", "left").select("day", "hours")


def window_mean(x, w, cfg: Config):
    """Mean over a window frame as exact decimal sum / count (order-independent)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.sum(c.cast(cfg.sum_type)).over(w).cast("double") / F.count(c).over(w)


def long_series(series: DataFrame, cfg: Config) -> DataFrame:
    """day, hours, r7 (trailing 7 rows, min 1), r28 (centred rows i-14..i+13, null
    with fewer than 7 values), seasonal_index = hours / r28, and r7 364 days
    earlier when that day is on or after the launch date."""
    w = Window.orderBy("day")
    r7 = window_mean("hours", w.rowsBetween(-6, 0), cfg)
    w28 = w.rowsBetween(-14, 13)
    r28 = F.when(F.count("hours").over(w28) >= 7, window_mean("hours", w28, cfg))
    s = series.select("day", "hours", r7.alias("r7"), r28.alias("r28"))
    s = s.withColumn("seasonal_index", F.try_divide(F.col("hours"), F.col("r28")))
    ago = s.select(F.date_add("day", cfg.yoy_lag_days).alias("day"), F.col("r7").alias("r7_year_ago"),
                   F.col("day").alias("day_ago"))
    ago = ago.where(F.col("day_ago") >= F.lit(cfg.launch_date).cast("date")).drop("day_ago")
    out = s.join(ago, "day", "left")
    # r7/r28 are exact decimal sums divided once, identical in any engine: no rounding.
    return out.select("day", "hours", "r7", "r28", "seasonal_index", "r7_year_ago")


def yoy_by_month(series: DataFrame, cfg: Config) -> DataFrame:
    """Hours of the same days this year and 364 days earlier, per calendar month.

    Only days present in both years count; the last day of the series (a partial
    export day) is excluded as a current-year day; the base day must be on or
    after the launch date."""
    last = series.agg(F.max("day")).scalar()
    a = series.where(F.col("day") < last).select("day", "hours")
    b = series.where(F.col("day") >= F.lit(cfg.launch_date).cast("date")).select(
        F.date_add("day", cfg.yoy_lag_days).alias("day"), F.col("hours").alias("hours_ago"))
    j = a.join(b, "day")
    g = j.groupBy(C.period_of_date(F.col("day"), "month").alias("month_index")).agg(
        F.count(F.lit(1)).alias("days"), F.min("day").alias("date_from"), F.max("day").alias("date_to"),
        dsum("hours", cfg).alias("hours"), dsum("hours_ago", cfg).alias("hours_ago"))
    return g.select(C.period_label(F.col("month_index"), "month").alias("label"), "month_index",
                    F.col("days").cast("long"), "date_from", "date_to", r6("hours").alias("hours"),
                    r6("hours_ago").alias("hours_ago"),
                    r6((F.try_divide(F.col("hours"), F.col("hours_ago")) - 1) * 100).alias("delta_pct"))


def daily_trends(daily_sides: DataFrame, cfg: Config) -> DataFrame:
    """Current period's days with hours, contents and their trailing 7-row means,
    plus the previous period's daily means."""
    prev = daily_sides.where(F.col("side") == "prev")
    hp = prev.agg(F.avg("hours")).scalar()
    cp = prev.agg(F.avg(F.col("contents").cast("double"))).scalar()
    cur = daily_sides.where(F.col("side") == "cur")
    w = Window.orderBy("day").rowsBetween(-6, 0)
    return cur.select("day", r6("hours").alias("hours"), window_mean("hours", w, cfg).alias("hours_r7"),
                      F.col("contents").cast("long").alias("contents"),
                      window_mean("contents", w, cfg).alias("contents_r7"),
                      r6(hp).alias("hours_prev_mean"), r6(cp).alias("contents_prev_mean"))


def daily_summary(daily_sides: DataFrame, cfg: Config) -> DataFrame:
    """Mean and median per day of current hours and contents, with the previous means."""
    s = F.col("side")
    hc = F.when(s == "cur", F.col("hours"))
    cc = F.when(s == "cur", F.col("contents").cast("double"))
    one = daily_sides.agg(
        F.avg(hc).alias("hours_mean"), median(hc, cfg).alias("hours_median"),
        F.avg(cc).alias("contents_mean"), median(cc, cfg).alias("contents_median"),
        F.avg(F.when(s == "prev", F.col("hours"))).alias("hours_prev_mean"),
        F.avg(F.when(s == "prev", F.col("contents").cast("double"))).alias("contents_prev_mean"))
    return one.select(*[r6(c).alias(c) for c in one.columns])


def period_labels(daily_sides: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """Per side: 'label (dd-Mmm → dd-Mmm)' of the valid days, and the cut-off date."""
    g = daily_sides.where(F.col("day").isNotNull()).groupBy("side", "period_index").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    p = F.broadcast(periods.select("period_index", "label"))
    out = g.join(p, "period_index")
    return out.select("side", "period_index", "first_day", "last_day",
                      F.concat(F.col("label"), F.lit(" ("), C.range_label(F.col("first_day"), F.col("last_day")),
                               F.lit(")")).alias("period_label"),
                      C.cutoff_label(F.col("last_day")).alias("cutoff"),
                      C.window_mid_month(F.col("first_day"), F.col("last_day")).alias("mid_month"))


def daily_hours(daily: DataFrame) -> DataFrame:
    return daily.select("day", "hours")
