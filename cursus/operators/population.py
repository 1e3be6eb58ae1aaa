"""Teacher-population reports (always over the base without a population filter).

"In base" = teachers with any usage row in a period (0 h included); "active" =
teachers with hours > 0. First appearance uses row presence, not activity,
so it is a separate ``min over user`` from the panel's first-active period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TEACHERS, Config
from ..functions import columns as C
from ..functions.aggs import count_if, dsum, dsum0, r6, ratio
from .quantiles import quantile_columns
from .snapshot import top_share


def _teachers(usage: DataFrame) -> DataFrame:
    return usage.where(F.col("population") == TEACHERS)


def pop_by_period(usage: DataFrame, periods: DataFrame, cfg: Config, only: Column | None = None) -> DataFrame:
    """Per period (or for the ``only`` one): teachers in base, first seen, already seen, active, hours,
    median/mean minutes among the active, and share of all hours of the period."""
    # one scan: teachers and totals from one row per user and period
    teacher = F.col("population") == TEACHERS
    every = usage.groupBy("user_id", "period_index").agg(
        dsum0(F.when(teacher, F.col("hours")), cfg).alias("h"), F.max(teacher).alias("teacher"),
        F.sum(F.col("hours").cast(cfg.sum_type)).alias("s"))
    first = F.min("period_index").over(Window.partitionBy("user_id"))
    uh = (every.where(F.col("teacher") & F.col("user_id").isNotNull())
          .select("user_id", "period_index", "h", (F.col("period_index") == first).alias("is_first")))
    if only is not None:
        uh, every, periods = (df.where(F.col("period_index") == only) for df in (uh, every, periods))
    h = F.col("h")
    a = F.when(h > 0, h)
    g = uh.groupBy("period_index").agg(
        F.count(F.lit(1)).alias("in_base"), count_if(F.col("is_first")).alias("first_seen"),
        count_if(h > 0).alias("active"), dsum0(h, cfg).alias("hours"),
        (ratio(dsum(a, cfg), count_if(h > 0)) * 60).alias("mean_min_active"))
    med = quantile_columns(uh.where(h > 0), "h", {"median_active": 0.5}, ["period_index"], cfg)
    g = g.join(med, "period_index", "left").withColumn("median_min_active", F.col("median_active") * 60)
    tot = every.groupBy("period_index").agg(F.coalesce(F.sum("s").cast("double"), F.lit(0.0)).alias("total"))
    out = (periods.select("period_index", "label").join(g, "period_index", "left")
           .join(tot, "period_index", "left"))
    longs = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("in_base", "first_seen", "active")]
    return out.select(
        "period_index", "label", *longs,
        (F.coalesce(F.col("in_base"), F.lit(0)) - F.coalesce(F.col("first_seen"), F.lit(0))).cast("long")
        .alias("already_seen"),
        r6(F.coalesce(F.col("hours"), F.lit(0.0))).alias("hours"),
        r6("median_min_active").alias("median_min_active"), r6("mean_min_active").alias("mean_min_active"),
        r6(F.when(F.col("total") != 0, F.coalesce(F.col("hours"), F.lit(0.0)) / F.col("total") * 100))
        .alias("pct_platform_hours"))


def pop_current_row(usage: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """The row of the current period; the latest period when there is no current."""
    cur = periods.where(F.col("side") == "cur").select("period_index")
    fallback = periods.agg(F.max("period_index")).scalar()
    return pop_by_period(usage, periods, cfg, F.coalesce(cur.scalar(), fallback))


def pop_by_brand(cur: DataFrame, cfg: Config) -> DataFrame:
    """Current period, reported brands with teachers: users, active users, hours."""
    uh = (_teachers(cur).where(F.col("user_id").isNotNull()).groupBy("brand", "user_id")
          .agg(dsum0("hours", cfg).alias("h")))
    g = uh.groupBy("brand").agg(F.count(F.lit(1)).alias("in_base"), count_if(F.col("h") > 0).alias("active"),
                                dsum0("h", cfg).alias("hours"))
    return g.where(F.col("brand").isin(list(cfg.reported_brands))).select(
        "brand", F.col("in_base").cast("long"), F.col("active").cast("long"), r6("hours").alias("hours"))


def pop_courses(cur: DataFrame, cfg: Config) -> DataFrame:
    """Current period: per course, distinct consuming teachers and their hours."""
    c = _teachers(cur).where(F.col("hours") > 0)
    g = c.groupBy("course_id").agg(
        F.max(F.struct("period_index", "course_name")).getField("course_name").alias("course_name"),
        F.count_distinct("user_id").alias("teachers"), dsum0("hours", cfg).alias("hours"))
    return g.select("course_id", "course_name", F.col("teachers").cast("long"), r6("hours").alias("hours"))


def pop_active_ever(usage: DataFrame) -> DataFrame:
    """Distinct teachers with hours > 0 in any period."""
    return (_teachers(usage).where(F.col("hours") > 0)
            .agg(F.count_distinct("user_id").cast("long").alias("active_ever")))


def _teacher_hours(usage: DataFrame, cfg: Config, *counts: Column) -> DataFrame:
    """Per (brand, user) over all periods: hours of consuming rows, and the counts asked for."""
    c = _teachers(usage).where((F.col("hours") > 0) & F.col("user_id").isNotNull())
    return c.groupBy("user_id", "brand").agg(
        dsum0("hours", cfg).alias("hours"), *counts)


def pop_panel_by_brand(usage: DataFrame, cfg: Config) -> DataFrame:
    """All periods, per reported brand: teachers in base, active, hours, median
    minutes, % active, hours per active, % of hours over all brands."""
    t = _teachers(usage).where(F.col("user_id").isNotNull())
    base = t.groupBy("brand").agg(F.count_distinct("user_id").alias("in_base"))
    uh = _teacher_hours(usage, cfg)
    pm = (uh.groupBy("brand").agg(F.count(F.lit(1)).alias("active"), dsum0("hours", cfg).alias("hours"))
          .join(quantile_columns(uh, "hours", {"median_h": 0.5}, ["brand"], cfg), "brand", "left")
          .withColumn("median_min", F.col("median_h") * 60))
    out = base.join(pm, "brand", "left").select(
        "brand", "in_base", F.coalesce("active", F.lit(0)).alias("active"),
        F.coalesce("hours", F.lit(0.0)).alias("hours"), "median_min")
    all_hours = uh.agg(dsum0("hours", cfg)).scalar()
    out = out.where(F.col("brand").isin(list(cfg.reported_brands)))
    return out.select(
        "brand", F.col("in_base").cast("long"), F.col("active").cast("long"), r6("hours").alias("hours"),
        r6("median_min").alias("median_min"),
        r6(ratio(F.col("active"), F.col("in_base")) * 100).alias("pct_active"),
        r6(ratio(F.col("hours"), F.col("active"))).alias("hours_per_active"),
        r6(F.when(all_hours != 0, F.col("hours") / all_hours * 100)).alias("pct_hours"))


def pop_ranking(usage: DataFrame, cfg: Config, n: int | None = None) -> DataFrame:
    """Top n teachers by hours (ties by user): courses, periods, rank and a short code."""
    n = n or cfg.teacher_top
    counts = [F.count_distinct(c).alias(n) for c, n in (("course_id", "courses"), ("period_index", "periods"))]
    top = _teacher_hours(usage, cfg, *counts).orderBy(F.col("hours").desc(), "user_id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.col("hours").desc(), "user_id"))   # n rows
    return top.select("user_id", "brand", r6("hours").alias("hours"), F.col("courses").cast("long"),
                      F.col("periods").cast("long"), rank.cast("long").alias("rank")).withColumn(
        "code", C.pseudonym_code(F.col("rank"), F.col("brand"), F.col("user_id")))


def pop_summary(usage: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """Teachers in base and active, hours, median/mean minutes, top-10% share of
    hours among active teachers, and the periods with teachers."""
    t = _teachers(usage)
    uh = _teacher_hours(usage, cfg)
    in_base = t.agg(F.count_distinct("user_id")).scalar()
    t10 = top_share(t.where(F.col("hours") > 0), cfg, pcts=(0.10,)).select("share").scalar()
    labels = (t.select("period_index").distinct()
              .join(F.broadcast(periods.select("period_index", "label")), "period_index")
              .agg(F.array_sort(F.collect_list(F.struct("period_index", "label"))).alias("p"))
              .select(F.transform("p", lambda x: x["label"]).alias("periods")).scalar())
    med = quantile_columns(uh, "hours", {"m": 0.5}, (), cfg).select("m").scalar()
    one = uh.agg(F.count(F.lit(1)).cast("long").alias("active"), dsum0("hours", cfg).alias("hours"),
                 (ratio(dsum("hours", cfg), F.count(F.lit(1))) * 60).alias("mean_min"))
    return one.select(in_base.cast("long").alias("in_base"), "active", r6("hours").alias("hours"),
                      r6(med * 60).alias("median_min"), r6("mean_min").alias("mean_min"),
                      t10.alias("top10_share"), labels.alias("periods"))


def pop_panel_courses(usage: DataFrame, cfg: Config) -> DataFrame:
    """All periods, per course: consuming teachers, hours, % of active teachers."""
    c = _teachers(usage).where(F.col("hours") > 0)
    n_active = c.where(F.col("user_id").isNotNull()).agg(F.count_distinct("user_id")).scalar()
    g = c.groupBy("course_id").agg(
        F.max(F.struct("period_index", "course_name")).getField("course_name").alias("course_name"),
        F.count_distinct("user_id").alias("teachers"), dsum0("hours", cfg).alias("hours"))
    return g.select("course_id", "course_name", F.col("teachers").cast("long"), r6("hours").alias("hours"),
                    r6(F.col("teachers") / F.greatest(n_active, F.lit(1)) * 100).alias("pct_teachers"))
