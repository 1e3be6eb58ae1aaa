"""Retention lift of courses: base retention, weighted and pooled lift, gateway courses.

A course's consumers in period t "return" when they are active (any course)
in the next listed period. The "return" flag is computed once per active
(user, period) by a lead over the user-partitioned panel and then joined to
the (course, user, period) consumers on (user_id, period_index): an equi join
on a high-cardinality key, so no per-course user sets are ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.aggs import count_if, r6, ratio, row_hours
from .catalog import course_names
from .panel import active_flags


def retention_base(panel: DataFrame, periods: DataFrame) -> DataFrame:
    """Per transition t -> t+1 (all but the last period): active in both / active in t."""
    f = active_flags(panel)
    g = f.groupBy("pos").agg(F.count(F.lit(1)).alias("active"),
                             count_if(F.col("returns_next")).alias("both_active"))
    out = (periods.where(F.col("pos") < F.col("max_pos")).select("period_index", "label", "pos")
           .join(g, "pos", "left")
           .select("period_index", "label", "pos",
                   F.coalesce("active", F.lit(0)).cast("long").alias("active"),
                   F.coalesce("both_active", F.lit(0)).cast("long").alias("both_active")))
    return out.withColumn("base", ratio("both_active", "active"))


def retention_base_pooled(panel: DataFrame) -> DataFrame:
    """One row: 100 * sum(both) / sum(active) over all transitions; 0 when none."""
    f = active_flags(panel).where(F.col("pos") < F.col("max_pos"))
    return f.agg(F.coalesce(ratio(count_if(F.col("returns_next")), F.count(F.lit(1))) * 100,
                            F.lit(0.0)).alias("base_pct"))


def consumer_returns(usage: DataFrame, panel: DataFrame) -> DataFrame:
    """(course_id, pos, n, returned): distinct consumers (hours>0) per course and
    period before the last, and how many of them are active next period."""
    cons = (usage.where((F.col("hours") > 0) & F.col("user_id").isNotNull())
            .select("course_id", "user_id", "period_index").distinct())
    f = active_flags(panel).where(F.col("pos") < F.col("max_pos")).select(
        "user_id", "period_index", "pos", "returns_next")
    return (cons.join(f, ["user_id", "period_index"])
            .groupBy("course_id", "pos")
            .agg(F.count(F.lit(1)).alias("n"), count_if(F.col("returns_next")).alias("returned")))


def lift_weighted(usage: DataFrame, panel: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """Per course: consumer-weighted mean return and lift over course-periods with
    at least ``min_consumers`` consumers. lift_pp = (return - base) * 100."""
    per = consumer_returns(usage, panel).where(F.col("n") >= cfg.min_consumers)
    base = retention_base(panel, periods).select("pos", "base")
    per = per.join(F.broadcast(base), "pos").withColumn(
        "lift_pp", (F.col("returned") / F.col("n") - F.col("base")) * 100)
    g = (per.groupBy("course_id")
         .agg(F.sum("n").cast("long").alias("n_total"),
              (F.sum("returned") / F.sum("n")).alias("return_mean"),
              (F.sum(F.col("lift_pp") * F.col("n")) / F.sum("n")).alias("lift_pp"))
         .where(F.col("n_total") >= cfg.min_consumers))
    return (g.join(course_names(usage), "course_id")
            .select("course_id", "course_name", "n_total",
                    r6("return_mean").alias("return_mean"), r6("lift_pp").alias("lift_pp")))


def lift_pooled(usage: DataFrame, panel: DataFrame, cfg: Config) -> DataFrame:
    """Per course, pooled over all transitions: observed return vs the pooled base.

    den = sum of distinct consumers over every period but the last, num = those
    active next period; kept when den >= ``min_transitions``. Percentages are
    rounded half-even to 1 decimal; lift is rounded from the unrounded values.
    """
    g = (consumer_returns(usage, panel).groupBy("course_id")
         .agg(F.sum("n").cast("long").alias("n_user_transitions"),
              F.sum("returned").cast("long").alias("returned"))
         .where(F.col("n_user_transitions") >= cfg.min_transitions))
    base = retention_base_pooled(panel).scalar()
    obs = 100 * F.col("returned") / F.col("n_user_transitions")
    return (g.join(course_names(usage), "course_id")
            .select("course_id", "course_name", "n_user_transitions",
                    F.bround(obs, 1).alias("retention_obs_pct"),
                    F.bround(base, 1).alias("retention_expected_pct"),
                    F.bround(obs - base, 1).alias("lift_pp")))


def bridge_deadend(lift: DataFrame, cfg: Config, n: int | None = None) -> DataFrame:
    """Top n courses with positive lift and bottom n with negative lift."""
    n = n or cfg.top_n
    top = (lift.where(F.col("lift_pp") > 0)
           .orderBy(F.col("lift_pp").desc(), F.col("n_user_transitions").desc(), F.col("course_id"))
           .limit(n).withColumn("kind", F.lit("bridge")))
    bottom = (lift.where(F.col("lift_pp") < 0)
              .orderBy(F.col("lift_pp"), F.col("n_user_transitions"), F.col("course_id").desc())
              .limit(n).withColumn("kind", F.lit("dead_end")))
    return top.unionByName(bottom)


def gateway_courses(usage: DataFrame, panel: DataFrame, cfg: Config) -> DataFrame:
    """Courses new users start with, and how often those users come back.

    For every user, in the first period they are active (the last period
    excluded) the row with most hours picks the start course (ties: smallest
    course id). Per course: starters, returned next period, observed return and
    lift against the pooled base; kept when starters >= ``min_starters``.
    """
    firsts = (active_flags(panel)
              .where(F.col("is_new") & (F.col("pos") < F.col("max_pos")))
              .select("user_id", "period_index", "returns_next"))
    rows = (usage.where(F.col("hours") > 0)
            .select("user_id", "period_index", "course_id", row_hours(usage).alias("hours"))
            .join(firsts, ["user_id", "period_index"]))
    pick = F.min(F.struct((-F.col("hours")).alias("neg_hours"), F.col("course_id").alias("course_id")))
    starts = (rows.groupBy("user_id")
              .agg(pick.alias("s"), F.max(F.col("returns_next").cast("int")).alias("ret"))
              .select(F.col("s.course_id").alias("course_id"), "ret"))
    g = (starts.groupBy("course_id")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("ret").cast("long").alias("returned"))
         .where(F.col("n") >= cfg.min_starters))
    base = retention_base_pooled(panel).scalar()
    obs = 100 * F.col("returned") / F.col("n")
    return (g.join(course_names(usage), "course_id")
            .select("course_id", "course_name", F.col("n").cast("long").alias("n"),
                    F.bround(obs, 1).alias("retention_obs_pct"),
                    F.bround(obs - base, 1).alias("lift_pp")))
