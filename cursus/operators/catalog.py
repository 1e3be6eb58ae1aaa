"""Course catalogue, template and group breakdowns, rankings by course.

All are grouped aggregations over one period's usage (course, template,
center/level), combined by equi joins on the group key. Top-n lists use
``orderBy(...).limit(n)``, which Spark plans as a per-partition top-n merged
once (TakeOrderedAndProject), never a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.aggs import count_if, dsum, dsum0, n_rows, r6, ratio, row_mean, row_median
from .quantiles import quantile_columns, quantiles_all_and_active


def course_names(usage: DataFrame) -> DataFrame:
    """One name per course id: the latest period's (largest) name."""
    return (usage.groupBy("course_id")
            .agg(F.max(F.struct("period_index", "course_name")).alias("m"))
            .select("course_id", F.col("m.course_name").alias("course_name")))


def course_catalog(cur: DataFrame, prev: DataFrame | None, cfg: Config) -> DataFrame:
    """Per course: hours, enrolments, users, certificates, mean/median progress,
    template, creation date, hours per user, age vs the newest course, dormant
    flag and, with a previous period, its hours and the change."""
    g = (cur.groupBy("course_id").agg(
        F.max(F.struct("period_index", "course_name")).getField("course_name").alias("course_name"),
        dsum0("hours", cfg).alias("hours"),
        n_rows(cur).alias("enrolments"),
        F.count_distinct("user_id").alias("users"),
        n_rows(cur, F.col("certified")).alias("certificates"),
        row_mean(cur, "progress").alias("progress_mean"),
        row_median(cur, "progress", cfg).alias("progress_median"),
        F.min("template").alias("template"),
        F.min("course_created").alias("created")))
    newest = cur.groupBy("course_id").agg(F.min("course_created").alias("c")).agg(F.max("c")).scalar()
    g = g.withColumns({
        "hours_per_user": ratio(F.col("hours"), F.col("users")),
        "age_days": F.datediff(newest, F.col("created")),
        "dormant": F.col("hours") < cfg.dormant_hours,
    })
    if prev is not None:
        p = prev.groupBy("course_id").agg(dsum0("hours", cfg).alias("hours_prev"))
        g = (g.join(p, "course_id", "left")
             .withColumn("hours_prev", F.coalesce(F.col("hours_prev"), F.lit(0.0)))
             .withColumn("delta", F.col("hours") - F.col("hours_prev")))
    dbl = ("hours", "progress_mean", "progress_median", "hours_per_user", "hours_prev", "delta")
    return g.select(*[r6(c).alias(c) if c in dbl else
                      (F.col(c).cast("long").alias(c) if c in ("enrolments", "users", "certificates")
                       else F.col(c)) for c in g.columns])


def catalog_cohorts(catalog: DataFrame) -> DataFrame:
    """By creation month: courses, hours, summed users, dormant courses, hours per course."""
    return (catalog.where(F.col("created").isNotNull())
            .groupBy(F.trunc("created", "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("courses"), dsum0("hours").alias("hours"),
                 F.sum("users").cast("long").alias("users"), count_if(F.col("dormant")).alias("dormant"))
            .withColumn("hours_per_course", r6(F.col("hours") / F.col("courses")))
            .withColumn("hours", r6("hours")))


def catalog_summary(catalog: DataFrame, cfg: Config) -> DataFrame:
    """Course count, dormant count, total hours, share of the top 5 / top 10 courses,
    mean and median hours per course."""
    tot = catalog.agg(dsum0("hours", cfg)).scalar()

    def top(k):
        return catalog.orderBy(F.col("hours").desc()).limit(k).agg(dsum0("hours", cfg)).scalar()

    one = catalog.agg(F.count(F.lit(1)).alias("courses"), count_if(F.col("dormant")).alias("dormant"),
                      dsum0("hours", cfg).alias("hours_total"),
                      ratio(dsum("hours", cfg), F.count(F.lit(1))).alias("hours_mean"))
    one = one.withColumn("hours_median", quantile_columns(catalog, "hours", {"m": 0.5}, [], cfg).select("m").scalar())
    one = one.withColumns({"share_top5": F.when(tot != 0, top(5) / tot * 100),
                           "share_top10": F.when(tot != 0, top(10) / tot * 100)})
    return one.select(F.col("courses").cast("long"), F.col("dormant").cast("long"),
                      *[r6(c).alias(c) for c in ("hours_total", "share_top5", "share_top10",
                                                 "hours_mean", "hours_median")])


def template_performance(cur: DataFrame, cfg: Config) -> DataFrame:
    """Per template: hours, enrolments, users, courses, hours per enrolment, median
    per-user hours, % of (user, course) max progress below 20 and at or above 80."""
    # one scan: everything derives from one row per template, user and course
    u = (cur.where(F.col("template").isNotNull()).groupBy("template", "user_id", "course_id")
         .agg(F.sum(F.col("hours").cast(cfg.sum_type)).alias("s"), n_rows(cur).alias("n"), F.max("progress").alias("p")))
    pair = F.col("p").isNotNull() & F.col("user_id").isNotNull()
    total = F.coalesce(F.sum("s").cast("double"), F.lit(0.0))
    g = u.groupBy("template").agg(
        total.alias("hours"), F.sum("n").alias("enrolments"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("course_id").alias("courses"),
        (ratio(count_if(pair & (F.col("p") < 20)), count_if(pair)) * 100).alias("pct_below20"),
        (ratio(count_if(pair & (F.col("p") >= 80)), count_if(pair)) * 100).alias("pct_at_least80"))
    per_user = quantile_columns(u.where(F.col("user_id").isNotNull()).groupBy("template", "user_id").agg(total.alias("h")),
                                "h", {"hours_per_user_median": 0.5}, ["template"], cfg)
    out = g.join(per_user, "template", "left")
    return out.select("template", r6("hours").alias("hours"), F.col("enrolments").cast("long"),
                      F.col("users").cast("long"), F.col("courses").cast("long"),
                      r6(F.col("hours") / F.col("enrolments")).alias("hours_per_enrolment"),
                      r6("hours_per_user_median").alias("hours_per_user_median"),
                      r6("pct_below20").alias("pct_below20"), r6("pct_at_least80").alias("pct_at_least80"))


def group_breakdown(cur: DataFrame, roster: DataFrame | None, columns: tuple[str, ...], cfg: Config) -> DataFrame:
    """Per value of each column (center, level): users, hours, mean/median per user,
    activated users and share, mean/median of the activated, users with a
    certificate and, with a roster, licences and the shares of them enrolled and
    effective. One pass for all columns: the column's name is a group key."""
    key = ["group_column", "group_value"]

    def stacked(df, *others):
        pairs = F.array(*[F.struct(F.lit(c).alias("group_column"), F.col(c).alias("group_value")) for c in columns])
        return df.select(F.inline(pairs), *others).where(F.col("group_value").isNotNull())

    uh = (stacked(cur.where(F.col("user_id").isNotNull()), "user_id", "hours", "certified").groupBy(*key, "user_id")
          .agg(dsum0("hours", cfg).alias("h"), F.max(F.col("certified").cast("int")).alias("cert")))
    h = F.col("h")
    act = F.when(h > 0, h)
    g = uh.groupBy(*key).agg(
        F.count(F.lit(1)).alias("users"), dsum0(h, cfg).alias("hours"),
        ratio(dsum(h, cfg), F.count(F.lit(1))).alias("mean"),
        count_if(h > 0).alias("activated"),
        ratio(dsum(act, cfg), count_if(h > 0)).alias("mean_act"),
        count_if(F.col("cert") == 1).alias("users_with_cert"))
    g = g.join(quantiles_all_and_active(uh, "h", {"median": 0.5}, {"median_act": 0.5}, key, cfg), key, "left")
    g = g.withColumn("pct_activated", ratio(F.col("activated"), F.col("users")) * 100)
    cols = ["group_value", "group_column",
            F.col("users").cast("long"), r6("hours").alias("hours"), r6("mean").alias("mean"),
            r6("median").alias("median"), F.col("activated").cast("long"), r6("pct_activated").alias("pct_activated"),
            r6("mean_act").alias("mean_act"), r6("median_act").alias("median_act"),
            F.col("users_with_cert").cast("long")]
    if roster is not None:
        lic = stacked(roster, "user_id").groupBy(*key).agg(F.count_distinct("user_id").alias("licences"))
        g = g.join(lic, key, "left")
        cols += [F.col("licences").cast("long"),
                 r6(ratio(F.col("users"), F.col("licences")) * 100).alias("pct_licence_enrolled"),
                 r6(ratio(F.col("activated"), F.col("licences")) * 100).alias("pct_licence_effective")]
    return g.select(*cols)


# ---------------------------------------------------------------- rankings
def course_hours_delta(sides: DataFrame, cfg: Config) -> DataFrame:
    """Hours per course now and before (missing = 0) and the change, one pass
    with conditional sums instead of a full outer join."""
    s = F.col("side")
    g = sides.groupBy("course_id").agg(
        F.max(F.struct("period_index", "course_name")).getField("course_name").alias("course_name"),
        dsum0(F.when(s == "cur", F.col("hours")), cfg).alias("hours_cur"),
        dsum0(F.when(s == "prev", F.col("hours")), cfg).alias("hours_prev"))
    return g.withColumn("delta", F.col("hours_cur") - F.col("hours_prev")).select(
        "course_id", "course_name", *[r6(c).alias(c) for c in ("hours_cur", "hours_prev", "delta")])


def top_courses_hours(delta: DataFrame, cfg: Config, n: int | None = None) -> DataFrame:
    return delta.orderBy(F.col("hours_cur").desc(), "course_id").limit(n or cfg.top_n)


def top_gainers(delta: DataFrame, cfg: Config, n: int | None = None) -> DataFrame:
    return (delta.where(F.col("hours_prev") >= 1)
            .orderBy(F.col("delta").desc(), "course_id").limit(n or cfg.top_n))


def top_losers(delta: DataFrame, cfg: Config, n: int | None = None) -> DataFrame:
    return delta.where(F.col("hours_prev") >= 1).orderBy(F.col("delta"), "course_id").limit(n or cfg.top_n)


def course_users(sides: DataFrame, cfg: Config) -> DataFrame:
    """Courses with at least one consuming user now: distinct consumers and their
    hours now and before (0 when none), and the change in consumers."""
    s = F.col("side")
    c = sides.where(F.col("hours") > 0)
    g = c.groupBy("course_id").agg(
        F.max(F.when(s == "cur", F.struct("period_index", "course_name"))).getField("course_name")
        .alias("course_name"),
        F.count_distinct(F.when(s == "cur", F.col("user_id"))).alias("users_cur"),
        dsum(F.when(s == "cur", F.col("hours")), cfg).alias("hours_cur"),
        F.count_distinct(F.when(s == "prev", F.col("user_id"))).alias("users_prev"),
        dsum0(F.when(s == "prev", F.col("hours")), cfg).alias("hours_prev"))
    g = g.where(F.col("users_cur") > 0)
    return g.select("course_id", "course_name", F.col("users_cur").cast("long"), r6("hours_cur").alias("hours_cur"),
                    F.col("users_prev").cast("long"), r6("hours_prev").alias("hours_prev"),
                    (F.col("users_cur") - F.col("users_prev")).cast("long").alias("delta_users"))


def course_users_summary(cu: DataFrame, cfg: Config) -> DataFrame:
    """Number of courses, median consumers per course, courses with exactly one."""
    users = cu.select(F.col("users_cur").cast("double").alias("users"))
    half = quantile_columns(users, "users", {"m": 0.5}, [], cfg).select("m").scalar()
    one = cu.agg(F.count(F.lit(1)).cast("long").alias("courses"), count_if(F.col("users_cur") == 1).alias("single_user_courses"))
    return one.select("courses", r6(half).alias("median_users"), "single_user_courses")


def course_users_extremes(cu: DataFrame, cfg: Config, n: int | None = None) -> DataFrame:
    """Top n and bottom n of the consumer ranking (users desc, course id asc)."""
    n = n or cfg.top_n
    top = cu.orderBy(F.col("users_cur").desc(), "course_id").limit(n).withColumn("kind", F.lit("top"))
    bottom = cu.orderBy(F.col("users_cur"), F.col("course_id").desc()).limit(n).withColumn("kind", F.lit("bottom"))
    return top.unionByName(bottom)
