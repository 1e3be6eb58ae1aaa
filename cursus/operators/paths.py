"""Learning-path reports: match catalogue courses to a text list of target courses,
then progress per target and coverage per user.

A course matches the target whose normalised form equals its own, or else the
first target in list order whose form its own contains. The targets are a small
table. Each target is looked for by one of its grams, the one that fewest
targets hold; a course's form holds the grams of all targets that it contains,
so candidates come from an equi join on grams and are then tested. The plan is
the same for two targets and for thousands. Names are normalised and matched
once each; usage rows get their target by an equi join on the name.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.aggs import count_if, dsum0, median, n_rows, r6, ratio, row_mean, row_median
from .quantiles import quantile_columns
from ..functions.names import normalise_name, normalise_text


BROADCAST = 100_000  # targets
GRAM = 6  # characters of a gram; a shorter target is a gram of its own


def _target_rows(cfg: Config) -> list[tuple[str, str, int, int, str]]:
    """(form, target, place of the form, order of the target, gram); forms in first-seen order, later names of a form win."""
    form: dict[str, str] = {}
    for t in cfg.path_targets:
        form[normalise_text(t)] = t
    order = {t: i for i, t in enumerate(cfg.path_targets)}
    grams = {k: [k[i:i + GRAM] for i in range(max(len(k) - GRAM, 0) + 1)] for k in form}
    held = Counter(g for some in grams.values() for g in set(some))
    return [(k, t, place, order[t], min(grams[k], key=lambda g: held[g])) for place, (k, t) in enumerate(form.items())]


def targets(spark: SparkSession, cfg: Config) -> DataFrame:
    """The target list as a table."""
    schema = "form string, target string, place int, target_order int, gram string"
    return spark.createDataFrame(_target_rows(cfg), schema).coalesce(1)


def _grams(form, lengths: list[int]):
    """Distinct parts of a form that have one of the lengths; the empty form has the empty one."""
    def of(n: int):
        cut = F.transform(F.sequence(F.lit(1), F.length(form) - n + 1), lambda i: F.substr(form, i, F.lit(n)))
        return F.when(F.length(form) >= n, cut).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in lengths if n]
    empty = F.when(form == "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(empty, *parts))


def path_match(usage: DataFrame, cfg: Config) -> DataFrame:
    """(course_name, normalised, target, target_order) for every distinct course name."""
    names = usage.select("course_name").where(F.col("course_name").isNotNull()).distinct()
    n = names.withColumn("normalised", normalise_name(F.col("course_name")))
    lengths = sorted({len(r[4]) for r in _target_rows(cfg)})
    # a configured list; beyond BROADCAST entries Spark chooses the join
    table = targets(usage.sparkSession, cfg)
    table = F.broadcast(table) if len(cfg.path_targets) <= BROADCAST else table
    tried = n.withColumn("gram", F.explode_outer(_grams(F.col("normalised"), lengths))).join(table, "gram", "left")
    exact = F.col("normalised") == F.col("form")
    fits = exact | ((F.col("form") != "") & F.col("normalised").contains(F.col("form")))
    best = F.min(F.when(fits, F.struct((~exact).alias("within"), "place", "target", "target_order")))
    return (tried.groupBy("course_name", "normalised").agg(best.alias("b"))
            .select("course_name", "normalised", F.col("b.target").alias("target"), F.col("b.target_order").alias("target_order")))


def on_path(usage: DataFrame, cfg: Config) -> DataFrame:
    """Usage rows whose course maps to a target, with the target."""
    m = path_match(usage, cfg).where(F.col("target").isNotNull()).select("course_name", "target", "target_order")
    return usage.join(m, "course_name")


def path_by_course(usage: DataFrame, cfg: Config) -> DataFrame:
    """Per target: users, hours, certificates, mean/median progress and the share of
    users whose max progress reached 90 (unknown counts as not done)."""
    e = on_path(usage, cfg)
    g = e.groupBy("target", "target_order").agg(
        F.count_distinct("user_id").alias("users"), dsum0("hours", cfg).alias("hours"),
        n_rows(e, F.col("certified")).alias("certificates"),
        row_mean(e, "progress").alias("progress_mean"), row_median(e, "progress", cfg).alias("progress_median"))
    done = (e.where(F.col("user_id").isNotNull()).groupBy("target", "user_id")
            .agg(F.max("progress").alias("p"))
            .groupBy("target").agg((ratio(count_if(F.col("p") >= 90), F.count(F.lit(1))) * 100)
                                   .alias("completed_pct")))
    out = g.join(done, "target", "left")
    return out.select("target", "target_order", F.col("users").cast("long"), r6("hours").alias("hours"),
                      F.col("certificates").cast("long"), r6("progress_mean").alias("progress_mean"),
                      r6("progress_median").alias("progress_median"), r6("completed_pct").alias("completed_pct"))


def path_users(usage: DataFrame, cfg: Config) -> DataFrame:
    """Per user on the path: targets consumed (hours>0), enrolled, completed, hours."""
    e = on_path(usage, cfg).where(F.col("user_id").isNotNull())
    ut = e.groupBy("user_id", "target").agg(
        F.max("progress").alias("p"), F.max((F.col("hours") > 0).cast("int")).alias("consumed"),
        dsum0("hours", cfg).alias("hours"))
    return ut.groupBy("user_id").agg(
        count_if(F.col("consumed") == 1).alias("consumed"), F.count(F.lit(1)).alias("enrolled"),
        count_if(F.col("p") >= 90).alias("completed"), dsum0("hours", cfg).alias("hours"))


def path_coverage(usage: DataFrame, cfg: Config) -> DataFrame:
    """One row: users on the path, mean/median of consumed, completed and enrolled
    targets, users completing every target, hours, users with consumption and the
    share of all hours of the slice."""
    pu = path_users(usage, cfg)
    total = usage.agg(dsum0("hours", cfg)).scalar()
    n_targets = len(cfg.path_targets)
    one = pu.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("consumed").alias("coverage_mean"), median(F.col("consumed").cast("double"), cfg).alias("coverage_median"),
        F.avg("completed").alias("completed_mean"),
        median(F.col("completed").cast("double"), cfg).alias("completed_median"),
        count_if(F.col("completed") >= n_targets).alias("finished_all"),
        ratio(F.sum(F.col("hours").cast(cfg.sum_type)), F.count(F.lit(1))).alias("hours_mean"),
        dsum0("hours", cfg).alias("hours_total"),
        F.avg("enrolled").alias("enrolled_mean"), median(F.col("enrolled").cast("double"), cfg).alias("enrolled_median"),
        count_if(F.col("consumed") > 0).alias("users_with_consumption"))
    hours_median = quantile_columns(pu, "hours", {"m": 0.5}, (), cfg).select("m").scalar()
    one = one.withColumns({"hours_median": hours_median,
                           "pct_platform_hours": F.when(total != 0, F.col("hours_total") / total * 100)})
    order = ("users", "coverage_mean", "coverage_median", "completed_mean", "completed_median", "finished_all",
             "hours_mean", "hours_median", "hours_total", "enrolled_mean", "enrolled_median",
             "users_with_consumption", "pct_platform_hours")
    longs = ("users", "finished_all", "users_with_consumption")
    return one.select(*[F.col(c).cast("long") if c in longs else r6(c).alias(c) for c in order])


def path_distributions(usage: DataFrame, cfg: Config) -> DataFrame:
    """Users by number of targets consumed and by number completed."""
    pu = path_users(usage, cfg)
    a = pu.groupBy(F.col("consumed").alias("n_targets")).agg(F.count(F.lit(1)).alias("users"))
    b = pu.groupBy(F.col("completed").alias("n_targets")).agg(F.count(F.lit(1)).alias("users"))
    return (a.withColumn("kind", F.lit("consumed")).unionByName(b.withColumn("kind", F.lit("completed")))
            .select("kind", F.col("n_targets").cast("long"), F.col("users").cast("long")))


def path_not_found(usage: DataFrame, cfg: Config) -> DataFrame:
    """Targets of the list that no course of the slice matches."""
    found = on_path(usage, cfg).select("target").distinct()
    every = _listed(usage.sparkSession, cfg)
    return every.join(found, "target", "left_anti")


def path_found(usage: DataFrame, cfg: Config) -> DataFrame:
    """One row: the number of targets of the list, and of those that some course of the slice matches."""
    found = on_path(usage, cfg).select("target").distinct().withColumn("hit", F.lit(1))
    return _listed(usage.sparkSession, cfg).join(found, "target", "left").agg(
        F.count(F.lit(1)).cast("long").alias("targets"), F.count("hit").cast("long").alias("found"))


def _listed(spark: SparkSession, cfg: Config) -> DataFrame:
    """Every entry of the target list with its place."""
    return spark.createDataFrame(list(enumerate(cfg.path_targets)), "target_order int, target string").select("target", "target_order").coalesce(1)
