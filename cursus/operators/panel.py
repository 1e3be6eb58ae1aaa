"""User x period panel and the reports built on it: growth accounting and cohorts.

The panel holds at most one row per user and period, so every window
partitioned by user_id is bounded by the number of periods, however skewed
the raw usage is. Sets of users per period become windows over user_id
(first active position, previous/next active position); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.aggs import dsum0, r6, ratio
from .slicing import SLICE, panel_slices


def user_period_panel(usage: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """Per (user, period): hours, brand, population, list position, active flag.

    Rows with a missing user drop out, as group keys. Brand is a function of the
    user; population takes the smallest value for determinism.
    """
    g = (usage.where(F.col("user_id").isNotNull())
         .groupBy("user_id", "period_index")
         .agg(dsum0("hours", cfg).alias("hours"),
              F.min("brand").alias("brand"),
              F.min("population").alias("population")))
    dim = F.broadcast(periods.select("period_index", "pos", "label", "max_pos"))
    return g.join(dim, "period_index").withColumn("active", F.col("hours") > 0)


def active_flags(panel: DataFrame, keys=()) -> DataFrame:
    """Active panel rows with first-active, previous-active and next-active flags, of the user (in each group of keys)."""
    act = panel.where(F.col("active"))
    w_user = Window.partitionBy(*keys, "user_id")
    w = w_user.orderBy("pos")
    return act.select(
        *[k for k in keys if k not in ("brand", "population")], "user_id", "period_index", "pos", "label", "max_pos", "brand", "population", "hours",
        (F.min("pos").over(w_user)).alias("first_pos"),
        F.lag("pos").over(w).alias("prev_pos"),
        F.lead("pos").over(w).alias("next_pos"),
    ).withColumns({
        "is_new": F.col("pos") == F.col("first_pos"),
        "is_recurring": F.coalesce(F.col("prev_pos") == F.col("pos") - 1, F.lit(False)),
        "returns_next": F.coalesce(F.col("next_pos") == F.col("pos") + 1, F.lit(False)),
    })


def active_users(panel: DataFrame) -> DataFrame:
    """(period_index, label, user_id) of every user active in a period."""
    return panel.where(F.col("active")).select("period_index", "label", "user_id")


def _brand_grid(periods: DataFrame, cfg: Config) -> DataFrame:
    return periods.withColumn("brand", F.explode(F.array(*[F.lit(b) for b in cfg.reported_brands])))


GROWTH = ("new_users", "recurring", "reactivated", "total_active", "lost")


def _growth_events(f: DataFrame, keys) -> DataFrame:
    """(keys..., pos, measures): every active row at its own period and, when the user is not
    active in the next listed period, as lost at that next period."""
    new, rec = F.col("is_new"), F.col("is_recurring")
    lost = (~F.col("returns_next") & (F.col("pos") < F.col("max_pos"))).cast("int")
    none = {m: F.lit(0) for m in GROWTH}
    here = none | {"new_users": new.cast("int"), "recurring": rec.cast("int"), "reactivated": (~new & ~rec).cast("int"),
                   "total_active": F.lit(1)}
    rows = ((F.col("pos"), here), (F.col("pos") + 1, none | {"lost": lost}))
    return f.select(*keys, F.inline(F.array(*[F.struct(pos.alias("pos"), *[c.alias(m) for m, c in row.items()]) for pos, row in rows])))


def growth_accounting(panel: DataFrame, periods: DataFrame, cfg: Config, by_brand: bool = False) -> DataFrame:
    """Per listed period: new, recurring, reactivated, total active, lost.

    new = first active period; recurring = active now and in the previous
    listed period; reactivated = the rest; lost(t) = active at t-1, not at t.
    """
    keys = ["brand"] if by_brand else []
    events = _growth_events(active_flags(panel), keys)
    counts = events.groupBy(*keys, "pos").agg(*[F.sum(m).alias(m) for m in GROWTH])
    grid = _brand_grid(periods, cfg) if by_brand else periods
    out = (grid.select(*keys, "period_index", "pos", "label")
           .join(counts, keys + ["pos"], "left"))
    return out.select(*keys, "period_index", "label",
                      *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in GROWTH])


def growth_by_slice(panel: DataFrame, periods: DataFrame) -> DataFrame:
    """Growth of every slice of the panel (``slicing.panel_slices``), all from one job.

    A slice's users count by their rows in the slice: who is new in a brand may be known elsewhere. Every slice that
    has rows has every listed period.
    """
    events = _growth_events(active_flags(panel_slices(panel), SLICE), SLICE)
    # a row of zeros for each period of each slice, of which there are few
    present = panel_slices(panel.select("brand", "population", "max_pos").distinct()).distinct()
    zeros = present.select(*SLICE, F.explode(F.sequence(F.lit(0), "max_pos")).alias("pos"), *[F.lit(0).alias(m) for m in GROWTH])
    counts = events.unionByName(zeros).groupBy(*SLICE, "pos").agg(*[F.sum(m).cast("long").alias(m) for m in GROWTH])
    return counts.join(F.broadcast(periods.select("pos", "period_index", "label")), "pos").select(
        *SLICE, "period_index", "label", *GROWTH)


def recurring_pct(growth: DataFrame) -> DataFrame:
    """Recurring users as a share of all active users, 0 decimals, halves to the even neighbour."""
    return growth.withColumn("recurring_pct", F.bround(ratio("recurring", "total_active") * 100, 0))


def cohort_retention(panel: DataFrame, periods: DataFrame, cfg: Config) -> DataFrame:
    """Long-form retention triangle: (cohort, offset, n, active, rate).

    cohort = first active period; offset = list-position difference. Every
    cohort x offset cell of the upper triangle exists: zero when nobody
    returns, rate null when the cohort is empty.
    """
    act = panel.where(F.col("active"))
    first = F.min("pos").over(Window.partitionBy("user_id"))
    cells = (act.select("user_id", "pos", first.alias("cohort_pos"))
             .groupBy("cohort_pos", (F.col("pos") - F.col("cohort_pos")).alias("period_offset"))
             .agg(F.count(F.lit(1)).alias("active")))
    grid = periods.select(
        F.col("pos").alias("cohort_pos"), F.col("period_index").alias("cohort_index"),
        F.col("label").alias("cohort_label"),
        F.explode(F.sequence(F.lit(0), F.col("max_pos") - F.col("pos"))).alias("period_offset"))
    sizes = cells.where(F.col("period_offset") == 0).select("cohort_pos", F.col("active").alias("n"))
    out = (grid.join(cells, ["cohort_pos", "period_offset"], "left")
           .join(sizes, "cohort_pos", "left")
           .select("cohort_index", "cohort_label", F.col("period_offset").cast("int").alias("period_offset"),
                   F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                   F.coalesce("active", F.lit(0)).cast("long").alias("active")))
    return out.withColumn("rate", r6(ratio("active", "n")))
