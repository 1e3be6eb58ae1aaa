"""Slices of the base: brand and population filters, the one-pass slice cube,
and the reported brands present.

Filters are plain predicates on columns of the usage table, so Catalyst
pushes them into the Parquet scan. The cube computes the report for total,
each brand, each population and each brand x population in one aggregation
(Expand + one shuffle) instead of one job per slice; distinct users are made
additive by pre-aggregating to one row per user first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.aggs import count_if, dsum0, r6


def filter_brand(df: DataFrame, brands=None) -> DataFrame:
    """No brands: unchanged; else rows whose brand is in the list."""
    if not brands:
        return df
    return df.where(F.col("brand").isin(list(brands)))


def filter_population(df: DataFrame, population: str | None = None) -> DataFrame:
    if not population or "population" not in df.columns:
        return df
    return df.where(F.col("population") == population)


def slice_cube(usage: DataFrame, cfg: Config) -> DataFrame:
    """Users, activated users and hours for every (brand, population) roll-up."""
    pu = (usage.where(F.col("user_id").isNotNull()).groupBy("brand", "population", "user_id")
          .agg(dsum0("hours", cfg).alias("h")))
    g = pu.cube("brand", "population").agg(
        F.grouping_id().cast("int").alias("slice_id"), F.count(F.lit(1)).cast("long").alias("users"),
        count_if(F.col("h") > 0).alias("activated"), dsum0("h", cfg).alias("hours"))
    return g.select("brand", "population", "slice_id", "users", "activated", r6("hours").alias("hours"))


SLICE = ("slice_id", "brand", "population")


def _slices():
    """The four slices of a row's brand and population."""
    null = F.lit(None).cast("string")
    return F.array(*[F.struct(F.lit(i).alias("slice_id"), (null if i & 2 else F.col("brand")).alias("brand"),
                              (null if i & 1 else F.col("population")).alias("population")) for i in range(4)])


def user_slices(usage: DataFrame, cfg: Config) -> DataFrame:
    """A user's hours in each slice that the user is in: (slice_id, brand, population, user_id, hours).

    A user's rows of one brand and population are summed first, then put into the four slices they belong to:
    slice_id 0 both, 1 brand, 2 population, 3 total, as ``grouping_id`` numbers them; what a slice does not fix is null.
    So medians and distinct users of all slices come from one job over at most four rows a user, brand and population.
    """
    pu = (usage.where(F.col("user_id").isNotNull()).groupBy("brand", "population", "user_id")
          .agg(F.sum(F.col("hours").cast(cfg.sum_type)).cast(cfg.sum_type).alias("hours")))
    return pu.select(F.inline(_slices()), "user_id", "hours")


def panel_slices(panel: DataFrame) -> DataFrame:
    """The panel's rows in each slice they belong to, as in ``user_slices``."""
    return panel.select(*[c for c in panel.columns if c not in SLICE], F.inline(_slices()))


def brands_present(panel: DataFrame, cfg: Config) -> DataFrame:
    """Reported brands that occur in the panel, with their fixed order."""
    arr = F.array(*[F.struct(F.lit(b).alias("brand"), F.lit(i).alias("ord")) for i, b in enumerate(cfg.reported_brands)])
    dim = panel.sparkSession.range(1).select(F.inline(arr))
    present = panel.select("brand").distinct()
    return dim.join(present, "brand", "left_semi")
