"""Cleaning of usage and roster frames: test accounts out, brand/center/level/population in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import columns as C


def clean_users(df: DataFrame, cfg: Config) -> DataFrame:
    """Drop test accounts and derive brand, center, level and population.

    Works on any frame with a ``user_id`` column; ``center`` and ``level`` are
    optional (a missing level means everyone is a student unless a population
    column is already present).
    """
    cols = set(df.columns)
    out = df.where(~C.is_test_account(F.col("user_id"), cfg))
    derived = {
        "brand": C.brand_of(F.col("user_id"), cfg),
        "center": C.fill_center(F.col("center") if "center" in cols else None, F.col("user_id"), cfg),
    }
    if "level" in cols:
        derived["level"] = C.normalise_level(F.col("level"), cfg)
        derived["population"] = C.population(derived["level"])
    elif "population" not in cols:
        derived["population"] = F.lit("Alumnos")
    return out.withColumns(derived)


def with_usage_measures(usage: DataFrame, cfg: Config) -> DataFrame:
    """Per-row derived measures used by many reports: progress value and cert flag."""
    return usage.withColumns({
        "progress": C.progress_value(F.col("progress_band"), cfg),
        "certified": C.cert_flag(F.col("certified_raw")),
    })
