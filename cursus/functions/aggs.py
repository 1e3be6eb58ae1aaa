"""Aggregate helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

DEFAULT_SUM_TYPE = "decimal(38,12)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dsum(x, cfg: Config | None = None) -> Column:
    """Order-independent sum of a double: exact decimal accumulation, then double.

    Double sums depend on the order rows arrive in; a decimal sum does not, so
    results are identical across partitionings and engines. All-null -> null.
    """
    t = cfg.sum_type if cfg is not None else DEFAULT_SUM_TYPE
    return F.sum(_c(x).cast(t)).cast("double")


def dsum0(x, cfg: Config | None = None) -> Column:
    """Like dsum but an empty or all-null group sums to 0, as in pandas."""
    return F.coalesce(dsum(x, cfg), F.lit(0.0))


def r6(x) -> Column:
    """Derived ratios are reported to 6 decimals."""
    return F.round(_c(x).cast("double"), 6)


def ratio(num, den) -> Column:
    """num/den as double; null when den is 0 or null (never raises under ANSI)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def quantile(x, p: float, cfg: Config | None = None) -> Column:
    """Exact linear-interpolation quantile, or approximate when configured.

    The exact form keeps a value->count map per group (partial aggregation
    merges the maps), which is bounded by the distinct values of the group.
    """
    if cfg is not None and cfg.approx_quantiles:
        return F.percentile_approx(_c(x), p, cfg.approx_accuracy).cast("double")
    return F.percentile(_c(x), F.lit(p)).cast("double")


def median(x, cfg: Config | None = None) -> Column:
    return quantile(x, 0.5, cfg)


def n_rows(df: DataFrame, cond: Column | None = None) -> Column:
    """Number of usage rows (for which ``cond`` holds); a rollup's row stands for as many as its ``rows`` say."""
    if "rows" not in df.columns:
        return F.count(F.lit(1)) if cond is None else count_if(cond)
    return F.coalesce(F.sum("rows" if cond is None else F.when(cond, F.col("rows"))), F.lit(0).cast("long"))


def row_mean(df: DataFrame, x: str) -> Column:
    """Mean of a whole-numbered column over usage rows."""
    if "rows" not in df.columns:
        return F.avg(x)
    known = F.when(F.col(x).isNotNull(), F.col("rows"))
    return ratio(F.sum(F.col(x) * F.col("rows")), F.sum(known))


def row_median(df: DataFrame, x: str, cfg: Config | None = None) -> Column:
    """Median of a column of few values over usage rows."""
    if "rows" not in df.columns:
        return median(x, cfg)
    return F.percentile(x, F.lit(0.5), F.col("rows")).cast("double")


def row_hours(df: DataFrame) -> Column:
    """Hours of one usage row; of a rollup's row, those of its largest."""
    return F.col("most_hours" if "most_hours" in df.columns else "hours")


def count_if(cond) -> Column:
    return F.count_if(_c(cond)).cast("long")
