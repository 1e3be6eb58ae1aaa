"""Exact quantiles without putting a group in one task.

``percentile`` is exact but merges a value -> count map per group in one
task, so a group holding a third of all users holds a third of all distinct
values there. ``exact_quantiles`` returns the same linear-interpolation
quantile (position (n-1)p between the two neighbouring order statistics) by
selection instead of sorting:

1. count per (group, log-scale bucket of the value, BUCKETS to an octave) and
   find, per target rank, the bucket holding it (windows run over bucket counts
   only, whose number is bounded by the range of doubles);
2. inside it (a sliver of the value range) count the distinct values and pick
   the one at the rank.

Every pass is a filter or equi join plus a partial + final aggregation; the
boundary tables are tiny and Spark decides at run time whether to broadcast
them (no unchecked broadcast hint). Null group keys form a group, as in
``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANKS = "_t"
#: Buckets of values between a number and its double.
BUCKETS = 8192


def _join_keys(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner equi join on ``cols`` treating null = null (group keys may be null)."""
    if not cols:
        raise ValueError("join keys required")
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols],
                     *[c for c in right.columns if c not in cols])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols]
    return left.join(r, cond).drop(*[f"_r_{c}" for c in cols])


def exact_quantiles(values: DataFrame, col: str, ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., p, q): exact linear-interpolation quantile of ``col`` per group.

    Equals ``percentile(col, p)`` per group; groups without values are absent.
    """
    k = list(keys)
    v = F.col("v")
    x = values.select(*k, F.col(col).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    mag = F.floor(F.log2(F.abs(v)) * BUCKETS) + 1100 * BUCKETS  # monotone in |v|, positive for any double
    x = x.withColumn("b1", F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("long"))

    # (1) bucket counts; n per group; two target ranks per p (floor and ceil of (n-1)p).
    l1 = x.groupBy(*k, "b1").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*k)
    before = F.coalesce(F.sum("c").over(group.orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(j).alias("j")) for p in ps for j in (0, 1)])
    l1 = (l1.withColumns({"n": F.sum("c").over(group), "before": before}).withColumn(_RANKS, F.explode(targets))
          .withColumns({"p": F.col(f"{_RANKS}.p"), "j": F.col(f"{_RANKS}.j")}).drop(_RANKS)
          .withColumn("pos", (F.col("n") - 1).cast("double") * F.col("p"))
          .withColumn("r", F.when(F.col("j") == 0, F.floor("pos")).otherwise(F.ceil("pos")).cast("long")))
    part = [*k, "p", "j"]
    b1 = l1.where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("c"))).select(
        *part, "r", "pos", "b1", "before")

    # (2) distinct values of the boundary bucket.
    x2 = _join_keys(x, b1, [*k, "b1"])
    l2 = x2.groupBy(*part, "r", "pos", "before", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*part).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    l2 = l2.withColumn("below", F.col("before") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    picked = l2.where((F.col("below") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("c"))).select(*part, "pos", "v")

    lo_v = F.max(F.when(F.col("j") == 0, v))
    hi_v = F.max(F.when(F.col("j") == 1, v))
    pos = F.max("pos")
    q = F.when(F.floor(pos) == F.ceil(pos), lo_v).otherwise(
        (F.ceil(pos) - pos) * lo_v + (pos - F.floor(pos)) * hi_v)
    return picked.groupBy(*k, "p").agg(q.alias("q"))


def quantile_columns(values: DataFrame, col: str, named: dict[str, float], keys: Sequence[str] = (),
                     cfg=None) -> DataFrame:
    """One row per group: keys and one column per name with quantile p of ``col``.

    Distributed exact selection by default; ``Config(distributed_quantiles=False)``
    uses ``percentile`` (one map per group) and ``approx_quantiles=True`` uses
    ``percentile_approx``.
    """
    from ..functions.aggs import quantile
    k = list(keys)
    if cfg is not None and (cfg.approx_quantiles or not cfg.distributed_quantiles):
        g = values.groupBy(*k) if k else values
        return g.agg(*[quantile(col, p, cfg).alias(n) for n, p in named.items()])
    q = exact_quantiles(values, col, sorted({float(p) for p in named.values()}), k)
    return q.groupBy(*k).agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n)
                               for n, p in named.items()])


def quantiles_all_and_active(values: DataFrame, col: str, named_all: dict[str, float],
                             named_act: dict[str, float], keys: Sequence[str] = (), cfg=None) -> DataFrame:
    """One row per group: quantiles of ``col`` over all rows (``named_all``) and
    over rows with ``col > 0`` (``named_act``), from one selection whose extra
    group key is the row set."""
    k = list(keys)
    v = F.col(col)
    sets = values.select(*k, F.explode(F.when(v > 0, F.array(F.lit("all"), F.lit("act")))
                                       .otherwise(F.array(F.lit("all")))).alias("_set"), col)
    ps = sorted({float(p) for p in (*named_all.values(), *named_act.values())})
    slot = {p: f"_q{i}" for i, p in enumerate(ps)}
    q = quantile_columns(sets, col, {slot[p]: p for p in ps}, [*k, "_set"], cfg)
    pick = ([F.max(F.when(F.col("_set") == "all", F.col(slot[float(p)]))).alias(n) for n, p in named_all.items()]
            + [F.max(F.when(F.col("_set") == "act", F.col(slot[float(p)]))).alias(n) for n, p in named_act.items()])
    return q.groupBy(*k).agg(*pick) if k else q.agg(*pick)
