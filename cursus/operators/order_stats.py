"""Quantiles and top-k sums of one column, per group, from one index of buckets.

The index has one row per (group, log-scale bucket of the value): how many values, their exact sum, and
what else is counted. Buckets are in the order of their values, so windows over the index alone say
in which bucket each wanted rank lies, for

* a quantile of all values: ranks floor and ceil of (n-1)p;
* a quantile of the positive values, which are the last ones in the order: the same, n - n_positive ranks on;
* the sum of the k = max(1, round-half-even(n*p)) largest: rank n-k, and the sums of the buckets above.

Then the values of those buckets alone are looked at, once for all ranks, as distinct values with their counts. So
a group's values are neither sorted nor brought to one task; index rows are bounded by the range of doubles. The
index of a larger group is the sum of its parts' (``merge_index``), so a stored index by period and slice serves any union
of them. Null values count nowhere; null keys are a group, as in ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .quantiles import BUCKETS, _join_keys


def bucket(v: Column) -> Column:
    """The bucket of a value: increasing, negative, zero or positive as the value is."""
    size = F.floor(F.log2(F.abs(v)) * BUCKETS) + 1100 * BUCKETS  # positive for any double
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def bucket_index(values: DataFrame, col: str, cfg: Config, keys: Sequence[str] = (), counts: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., b, c, s, counts...): values, exact sum, and values for which each condition holds, by bucket."""
    v = F.col(col).cast("double")
    return values.where(v.isNotNull()).groupBy(*keys, bucket(v).alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(v.cast(cfg.sum_type)).cast(cfg.sum_type).alias("s"),
        *[F.count_if(cond).alias(name) for name, cond in (counts or {}).items()])


def merge_index(index: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The index of fewer keys."""
    measures = [c for c in index.columns if c not in ("b", *keys) and index.schema[c].dataType.typeName() in ("long", "decimal")]
    return index.groupBy(*keys, "b").agg(*[F.sum(c).cast(index.schema[c].dataType).alias(c) for c in measures])


def order_stats(values: DataFrame, col: str, cfg: Config, keys: Sequence[str] = (), quantiles: dict[str, float] | None = None,
                positive_quantiles: dict[str, float] | None = None, top_sums: dict[str, float] | None = None,
                counts: dict[str, Column] | None = None, index: DataFrame | None = None) -> DataFrame:
    """One row per group: keys, n, n_positive, total, total_positive (decimals), counts, and what is named.

    ``index`` may be a stored ``bucket_index`` of the same values. Without keys there is always one row, else one for each group
    that has values.
    """
    own = {c: f"_key{i}" for i, c in enumerate(keys)}  # keys may be named as columns below
    idx = (bucket_index(values, col, cfg, keys, counts) if index is None else index).withColumnsRenamed(own)
    values = values.select(*[F.col(c).alias(a) for c, a in own.items()], F.col(col).cast("double").alias("v"))
    k, v = list(own.values()), F.col("v")
    named = {a: c for c, a in own.items()}
    extra = list(counts or {})
    measures = idx.groupBy(*k) if k else idx
    positive = F.col("b") > 0
    summary = measures.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in
          (("n", F.col("c")), ("n_positive", F.when(positive, F.col("c"))), *((x, F.col(x)) for x in extra))],
        F.sum("s").alias("total"), F.sum(F.when(positive, F.col("s"))).alias("total_positive"))

    wanted = ([(n, "all", p, j) for n, p in (quantiles or {}).items() for j in (0, 1)]
              + [(n, "positive", p, j) for n, p in (positive_quantiles or {}).items() for j in (0, 1)]
              + [(n, "top", p, 0) for n, p in (top_sums or {}).items()])
    if not wanted:
        return summary.withColumnsRenamed(named)
    target = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.lit(float(p)).alias("p"), F.lit(j).alias("j"))
                       for n, kind, p, j in wanted])
    group = Window.partitionBy(*k)
    running = group.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = idx.select(*k, "b", "c", "s").withColumns({
        "n": F.sum("c").over(group), "n_pos": F.coalesce(F.sum(F.when(positive, F.col("c"))).over(group), F.lit(0)),
        "before": F.sum("c").over(running) - F.col("c"),
        "above": (F.sum("s").over(group) - F.sum("s").over(running)).cast(cfg.sum_type)})
    members = F.when(F.col("kind") == "positive", F.col("n_pos")).otherwise(F.col("n"))
    largest = F.greatest(F.lit(1), F.bround(F.col("n").cast("double") * F.col("p"), 0)).cast("long")
    rank = F.when(F.col("kind") == "top", F.col("n") - F.col("k")).otherwise(
        F.col("n") - F.col("members") + F.when(F.col("j") == 0, F.floor("pos")).otherwise(F.ceil("pos")))
    placed = (placed.select("*", F.inline(target)).withColumn("members", members).where(F.col("members") > 0)
              .withColumns({"pos": (F.col("members") - 1).cast("double") * F.col("p"), "k": largest})
              .withColumn("r", rank.cast("long"))
              .where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("c"))))
    ranks = placed.select(*k, "b", "name", "kind", "j", "pos", "k", "r", "n", "before", "above")

    x = values.where(v.isNotNull()).withColumn("b", bucket(v))
    sliver = _join_keys(x, ranks.select(*k, "b").distinct(), [*k, "b"])
    sliver = sliver.groupBy(*k, "b", "v").agg(F.count(F.lit(1)).alias("c"), F.sum(v.cast(cfg.sum_type)).alias("s"))
    part = Window.partitionBy(*k, "name", "j").orderBy("v")
    below = part.rowsBetween(Window.unboundedPreceding, -1)
    beyond = part.rowsBetween(1, Window.unboundedFollowing)
    at = _join_keys(sliver, ranks, [*k, "b"]).withColumns({
        "below": F.col("before") + F.coalesce(F.sum("c").over(below), F.lit(0)),
        "larger": F.coalesce(F.sum("s").over(beyond), F.lit(0).cast(cfg.sum_type))})
    at = at.where((F.col("below") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("c")))
    # of the k largest, those equal to the value at the rank
    equal = F.col("below") + F.col("c") - F.col("r")
    top = (F.col("above") + F.col("larger") + (v * equal).cast(cfg.sum_type)).cast("double")
    lo, hi = (F.max(F.when(F.col("j") == j, v)) for j in (0, 1))
    pos = F.max("pos")
    value = F.when(F.max("kind") == "top", F.max(F.when(F.col("kind") == "top", top))).when(
        F.floor(pos) == F.ceil(pos), lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)
    found = at.groupBy(*k, "name").agg(value.alias("value"), F.max(F.when(F.col("kind") == "top", F.col("k"))).alias("k"))
    names = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in dict.fromkeys(w[0] for w in wanted)]
    if not k:
        return summary.withColumn("_s", found.agg(F.struct(*names).alias("s")).select("s").scalar()).select("*", "_s.*").drop("_s")
    found = found.groupBy(*k).agg(*names)
    mine = summary.select(*[F.col(c).alias(f"_l_{c}") if c in k else F.col(c) for c in summary.columns])
    cond = [F.col(f"_l_{c}").eqNullSafe(F.col(c)) for c in k]
    return mine.join(found, cond, "left").drop(*k).withColumnsRenamed({f"_l_{a}": c for a, c in named.items()})
