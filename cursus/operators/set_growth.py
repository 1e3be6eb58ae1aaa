"""Growth accounting and cohorts from the index of user sets, without usage or panel.

The sets of a bucket of user numbers are one bitmap a period, so a group holds at most 4 KB times the number of
periods, whatever the users. A user is active in a period in which some row has hours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import r6, ratio


def _active(index: DataFrame, periods: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, pos, bits): the active users of each listed period."""
    dim = F.broadcast(periods.select("period_index", "pos"))
    return index.where("active").join(dim, "period_index").groupBy(*keys, "bucket", "pos").agg(F.bitmap_or_agg("bits").alias("bits"))


def growth_from_sets(index: DataFrame, periods: DataFrame, *keys: str) -> DataFrame:
    """What ``panel.growth_accounting`` gives, by ``keys`` (groups and periods in which somebody was active now or before).

    With U(t) the users active up to t: new = |U(t)| - |U(t-1)|, recurring = |A(t)| + |A(t-1)| - |A(t) or A(t-1)|,
    lost = |A(t-1)| - recurring; unions are running windows over the periods of a bucket.
    """
    w = Window.partitionBy(*keys, "bucket").orderBy("pos")
    union = lambda frame: F.bitmap_count(F.bitmap_or_agg("bits").over(frame))
    sizes = _active(index, periods, *keys).select(
        *keys, "bucket", "pos", F.bitmap_count("bits").alias("n"),
        union(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ever"), union(w.rangeBetween(-1, 0)).alias("two"))
    before = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag("n").over(w)).otherwise(F.lit(0))
    parts = sizes.select(*keys, "pos", "n", (F.col("ever") - F.lag("ever", 1, 0).over(w)).alias("new_users"),
                         (F.col("n") + before - F.col("two")).alias("recurring"))
    z = F.lit(0).cast("long")
    both = F.array(F.struct("pos", "new_users", "recurring", F.col("n").alias("total_active"), z.alias("gone")),
                   F.struct((F.col("pos") + 1).alias("pos"), z.alias("new_users"), z.alias("recurring"), z.alias("total_active"),
                            F.col("n").alias("gone")))
    g = parts.select(*keys, F.inline(both)).groupBy(*keys, "pos").agg(
        *[F.sum(c).alias(c) for c in ("new_users", "recurring", "total_active", "gone")])
    new, rec, total = (F.col(c) for c in ("new_users", "recurring", "total_active"))
    out = g.join(F.broadcast(periods.select("pos", "period_index", "label")), "pos")
    return out.select(*keys, "period_index", "label", new, rec, (total - new - rec).alias("reactivated"), total,
                      (F.col("gone") - rec).alias("lost"))


def _cohort_cells(bucket: pd.DataFrame) -> pd.DataFrame:
    """Users of one bucket by first active period and later period of activity."""
    b = bucket.sort_values("pos")
    pos = b["pos"].to_numpy()
    sets = np.stack([np.frombuffer(x, np.uint64) for x in b["bits"]])
    ever = np.bitwise_or.accumulate(sets)
    first = sets.copy()
    first[1:] &= ~ever[:-1]
    cells = [(pos[c], pos[t] - pos[c], n) for c in range(len(pos))
             for t, n in enumerate(np.bitwise_count(sets[c:] & first[c]).sum(axis=1), c) if n]
    return pd.DataFrame(cells, columns=["cohort_pos", "period_offset", "active"]).astype("int64")


def cohorts_from_sets(index: DataFrame, periods: DataFrame) -> DataFrame:
    """What ``panel.cohort_retention`` gives: every cohort and offset, zero when nobody came back."""
    cells = (_active(index, periods).groupBy("bucket")
             .applyInPandas(_cohort_cells, "cohort_pos long, period_offset long, active long")
             .groupBy("cohort_pos", "period_offset").agg(F.sum("active").alias("active")))
    grid = periods.select(
        F.col("pos").cast("long").alias("cohort_pos"), F.col("period_index").alias("cohort_index"), F.col("label").alias("cohort_label"),
        F.explode(F.sequence(F.lit(0).cast("long"), (F.col("max_pos") - F.col("pos")).cast("long"))).alias("period_offset"))
    # at most one row for each later period in a cohort's window
    n = F.max(F.when(F.col("period_offset") == 0, F.col("active"))).over(Window.partitionBy("cohort_pos"))
    out = grid.join(cells, ["cohort_pos", "period_offset"], "left").withColumn("n", F.coalesce(n, F.lit(0).cast("long")))
    return out.select("cohort_index", "cohort_label", F.col("period_offset").cast("int").alias("period_offset"), "n",
                      F.coalesce("active", F.lit(0).cast("long")).alias("active")).withColumn("rate", r6(ratio("active", "n")))
