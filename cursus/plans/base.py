"""The base bundle: cleaned usage, daily series, roster, period dimension and panel.

Loaded once; every report is a lazy DataFrame over it. ``materialize=True``
writes usage partitioned by period_index to the shared checkpoint folder (so
"current"/"previous" reports prune to two partitions and a lost executor
recomputes from that table, not from the raw exports). Usage is then read once
more, for the rollups (``operators.rollups``): reports read the coarsest of them
that has their columns. The panel is made from the rollup by user and written
as a table bucketed by user_id, so growth, cohorts, lift and gateway
run their per-user windows on the stored partitioning without a shuffle.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions.clean import with_usage_measures
from ..operators.panel import user_period_panel
from ..operators.periods import periods_dim
from ..operators.rollups import LEVELS, coarser, level_of, pairs_by_period
from ..operators.user_sets import user_numbers, user_sets
from ..session import shared_dir
from ..sources import fixtures
from ..sources.sinks import by_period


@dataclass
class Base:
    cfg: Config
    usage: DataFrame
    daily: DataFrame | None
    roster: DataFrame | None
    periods: DataFrame
    _panel: DataFrame | None = field(default=None, repr=False)
    # The roster before any slice.
    whole_roster: DataFrame | None = field(default=None, repr=False)
    # True when usage/daily/roster are read back from written tables and the
    # panel is persisted (lineage starts at the shared folder).
    materialized: bool = False
    # Rollups of usage by level; empty for a lazy base.
    rollups: dict = field(default_factory=dict, repr=False)
    _user_sets: DataFrame | None = field(default=None, repr=False)
    _materialized_copy: "Base | None" = field(default=None, repr=False)

    def side(self, side: str) -> DataFrame:
        """Usage rows of the current or previous period (a broadcast semi join
        with the period dimension: dynamic partition pruning on a partitioned table)."""
        dim = F.broadcast(self.periods.where(F.col("side") == side).select("period_index"))
        return self.usage.join(dim, "period_index", "left_semi")

    @property
    def cur(self) -> DataFrame:
        return self.side("cur")

    @property
    def prev(self) -> DataFrame:
        return self.side("prev")

    def with_side(self, usage: DataFrame | None = None) -> DataFrame:
        """Usage rows of both sides, with a ``side`` column."""
        u = self.usage if usage is None else usage
        dim = F.broadcast(self.periods.where(F.col("side").isNotNull()).select("period_index", "side"))
        return u.join(dim, "period_index")

    def daily_with_side(self) -> DataFrame:
        """Daily rows of the current and previous periods, with a ``side`` column."""
        dim = F.broadcast(self.periods.where(F.col("side").isNotNull()).select("period_index", "side"))
        d = self.daily.withColumn("period_index", C.period_of_date(F.col("day"), self.cfg.grain))
        return d.join(dim, "period_index")

    @property
    def panel(self) -> DataFrame:
        if self._panel is None:
            self._panel = user_period_panel(self.usage, self.periods, self.cfg)
        return self._panel

    @property
    def user_sets(self) -> DataFrame:
        """The index of user sets: stored with a materialised base, else made from usage."""
        if self._user_sets is None:
            self._user_sets = user_sets(self.usage, user_numbers(self.usage))
        return self._user_sets

    def reading(self, columns) -> "Base":
        """The base with the coarsest rollup that has the columns in the place of usage, if there is one."""
        table = self.rollups.get(level_of(columns)) if columns is not None else None
        return self if table is None else replace(self, usage=table)

    def restrict(self, brands=None, population: str | None = None) -> "Base":
        """A slice of the base: brand list and/or population (daily series stay whole)."""
        def cut(df):
            if df is not None and population:
                df = df.where(F.col("population") == population)
            if df is not None and brands:
                df = df.where(F.col("brand").isin(list(brands)))
            return df

        whole = self.whole_roster if self.whole_roster is not None else self.roster
        return Base(self.cfg, cut(self.usage), self.daily, cut(self.roster), self.periods, cut(self._panel), whole,
                    materialized=self.materialized, rollups={level: cut(df) for level, df in self.rollups.items()},
                    _user_sets=cut(self._user_sets))


def from_tables(cfg: Config, usage: DataFrame, daily: DataFrame | None, roster: DataFrame | None) -> Base:
    usage = with_usage_measures(usage, cfg)
    return Base(cfg, usage, daily, roster, periods_dim(usage, daily, cfg))


def load_fixture_base(spark: SparkSession, sf_dir: str, cfg: Config, materialize: bool = False,
                      panel_partitions: int | None = None, tables: tuple | None = None) -> Base:
    """Base over the driver's test tables (see FIXTURES.md), or over ``tables``: usage, daily and roster made from them."""
    usage, daily, roster = tables or fixture_tables(spark, sf_dir, cfg)
    if not materialize:
        return from_tables(cfg, usage, daily, roster)
    return materialize_base(spark, cfg, usage, daily, roster, panel_partitions)


def fixture_tables(spark: SparkSession, sf_dir: str, cfg: Config, stored: bool = False) -> tuple:
    """Usage, daily and roster of the driver's test tables; stored ones are joined once, and written to the shared folder
    row by row as they come, else each report that reads them joins the tables again."""
    tables = {"usage": fixtures.usage(spark, sf_dir, cfg), "daily": fixtures.daily(spark, sf_dir, cfg),
              "roster": fixtures.roster(spark, sf_dir, cfg)}
    if not stored:
        return tuple(tables.values())
    root = shared_dir(spark, f"tables-{uuid.uuid4().hex[:12]}")

    def copy(name):
        tables[name].write.parquet(f"{root}/{name}")
        return spark.read.schema(tables[name].schema).parquet(f"{root}/{name}")

    with ThreadPoolExecutor(max_workers=len(tables)) as ex:
        return tuple(ex.map(copy, tables))


def materialize_base(spark: SparkSession, cfg: Config, usage: DataFrame, daily: DataFrame | None,
                     roster: DataFrame | None, panel_partitions: int | None = None) -> Base:
    """Write usage (partitioned by period), daily and roster to the shared folder,
    read them back, and persist the panel bucketed by user."""
    root = shared_dir(spark, f"base-{uuid.uuid4().hex[:12]}")

    def kept(df, name, placed=False, sliced=False):
        rows = df if placed else by_period(df)
        # a period's rows of a slice side by side, so that a report of the slice reads their pages only
        rows = rows.sortWithinPartitions("period_index", "brand", "population") if sliced else rows
        (rows.write.mode("overwrite")
         .partitionBy("period_index").option("compression", "zstd").parquet(f"{root}/{name}"))
        return spark.read.parquet(f"{root}/{name}")

    def copied(df, name):
        if df is None:
            return None
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def numbered_sets():
        user_numbers(rollups["users"]).write.mode("overwrite").parquet(f"{root}/user_numbers")
        return kept(user_sets(finest, spark.read.parquet(f"{root}/user_numbers")), "user_sets")

    # tables that do not need each other are written at the same time
    with ThreadPoolExecutor(max_workers=3) as ex:
        others = ex.submit(copied, daily, "daily"), ex.submit(copied, roster, "roster")
        u = with_usage_measures(kept(usage, "usage"), cfg)
        d, r = (o.result() for o in others)
        finest = kept(pairs_by_period(u, cfg), "pairs", placed=True, sliced=True)
        coarse = {level: ex.submit(lambda x: kept(coarser(finest, x), x, sliced=True), level) for level in LEVELS if level != "pairs"}
        rollups = {level: o.result() for level, o in coarse.items()} | {"pairs": finest}
        sets = ex.submit(numbered_sets)
        periods = periods_dim(rollups["courses"], d, cfg).checkpoint(eager=True)
        n = panel_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        panel = persist_panel(spark, user_period_panel(rollups["users"], periods, cfg), f"{root}/panel", n)
        base = Base(cfg, u, d, r, periods, materialized=True, rollups=rollups, _user_sets=sets.result())
    base._panel = panel
    return base


def materialized(base: Base) -> Base:
    """The base written once to the shared folder (memoised on the base), so a
    bundle of ~90 reports reads prepared tables instead of re-deriving usage
    from the raw exports for every report, and a lost executor recomputes from
    those tables. A base that is already materialised is returned as is."""
    if base.materialized:
        return base
    if base._materialized_copy is None:
        spark = base.usage.sparkSession
        base._materialized_copy = materialize_base(spark, base.cfg, base.usage, base.daily, base.roster)
    return base._materialized_copy


def persist_panel(spark: SparkSession, panel: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write the panel as an external table bucketed and sorted by user_id in the
    shared folder. Reading it back reports hash partitioning on user_id, so
    every window partitioned by user (growth, cohorts, lift, gateway) runs
    without a shuffle; a lost executor re-reads the files."""
    name = "cursus_panel_" + uuid.uuid4().hex[:12]
    # one task and one sorted file a bucket
    (panel.repartition(buckets, "user_id").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "user_id").sortBy("user_id", "pos").saveAsTable(name))
    return spark.table(name)


_CACHE: dict = {}


def fixture_base(spark: SparkSession, sf_dir: str, cfg: Config) -> Base:
    """Lazy fixture base, memoised per session and folder: plans, and the period dimension (``with_periods``)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, cfg)
    b = _CACHE.get(key)
    if b is None:
        b = _CACHE[key] = with_periods(load_fixture_base(spark, sf_dir, cfg))
    return b


def with_periods(b: Base) -> Base:
    """The base with its period dimension stored: one row a period, which nearly every report reads, often several times,
    and which would else read usage each time."""
    shared_dir(b.usage.sparkSession)  # where checkpoints go
    b.periods = b.periods.checkpoint(eager=True)
    return b
