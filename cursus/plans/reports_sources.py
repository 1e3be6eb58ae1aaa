"""Registered sources, sinks and the refresh job with SQL twins.

Each reads the raw export layout that ``sources.exports`` writes from the
driver's tables, so the checks cover the readers end to end.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAILY_HOURS_COLUMN, Config
from ..functions.aggs import dsum0, r6
from ..operators.periods import periods_dim
from ..sources import exports
from ..sources import files as FS
from ..sources import sinks
from ..streaming.derived import Derived
from ..streaming.refresh import landing_glob, refresh_usage
from .base import fixture_base
from .registry import report
from .sql import dsum0 as sdsum0, period_label


def _per_period(u: DataFrame, cfg: Config) -> DataFrame:
    return u.groupBy("period_index").agg(F.count(F.lit(1)).cast("long").alias("rows_"),
                                         F.count_distinct("user_id").cast("long").alias("users"),
                                         r6(dsum0("hours", cfg)).alias("hours"))


_SNAP_IDX = "CAST((2000 + (period_month // 12) % 100) * 12 + period_month % 12 AS INTEGER)"
_PER_SNAP_SQL = f"""
SELECT {_SNAP_IDX} AS period_index, CAST(count(*) AS BIGINT) AS rows_, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  round({sdsum0('hours')}, 6) AS hours FROM usage GROUP BY 1"""
_PER_PERIOD_SQL = f"""
SELECT period_index, CAST(count(*) AS BIGINT) AS rows_, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  round({sdsum0('hours')}, 6) AS hours FROM usage GROUP BY 1"""


@report("src_period_snapshots", raw=True, sql=_PER_SNAP_SQL)
def src_period_snapshots_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("months",))
    u = FS.read_period_snapshots(spark, os.path.join(root, "month_to_month"), cfg, file_glob=exports.MONTH_FILES)
    return _per_period(u, cfg)


@report("src_usage_csv", raw=True, sql=f"""
SELECT course_id, CAST(count(*) AS BIGINT) AS rows_, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  round({sdsum0('hours')}, 6) AS hours, CAST(count(*) FILTER (WHERE certified) AS BIGINT) AS certificates
FROM usage GROUP BY 1""")
def src_usage_csv_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("months",))
    u = FS.read_usage_csv(spark, os.path.join(root, "month_to_month", "*", exports.MONTH_FILES), cfg)
    from ..functions.columns import cert_flag
    return u.groupBy("course_id").agg(F.count(F.lit(1)).cast("long").alias("rows_"),
                                      F.count_distinct("user_id").cast("long").alias("users"),
                                      r6(dsum0("hours", cfg)).alias("hours"),
                                      F.count_if(cert_flag(F.col("certified_raw"))).cast("long").alias("certificates"))


@report("src_latest_file", raw=True, sql="SELECT day, hours FROM daily")
def src_latest_file_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("daily",))
    return FS.read_daily_series(spark, os.path.join(root, "daily"), FS.HOURS_PATTERN, DAILY_HOURS_COLUMN, "hours")


@report("src_daily_series", raw=True, sql="SELECT day, hours, contents, active, effective_raw, effective FROM daily")
def src_daily_series_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("daily",))
    return FS.read_daily(spark, os.path.join(root, "daily"), cfg).select(
        "day", "hours", "contents", "active", "effective_raw", "effective")


@report("src_roster", raw=True, sql="""
SELECT r.user_id, r.brand, r.center, r.level, r.population, CAST(p.k % 7 AS DOUBLE) / 2 AS hours,
  CAST(p.k % 5 AS DOUBLE) AS contents, CAST(p.k % 3 AS BIGINT) AS active_courses
FROM roster r JOIN people p ON p.user_id = r.user_id""")
def src_roster_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("roster",))
    return FS.read_roster(spark, [os.path.join(root, x) for x in ("roster_a", "roster_b", "roster_c")], cfg)


@report("src_current_previous", raw=True, sql=f"""
, ua AS (SELECT side, count(*) AS rows_, count(DISTINCT user_id) AS users, {sdsum0('hours')} AS hours
         FROM usage_s GROUP BY side),
da AS (SELECT side, count(*) AS days, {sdsum0('hours')} AS daily_hours, {sdsum0('effective')} AS effective
       FROM daily_s GROUP BY side)
SELECT ua.side, CAST(rows_ AS BIGINT) AS rows_, CAST(users AS BIGINT) AS users, round(hours, 6) AS hours,
  CAST(days AS BIGINT) AS days, round(daily_hours, 6) AS daily_hours, round(effective, 6) AS effective
FROM ua JOIN da ON ua.side = da.side""")
def src_current_previous_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("sides",))
    u, d = FS.read_current_previous(spark, os.path.join(root, "current"), os.path.join(root, "previous"), cfg)
    ua = u.groupBy("side").agg(F.count(F.lit(1)).cast("long").alias("rows_"),
                               F.count_distinct("user_id").cast("long").alias("users"),
                               r6(dsum0("hours", cfg)).alias("hours"))
    da = d.groupBy("side").agg(F.count(F.lit(1)).cast("long").alias("days"),
                               r6(dsum0("hours", cfg)).alias("daily_hours"),
                               r6(dsum0("effective", cfg)).alias("effective"))
    return ua.join(da, "side")


def _month_cfg(cfg: Config) -> Config:
    return cfg.with_(grain="month")


@report("src_calendar_mode", raw=True, sql=lambda cfg: f"""
, snap AS (SELECT DISTINCT {_SNAP_IDX} AS period_index FROM usage),
dpm AS (SELECT CAST(year(day) * 12 + month(day) - 1 AS INTEGER) AS period_index, max(day) AS ld FROM daily GROUP BY 1),
dcm AS (SELECT period_index FROM dpm WHERE period_index < (SELECT max(period_index) FROM dpm) OR ld >= last_day(ld)),
pd AS (SELECT s.period_index, (c.period_index IS NOT NULL) AS complete FROM snap s
       LEFT JOIN dcm c ON s.period_index = c.period_index)
SELECT period_index, CAST(row_number() OVER (ORDER BY period_index) - 1 AS INTEGER) AS pos,
  {period_label('period_index', _month_cfg(cfg))} || CASE WHEN complete THEN '' ELSE '*' END AS label,
  NOT complete AS partial,
  CASE WHEN complete AND row_number() OVER (PARTITION BY complete ORDER BY period_index DESC) = 1 THEN 'cur'
       WHEN complete AND row_number() OVER (PARTITION BY complete ORDER BY period_index DESC) = 2 THEN 'prev' END AS side
FROM pd""")
def src_calendar_mode_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("months", "daily"))
    mcfg = _month_cfg(cfg)
    named = FS.snapshot_periods(spark, os.path.join(root, "month_to_month"), file_glob=exports.MONTH_FILES)
    d = FS.read_daily(spark, os.path.join(root, "daily"), mcfg)
    return periods_dim(named, d, mcfg).select("period_index", "pos", "label", "partial", "side")


@report("src_calendar_slices", raw=True, sql=f"""
, um AS (SELECT *, {_SNAP_IDX} AS m FROM usage),
dm AS (SELECT *, CAST(year(day) * 12 + month(day) - 1 AS INTEGER) AS m FROM daily),
last AS (SELECT m, max(day) AS ld FROM dm GROUP BY m),
whole AS (SELECT m FROM last WHERE m < (SELECT max(m) FROM last) OR ld >= last_day(ld)),
sides AS (SELECT m, CASE row_number() OVER (ORDER BY m DESC) WHEN 1 THEN 'cur' WHEN 2 THEN 'prev' END AS side
          FROM (SELECT DISTINCT m FROM um) JOIN whole USING (m)),
ua AS (SELECT side, count(*) AS rows_, count(DISTINCT user_id) AS users, {sdsum0('hours')} AS hours
       FROM um JOIN sides USING (m) WHERE side IS NOT NULL GROUP BY side),
da AS (SELECT side, count(*) AS days, {sdsum0('hours')} AS daily_hours, {sdsum0('contents')} AS contents,
         {sdsum0('effective')} AS effective FROM dm JOIN sides USING (m) WHERE side IS NOT NULL GROUP BY side)
SELECT ua.side, CAST(rows_ AS BIGINT) AS rows_, CAST(users AS BIGINT) AS users, round(hours, 6) AS hours,
  CAST(days AS BIGINT) AS days, round(daily_hours, 6) AS daily_hours, round(contents, 6) AS contents,
  round(effective, 6) AS effective
FROM ua JOIN da ON ua.side = da.side""")
def src_calendar_slices_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("months", "daily"))
    u, d = FS.read_calendar(spark, os.path.join(root, "month_to_month"), os.path.join(root, "daily"), _month_cfg(cfg),
                            file_glob=exports.MONTH_FILES)
    ua = u.groupBy("side").agg(F.count(F.lit(1)).cast("long").alias("rows_"),
                               F.count_distinct("user_id").cast("long").alias("users"),
                               r6(dsum0("hours", cfg)).alias("hours"))
    da = d.groupBy("side").agg(F.count(F.lit(1)).cast("long").alias("days"),
                               r6(dsum0("hours", cfg)).alias("daily_hours"), r6(dsum0("contents", cfg)).alias("contents"),
                               r6(dsum0("effective", cfg)).alias("effective"))
    return ua.join(da, "side")


@report("src_prepared", raw=True, sql=_PER_PERIOD_SQL)
def src_prepared_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ())
    b = fixture_base(spark, sf_dir, cfg)
    out = os.path.join(root, "prepared")
    sinks.write_prepared(b.usage, b.daily, b.roster, b.periods, out)
    u, _, _ = FS.read_prepared(spark, out, cfg)
    return _per_period(u, cfg)


@report("snk_parquet", raw=True, sql=f"""
SELECT period_index, CAST(count(*) AS BIGINT) AS rows_, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  round({sdsum0('hours')}, 6) AS hours, CAST(count(user_id) AS BIGINT) AS pseudonymised FROM usage GROUP BY 1""")
def snk_parquet_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ())
    b = fixture_base(spark, sf_dir, cfg)
    out = os.path.join(root, "snk_usage")
    sinks.write_usage(b.usage, out)
    u = spark.read.parquet(out)
    return u.groupBy("period_index").agg(
        F.count(F.lit(1)).cast("long").alias("rows_"), F.count_distinct("user_id").cast("long").alias("users"),
        r6(dsum0("hours", cfg)).alias("hours"),
        F.count_if(F.col("user_id").startswith("u_")).cast("long").alias("pseudonymised"))


@report("snk_serie", raw=True, sql="SELECT day, hours FROM daily")
def snk_serie_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ())
    b = fixture_base(spark, sf_dir, cfg)
    out = os.path.join(root, "snk_serie")
    sinks.write_series(b.daily.select("day", "hours"), out)
    return spark.read.parquet(out)


@report("period_manifest", sql="""
SELECT 'calendario' AS mode, max(CASE WHEN side = 'cur' THEN period_index END) AS cur,
  max(CASE WHEN side = 'prev' THEN period_index END) AS prev,
  list(period_index ORDER BY period_index) FILTER (WHERE partial) AS partial FROM periods""")
def period_manifest_q(b):
    return sinks.manifest(b.periods, "calendario")


@report("refresh_job", raw=True, sql=_PER_SNAP_SQL)
def refresh_job_q(spark, sf_dir, cfg):
    root = exports.ensure(spark, sf_dir, cfg, ("months",))
    out = os.path.join(root, "refreshed_usage")
    refresh_usage(spark, landing_glob(root), out, os.path.join(root, "refresh_checkpoint"), cfg)
    return _per_period(spark.read.parquet(out), cfg)


@report("refresh_derived", raw=True, sql=f"""
, m AS (SELECT {_SNAP_IDX} AS period_index, user_id, bool_or(hours > 0 AND user_id IS NOT NULL) AS active FROM usage GROUP BY 1, 2),
pl AS (SELECT period_index, row_number() OVER (ORDER BY period_index) AS pos FROM (SELECT DISTINCT period_index FROM m)),
a AS (SELECT pos, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM m JOIN pl USING (period_index) WHERE active),
g AS (SELECT pos, count(*) FILTER (WHERE before IS NULL) AS new_users, count(*) FILTER (WHERE before = pos - 1) AS recurring,
  count(*) AS total_active FROM a GROUP BY 1)
SELECT pl.period_index, CAST(coalesce(g.new_users, 0) AS BIGINT) AS new_users, CAST(coalesce(g.recurring, 0) AS BIGINT) AS recurring,
  CAST(coalesce(g.total_active - g.new_users - g.recurring, 0) AS BIGINT) AS reactivated,
  CAST(coalesce(g.total_active, 0) AS BIGINT) AS total_active,
  CAST(coalesce(p.total_active, 0) - coalesce(g.recurring, 0) AS BIGINT) AS lost
FROM pl LEFT JOIN g ON g.pos = pl.pos LEFT JOIN g p ON p.pos + 1 = pl.pos
WHERE coalesce(g.total_active, 0) + coalesce(p.total_active, 0) > 0""")
def refresh_derived_q(spark, sf_dir, cfg):
    """Growth per period from the derived tables that the refresh job keeps beside the usage it writes."""
    root = exports.ensure(spark, sf_dir, cfg, ("months",))
    out = os.path.join(root, "derived_usage")
    refresh_usage(spark, landing_glob(root), out, f"{out}_checkpoint", cfg, derived=f"{out}_tables")
    return Derived(spark, f"{out}_tables", cfg).growth().drop("label")


# ---------------------------------------------------------------- bundles (2.I)
@report("base_bundle", sql="""
SELECT 'usage' AS table_name, CAST(count(*) AS BIGINT) AS rows_ FROM usage
UNION ALL SELECT 'daily', CAST(count(*) AS BIGINT) FROM daily
UNION ALL SELECT 'roster', CAST(count(*) AS BIGINT) FROM roster
UNION ALL SELECT 'periods', CAST(count(*) AS BIGINT) FROM periods
UNION ALL SELECT 'panel', CAST(count(*) AS BIGINT) FROM panel""")
def base_bundle_q(b):
    parts = [(n, df) for n, df in (("usage", b.usage), ("daily", b.daily), ("roster", b.roster),
                                   ("periods", b.periods), ("panel", b.panel))]
    out = None
    for n, df in parts:
        one = df.agg(F.count(F.lit(1)).cast("long").alias("rows_")).select(F.lit(n).alias("table_name"), "rows_")
        out = one if out is None else out.unionByName(one)
    return out


@report("bundle_meta", sql=lambda cfg: f"""
SELECT 'axis' AS item, pos AS place, label AS value FROM periods
UNION ALL SELECT side || '_label', 0, label FROM periods WHERE side IS NOT NULL
UNION ALL SELECT 'partial', pos, label FROM periods WHERE partial
UNION ALL SELECT 'brand', b.i, b.brand FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(cfg.reported_brands))}) AS b(i, brand)
  WHERE b.brand IN (SELECT brand FROM panel)
UNION ALL SELECT 'cut', 0, CAST(max(day) AS VARCHAR) FROM daily_s WHERE side = 'cur' HAVING count(*) > 0
UNION ALL SELECT 'series_cut', 0, CAST(max(day) AS VARCHAR) FROM daily HAVING count(*) > 0""")
def bundle_meta_q(b):
    """What a bundle says of itself: (item, place, value) of the period axis, the two sides' labels, partial periods,
    reported brands with users in their order, and the last day of the current period's series and of the whole series."""
    from ..operators.slicing import brands_present
    periods = b.periods
    parts = [periods.select(F.lit("axis").alias("item"), F.col("pos").alias("place"), F.col("label").alias("value")),
             periods.where(F.col("side").isNotNull()).select(F.concat("side", F.lit("_label")), F.lit(0), "label"),
             periods.where("partial").select(F.lit("partial"), "pos", "label"),
             brands_present(b.panel, b.cfg).select(F.lit("brand"), "ord", "brand")]
    if b.daily is not None:
        for item, days in (("cut", b.daily_with_side().where(F.col("side") == "cur")), ("series_cut", b.daily)):
            last = days.agg(F.max("day").cast("string").alias("value")).where(F.col("value").isNotNull())
            parts.append(last.select(F.lit(item), F.lit(0), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@report("report_bundle")
def report_bundle_q(b):
    from .base import materialized
    from .bundle import bundle_builders, bundle_digest
    return bundle_digest(bundle_builders(materialized(b), brands=[b.cfg.reported_brands[0]], population="Alumnos"))


@report("result_digest")
def result_digest_q(b):
    """Digests of every report over the total and over each reported brand."""
    from .base import materialized
    from .bundle import sliced_digest
    return sliced_digest(materialized(b), {"total": None} | {x: [x] for x in b.cfg.reported_brands})


@report("result_diff", raw=True)
def result_diff_q(spark, sf_dir, cfg):
    """Every report of a bundle over the lazy base vs over the materialised base: no row may differ.

    Both bases start from the same rows of usage, daily and roster, joined once. The lazy one derives all else (periods,
    panel, user sets) from them report by report, the other reads its own tables by period, rollups, panel and user sets.
    """
    from .base import fixture_tables, load_fixture_base, with_periods
    from .bundle import bundle_builders, bundle_diff
    tables = fixture_tables(spark, sf_dir, cfg, stored=True)
    lazy = with_periods(load_fixture_base(spark, sf_dir, cfg, tables=tables))
    mat = load_fixture_base(spark, sf_dir, cfg, materialize=True, tables=tables)
    return bundle_diff(bundle_builders(lazy), bundle_builders(mat))
