"""Registered panel reports and period selection (2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lift as L
from ..operators import panel as P
from ..operators import set_growth as G
from ..operators import user_sets as U
from ..operators.periods import complete_periods, period_sides
from .registry import report
from .sql import q


def _brands_values(cfg) -> str:
    return "(VALUES " + ", ".join(f"({q(b)})" for b in cfg.reported_brands) + ") AS rb(brand)"


# ---------------------------------------------------------------- periods
@report("complete_periods", sql="SELECT period_index FROM dcomplete")
def complete_periods_q(b):
    return complete_periods(b.daily, b.cfg)


@report("period_sides", sql="SELECT period_index, pos, label, side FROM periods WHERE side IS NOT NULL")
def period_sides_q(b):
    return period_sides(b.periods).select("period_index", "pos", "label", "side")


@report("periods_dim", sql="SELECT period_index, pos, label, partial, side, max_pos FROM periods")
def periods_dim_q(b):
    return b.periods


# ---------------------------------------------------------------- panel
@report("user_period_panel", sql="""SELECT user_id, period_index, label, hours, brand, population,
  hours > 0 AS active FROM panel""")
def user_period_panel_q(b):
    return b.panel.select("user_id", "period_index", "label", "hours", "brand", "population", "active")


@report("active_users", sql="SELECT period_index, label, user_id FROM act")
def active_users_q(b):
    return P.active_users(b.panel)


_GROWTH_SQL = """, g AS (
  SELECT {k}pos, count(*) FILTER (WHERE is_new) AS new_users,
    count(*) FILTER (WHERE is_recurring) AS recurring,
    count(*) FILTER (WHERE NOT is_new AND NOT is_recurring) AS reactivated,
    count(*) AS total_active
  FROM actx GROUP BY ALL),
l AS (
  SELECT {k}pos + 1 AS pos, count(*) AS lost FROM actx WHERE NOT returns_next AND pos < max_pos GROUP BY ALL),
grid AS (SELECT {k}p.* FROM periods p {grid})
SELECT {gk}grid.period_index, grid.label,
  CAST(coalesce(g.new_users, 0) AS BIGINT) AS new_users, CAST(coalesce(g.recurring, 0) AS BIGINT) AS recurring,
  CAST(coalesce(g.reactivated, 0) AS BIGINT) AS reactivated,
  CAST(coalesce(g.total_active, 0) AS BIGINT) AS total_active, CAST(coalesce(l.lost, 0) AS BIGINT) AS lost
  {extra}
FROM grid LEFT JOIN g ON grid.pos = g.pos {jb} LEFT JOIN l ON grid.pos = l.pos {jl}"""


def _growth_sql(cfg, by_brand=False, extra=""):
    if by_brand:
        return _GROWTH_SQL.format(k="brand, ", grid="CROSS JOIN " + _brands_values(cfg), gk="grid.brand, ",
                                  jb="AND grid.brand = g.brand", jl="AND grid.brand = l.brand", extra=extra)
    return _GROWTH_SQL.format(k="", grid="", gk="", jb="", jl="", extra=extra)


@report("growth_accounting", sql=lambda cfg: _growth_sql(cfg))
def growth_q(b):
    return P.growth_accounting(b.panel, b.periods, b.cfg)


@report("growth_by_brand", sql=lambda cfg: _growth_sql(cfg, by_brand=True))
def growth_brand_q(b):
    return P.growth_accounting(b.panel, b.periods, b.cfg, by_brand=True)


@report("growth_slices", sql="""
, slices(slice_id) AS (VALUES (0), (1), (2), (3)),
px AS (SELECT slice_id, CASE WHEN slice_id < 2 THEN brand ELSE '*' END AS b,
         CASE WHEN slice_id IN (0, 2) THEN population ELSE '*' END AS pp, user_id, pos, hours FROM panel, slices),
a AS (SELECT slice_id, b, pp, user_id, pos, lag(pos) OVER u AS before, lead(pos) OVER u AS after, min(pos) OVER u AS first_pos
      FROM px WHERE hours > 0 WINDOW u AS (PARTITION BY slice_id, b, pp, user_id ORDER BY pos)),
g AS (SELECT slice_id, b, pp, pos, count(*) FILTER (WHERE before IS NULL) AS new_users,
        count(*) FILTER (WHERE before = pos - 1) AS recurring, count(*) FILTER (WHERE before < pos - 1) AS reactivated,
        count(*) AS total_active FROM a GROUP BY ALL),
l AS (SELECT slice_id, b, pp, pos + 1 AS pos, count(*) AS lost FROM a WHERE after IS NULL OR after > pos + 1 GROUP BY ALL),
grid AS (SELECT s.*, p.pos, p.period_index, p.label FROM (SELECT DISTINCT slice_id, b, pp FROM px) s CROSS JOIN periods p)
SELECT CAST(slice_id AS INTEGER) AS slice_id, CASE WHEN slice_id < 2 THEN b END AS brand,
  CASE WHEN slice_id IN (0, 2) THEN pp END AS population, period_index, label,
  CAST(coalesce(new_users, 0) AS BIGINT) AS new_users, CAST(coalesce(recurring, 0) AS BIGINT) AS recurring,
  CAST(coalesce(reactivated, 0) AS BIGINT) AS reactivated, CAST(coalesce(total_active, 0) AS BIGINT) AS total_active,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost
FROM grid LEFT JOIN g USING (slice_id, b, pp, pos) LEFT JOIN l USING (slice_id, b, pp, pos)""")
def growth_slices_q(b):
    return P.growth_by_slice(b.panel, b.periods)


@report("recurring_pct", sql=lambda cfg: _growth_sql(
    cfg, extra=", round_even(CAST(g.recurring AS DOUBLE) / NULLIF(g.total_active, 0) * 100, 0) AS recurring_pct"))
def recurring_pct_q(b):
    return P.recurring_pct(P.growth_accounting(b.panel, b.periods, b.cfg))


_COHORT_SQL = """
, cells AS (
  SELECT f.first_pos AS cohort_pos, a.pos - f.first_pos AS period_offset, count(*) AS active
  FROM act a JOIN firsts f ON a.user_id = f.user_id GROUP BY 1, 2),
sizes AS (SELECT first_pos AS cohort_pos, count(*) AS n FROM firsts GROUP BY 1),
grid AS (
  SELECT c.pos AS cohort_pos, c.period_index AS cohort_index, c.label AS cohort_label, o.pos - c.pos AS period_offset
  FROM periods c JOIN periods o ON o.pos >= c.pos)
SELECT grid.cohort_index, grid.cohort_label, CAST(grid.period_offset AS INTEGER) AS period_offset,
  CAST(coalesce(sizes.n, 0) AS BIGINT) AS n, CAST(coalesce(cells.active, 0) AS BIGINT) AS active,
  round(CAST(coalesce(cells.active, 0) AS DOUBLE) / NULLIF(sizes.n, 0), 6) AS rate
FROM grid LEFT JOIN cells ON grid.cohort_pos = cells.cohort_pos AND grid.period_offset = cells.period_offset
LEFT JOIN sizes ON grid.cohort_pos = sizes.cohort_pos"""


@report("cohort_retention", sql=_COHORT_SQL)
def cohort_q(b):
    return P.cohort_retention(b.panel, b.periods, b.cfg)


# ---------------------------------------------------------------- lift
_BASE_SQL = """, rb AS (
  SELECT pos, count(*) AS active, count(*) FILTER (WHERE returns_next) AS both_ FROM actx GROUP BY pos),
base AS (
  SELECT p.period_index, p.label, p.pos, CAST(coalesce(rb.active, 0) AS BIGINT) AS active,
    CAST(coalesce(rb.both_, 0) AS BIGINT) AS both_active,
    CAST(rb.both_ AS DOUBLE) / NULLIF(rb.active, 0) AS base
  FROM periods p LEFT JOIN rb ON p.pos = rb.pos WHERE p.pos < p.max_pos)"""

_POOLED_SQL = """, pooled AS (
  SELECT coalesce(100.0 * count(*) FILTER (WHERE returns_next) / NULLIF(count(*), 0), 0.0) AS base_pct
  FROM actx WHERE pos < max_pos)"""

_CONS_SQL = """, cons AS (
  SELECT DISTINCT course_id, user_id, period_index FROM usage WHERE hours > 0 AND user_id IS NOT NULL),
cret AS (
  SELECT c.course_id, a.pos, count(*) AS n, count(*) FILTER (WHERE a.returns_next) AS returned
  FROM cons c JOIN actx a ON c.user_id = a.user_id AND c.period_index = a.period_index
  WHERE a.pos < a.max_pos GROUP BY 1, 2),
cdim AS (SELECT course_id, arg_max(course_name, period_index) AS course_name FROM usage GROUP BY 1)"""


@report("retention_base", sql=_BASE_SQL + """
SELECT period_index, label, pos, active, both_active, base FROM base""")
def retention_base_q(b):
    return L.retention_base(b.panel, b.periods)


@report("retention_base_pooled", sql=_POOLED_SQL + "\nSELECT base_pct FROM pooled")
def retention_base_pooled_q(b):
    return L.retention_base_pooled(b.panel)


@report("lift_weighted", order=("-lift_pp", "-n_total", "course_id"), sql=lambda cfg: _BASE_SQL + _CONS_SQL + f"""
, per AS (
  SELECT c.course_id, c.n, c.returned, (CAST(c.returned AS DOUBLE) / c.n - base.base) * 100 AS lift_pp
  FROM cret c JOIN base ON c.pos = base.pos WHERE c.n >= {cfg.min_consumers}),
agg AS (
  SELECT course_id, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(returned) AS DOUBLE) / sum(n) AS return_mean,
    sum(lift_pp * n) / sum(n) AS lift_pp
  FROM per GROUP BY 1 HAVING sum(n) >= {cfg.min_consumers})
SELECT agg.course_id, cdim.course_name, n_total, round(return_mean, 6) AS return_mean, round(lift_pp, 6) AS lift_pp
FROM agg JOIN cdim ON agg.course_id = cdim.course_id""")
def lift_weighted_q(b):
    return L.lift_weighted(b.usage, b.panel, b.periods, b.cfg)


def _lift_pooled_sql(cfg):
    return _POOLED_SQL + _CONS_SQL + f"""
, agg AS (
  SELECT course_id, CAST(sum(n) AS BIGINT) AS n_user_transitions, CAST(sum(returned) AS BIGINT) AS returned
  FROM cret GROUP BY 1 HAVING sum(n) >= {cfg.min_transitions}),
lp AS (
  SELECT agg.course_id, cdim.course_name, n_user_transitions,
    round_even(100.0 * returned / n_user_transitions, 1) AS retention_obs_pct,
    round_even((SELECT base_pct FROM pooled), 1) AS retention_expected_pct,
    round_even(100.0 * returned / n_user_transitions - (SELECT base_pct FROM pooled), 1) AS lift_pp
  FROM agg JOIN cdim ON agg.course_id = cdim.course_id)"""


@report("lift_pooled", order=("-lift_pp", "-n_user_transitions", "course_id"), sql=lambda cfg: _lift_pooled_sql(cfg) + "\nSELECT * FROM lp")
def lift_pooled_q(b):
    return L.lift_pooled(b.usage, b.panel, b.cfg)


@report("bridge_deadend", sql=lambda cfg: _lift_pooled_sql(cfg) + f"""
SELECT * FROM (SELECT *, 'bridge' AS kind FROM lp WHERE lift_pp > 0
  ORDER BY lift_pp DESC, n_user_transitions DESC, course_id LIMIT {cfg.top_n})
UNION ALL
SELECT * FROM (SELECT *, 'dead_end' AS kind FROM lp WHERE lift_pp < 0
  ORDER BY lift_pp, n_user_transitions, course_id DESC LIMIT {cfg.top_n})""")
def bridge_deadend_q(b):
    return L.bridge_deadend(L.lift_pooled(b.usage, b.panel, b.cfg), b.cfg)


@report("gateway_courses", order=("-lift_pp", "-n", "course_id"), sql=lambda cfg: _POOLED_SQL + f"""
, cdim AS (SELECT course_id, arg_max(course_name, period_index) AS course_name FROM usage GROUP BY 1),
starts AS (
  SELECT u.user_id, u.course_id, u.hours, a.returns_next,
    row_number() OVER (PARTITION BY u.user_id ORDER BY u.hours DESC, u.course_id) AS rn
  FROM usage u JOIN actx a ON u.user_id = a.user_id AND u.period_index = a.period_index
  WHERE u.hours > 0 AND a.is_new AND a.pos < a.max_pos),
agg AS (
  SELECT course_id, count(*) AS n, count(*) FILTER (WHERE returns_next) AS returned
  FROM starts WHERE rn = 1 GROUP BY 1 HAVING count(*) >= {cfg.min_starters})
SELECT agg.course_id, cdim.course_name, CAST(n AS BIGINT) AS n,
  round_even(100.0 * returned / n, 1) AS retention_obs_pct,
  round_even(100.0 * returned / n - (SELECT base_pct FROM pooled), 1) AS lift_pp
FROM agg JOIN cdim ON agg.course_id = cdim.course_id""")
def gateway_q(b):
    return L.gateway_courses(b.usage, b.panel, b.cfg)


# ---------------------------------------------------------------- user sets (2.J)
ROLLING = 4   # periods


@report("distinct_users_rolling", sql=f"""
SELECT e.period_index, e.label, u.brand, CAST(count(DISTINCT u.user_id) AS BIGINT) AS users
FROM usage u JOIN periods p ON p.period_index = u.period_index
JOIN periods e ON e.pos BETWEEN p.pos AND p.pos + {ROLLING - 1}
WHERE u.hours > 0 AND u.user_id IS NOT NULL GROUP BY 1, 2, 3""")
def distinct_users_rolling_q(b):
    """Distinct users with hours over the last four listed periods, by brand, from the index of user sets."""
    return U.rolling_users(b.user_sets.where("active"), b.periods, ROLLING, "brand")


@report("distinct_users_course", sql="""
SELECT course_id, population, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  CAST(count(DISTINCT user_id) FILTER (WHERE hours > 0) AS BIGINT) AS users_with_hours
FROM usage WHERE user_id IS NOT NULL GROUP BY 1, 2""")
def distinct_users_course_q(b):
    """Distinct users of each course and population over all periods, and those with hours, from the index of user sets."""
    key = ["course_id", "population"]
    sets = b.user_sets.withColumn("kind", F.explode(F.when(F.col("active"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    counts = U.distinct_users(sets, *key, "kind")
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("users"))), F.lit(0)).cast("long")
    return counts.groupBy(*key).agg(of(0).alias("users"), of(1).alias("users_with_hours"))


_GROWTH_SETS = " WHERE coalesce(g.total_active, 0) + coalesce(g0.total_active, 0) > 0"


@report("growth_from_sets", sql=lambda cfg: _growth_sql(cfg, by_brand=True) + " LEFT JOIN g g0 ON g0.pos + 1 = grid.pos AND g0.brand = grid.brand"
        + _GROWTH_SETS)
def growth_from_sets_q(b):
    """Growth accounting of each reported brand from the index of user sets."""
    return G.growth_from_sets(b.user_sets.where(F.col("brand").isin(list(b.cfg.reported_brands))), b.periods, "brand")


@report("cohorts_from_sets", sql=lambda cfg: _COHORT_SQL)
def cohorts_from_sets_q(b):
    """The retention triangle from the index of user sets."""
    return G.cohorts_from_sets(b.user_sets, b.periods)
