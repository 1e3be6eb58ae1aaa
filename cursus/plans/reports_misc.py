"""Registered series (2.G) and teacher-population (2.H) reports with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT, MONTH_ABBR, TEACHERS
from ..operators import population as PO
from ..operators import series as SE
from .registry import report
from .sql import dsum, dsum0, period_label, q, ratio


# ---------------------------------------------------------------- series
def _series(b):
    ds = b.daily_with_side()
    return SE.series_union([b.daily.select("day", "hours"),
                            ds.where(F.col("side") == "prev").select("day", "hours"),
                            ds.where(F.col("side") == "cur").select("day", "hours")])


def _filled(b):
    return SE.series_calendar_fill(_series(b))


_SERIES_SQL = """
, su0 AS (
  SELECT day, hours, 0 AS pr FROM daily
  UNION ALL SELECT day, hours, 1 FROM daily_s WHERE side = 'prev'
  UNION ALL SELECT day, hours, 2 FROM daily_s WHERE side = 'cur'),
su AS (SELECT day, arg_max(hours, pr) AS hours FROM su0 WHERE day IS NOT NULL GROUP BY day),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM su),
filled AS (SELECT cal.day, coalesce(su.hours, 0.0) AS hours FROM cal LEFT JOIN su ON cal.day = su.day)"""


def _long_sql(cfg) -> str:
    return _SERIES_SQL + f"""
, ls AS (
  SELECT day, hours, CAST(sum(CAST(hours AS DECIMAL(38,12))) OVER w7 AS DOUBLE) / count(hours) OVER w7 AS r7,
    CASE WHEN count(hours) OVER w28 >= 7
         THEN CAST(sum(CAST(hours AS DECIMAL(38,12))) OVER w28 AS DOUBLE) / count(hours) OVER w28 END AS r28
  FROM filled WINDOW w28 AS (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING),
    w7 AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
lsx AS (
  SELECT a.day, a.hours, a.r7, a.r28, a.hours / NULLIF(a.r28, 0) AS seasonal_index, b.r7 AS r7_year_ago
  FROM ls a LEFT JOIN ls b ON b.day = a.day - {cfg.yoy_lag_days} AND b.day >= DATE '{cfg.launch_date}')"""


@report("series_union", sql=_SERIES_SQL + "\nSELECT day, hours FROM su")
def series_union_q(b):
    return _series(b)


@report("series_calendar_fill", sql=_SERIES_SQL + "\nSELECT day, hours FROM filled")
def series_calendar_fill_q(b):
    return _filled(b)


@report("series_gaps", sql=_SERIES_SQL + "\nSELECT cal.day, su.hours FROM cal LEFT JOIN su ON cal.day = su.day")
def series_gaps_q(b):
    return SE.series_gaps(_series(b))


@report("long_series", sql=lambda cfg: _long_sql(cfg) + "\nSELECT * FROM lsx")
def long_series_q(b):
    return SE.long_series(_filled(b), b.cfg)


for _name, _col in (("rolling_7", "r7"), ("trend_28", "r28"), ("seasonal_index", "seasonal_index"),
                    ("year_ago_7", "r7_year_ago")):
    report(_name, sql=(lambda cfg, _c=_col: _long_sql(cfg) + f"\nSELECT day, {_c} FROM lsx"))(
        lambda b, _c=_col: SE.long_series(_filled(b), b.cfg).select("day", _c))


@report("yoy_by_month", sql=lambda cfg: _SERIES_SQL + f"""
, a AS (SELECT day, hours FROM filled WHERE day < (SELECT max(day) FROM filled)),
bb AS (SELECT day + {cfg.yoy_lag_days} AS day, hours AS hours_ago FROM filled WHERE day >= DATE '{cfg.launch_date}'),
j AS (SELECT a.day, a.hours, bb.hours_ago, CAST(year(a.day) * 12 + month(a.day) - 1 AS INTEGER) AS m
      FROM a JOIN bb ON a.day = bb.day)
SELECT {period_label('m', DEFAULT)} AS label, m AS month_index,
  CAST(count(*) AS BIGINT) AS days, min(day) AS date_from, max(day) AS date_to,
  round({dsum('hours')}, 6) AS hours, round({dsum('hours_ago')}, 6) AS hours_ago,
  round(({dsum('hours')} / NULLIF({dsum('hours_ago')}, 0) - 1) * 100, 6) AS delta_pct
FROM j GROUP BY m""")
def yoy_by_month_q(b):
    return SE.yoy_by_month(_filled(b), b.cfg)


@report("daily_trends", sql="""
SELECT day, round(hours, 6) AS hours,
  CAST(sum(CAST(hours AS DECIMAL(38,12))) OVER w AS DOUBLE) / count(hours) OVER w AS hours_r7,
  CAST(contents AS BIGINT) AS contents,
  CAST(sum(CAST(contents AS DECIMAL(38,12))) OVER w AS DOUBLE) / count(contents) OVER w AS contents_r7,
  round((SELECT avg(hours) FROM daily_s WHERE side = 'prev'), 6) AS hours_prev_mean,
  round((SELECT avg(CAST(contents AS DOUBLE)) FROM daily_s WHERE side = 'prev'), 6) AS contents_prev_mean
FROM daily_s WHERE side = 'cur' WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def daily_trends_q(b):
    return SE.daily_trends(b.daily_with_side(), b.cfg)


@report("daily_summary", sql="""
SELECT round(avg(hours) FILTER (WHERE side = 'cur'), 6) AS hours_mean,
  round(quantile_cont(hours, 0.5) FILTER (WHERE side = 'cur'), 6) AS hours_median,
  round(avg(CAST(contents AS DOUBLE)) FILTER (WHERE side = 'cur'), 6) AS contents_mean,
  round(quantile_cont(CAST(contents AS DOUBLE), 0.5) FILTER (WHERE side = 'cur'), 6) AS contents_median,
  round(avg(hours) FILTER (WHERE side = 'prev'), 6) AS hours_prev_mean,
  round(avg(CAST(contents AS DOUBLE)) FILTER (WHERE side = 'prev'), 6) AS contents_prev_mean
FROM daily_s""")
def daily_summary_q(b):
    return SE.daily_summary(b.daily_with_side(), b.cfg)


def _dm(d: str) -> str:
    names = "[" + ", ".join(q(m) for m in MONTH_ABBR) + "]"
    return f"(lpad(CAST(day({d}) AS VARCHAR), 2, '0') || '-' || {names}[month({d})])"


@report("date_range_label", sql=lambda cfg: f"""
, g AS (SELECT d.side, p.period_index, p.label, min(day) AS first_day, max(day) AS last_day
        FROM daily_s d JOIN periods p ON d.side = p.side WHERE day IS NOT NULL GROUP BY 1, 2, 3)
SELECT side, period_index, first_day, last_day,
  label || ' (' || {_dm('first_day')} || ' → ' || {_dm('last_day')} || ')' AS period_label,
  {_dm('last_day')} || '-' || CAST(year(last_day) AS VARCHAR) AS cutoff,
  month(first_day + CAST(floor(datediff('day', first_day, last_day) / 2) AS INTEGER)) AS mid_month
FROM g""")
def date_range_label_q(b):
    return SE.period_labels(b.daily_with_side(), b.periods, b.cfg)


# ---------------------------------------------------------------- teacher population
_T = f"population = '{TEACHERS}'"

_POP_PERIOD_SQL = f"""
, tu AS (SELECT user_id, period_index, {dsum0('hours')} AS h FROM usage WHERE {_T} AND user_id IS NOT NULL GROUP BY 1, 2),
tf AS (SELECT user_id, min(period_index) AS fp FROM tu GROUP BY 1),
tg AS (
  SELECT tu.period_index, count(*) AS in_base, count(*) FILTER (WHERE tu.period_index = tf.fp) AS first_seen,
    count(*) FILTER (WHERE h > 0) AS active, {dsum0('h')} AS hours,
    quantile_cont(h, 0.5) FILTER (WHERE h > 0) * 60 AS med,
    {ratio(dsum('CASE WHEN h > 0 THEN h END'), 'count(*) FILTER (WHERE h > 0)')} * 60 AS mean_
  FROM tu JOIN tf ON tu.user_id = tf.user_id GROUP BY 1),
ttot AS (SELECT period_index, {dsum0('hours')} AS total FROM usage GROUP BY 1),
pbp AS (
  SELECT p.period_index, p.label, CAST(coalesce(in_base, 0) AS BIGINT) AS in_base,
    CAST(coalesce(first_seen, 0) AS BIGINT) AS first_seen, CAST(coalesce(active, 0) AS BIGINT) AS active,
    CAST(coalesce(in_base, 0) - coalesce(first_seen, 0) AS BIGINT) AS already_seen,
    round(coalesce(hours, 0.0), 6) AS hours, round(med, 6) AS median_min_active, round(mean_, 6) AS mean_min_active,
    round(CASE WHEN total <> 0 THEN coalesce(hours, 0.0) / total * 100 END, 6) AS pct_platform_hours
  FROM periods p LEFT JOIN tg ON p.period_index = tg.period_index LEFT JOIN ttot ON p.period_index = ttot.period_index)"""


@report("pop_by_period", sql=_POP_PERIOD_SQL + "\nSELECT * FROM pbp")
def pop_by_period_q(b):
    return PO.pop_by_period(b.usage, b.periods, b.cfg)


@report("pop_current_row", sql=_POP_PERIOD_SQL + """
SELECT * FROM pbp WHERE period_index = coalesce((SELECT period_index FROM periods WHERE side = 'cur'),
                                                (SELECT max(period_index) FROM periods))""")
def pop_current_row_q(b):
    return PO.pop_current_row(b.usage, b.periods, b.cfg)


@report("pop_by_brand", sql=lambda cfg: f"""
, uh AS (SELECT brand, user_id, {dsum0('hours')} AS h FROM cur WHERE {_T} AND user_id IS NOT NULL GROUP BY 1, 2)
SELECT brand, CAST(count(*) AS BIGINT) AS in_base, CAST(count(*) FILTER (WHERE h > 0) AS BIGINT) AS active,
  round({dsum0('h')}, 6) AS hours
FROM uh WHERE brand IN ({", ".join(q(x) for x in cfg.reported_brands)}) GROUP BY brand""")
def pop_by_brand_q(b):
    return PO.pop_by_brand(b.cur, b.cfg)


@report("pop_courses", order=("-teachers", "-hours", "course_id"), sql=f"""
SELECT course_id, max(course_name) AS course_name, CAST(count(DISTINCT user_id) AS BIGINT) AS teachers,
  round({dsum0('hours')}, 6) AS hours
FROM cur WHERE {_T} AND hours > 0 GROUP BY course_id""")
def pop_courses_q(b):
    return PO.pop_courses(b.cur, b.cfg)


@report("pop_active_ever", sql=f"""
SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS active_ever FROM usage WHERE {_T} AND hours > 0""")
def pop_active_ever_q(b):
    return PO.pop_active_ever(b.usage)


_TH_SQL = f"""
, th AS (SELECT user_id, brand, {dsum0('hours')} AS hours, count(DISTINCT course_id) AS courses,
           count(DISTINCT period_index) AS periods
         FROM usage WHERE {_T} AND hours > 0 AND user_id IS NOT NULL GROUP BY 1, 2)"""


@report("pop_panel_by_brand", order=("-active", "brand"), sql=lambda cfg: _TH_SQL + f"""
, tb AS (SELECT brand, count(DISTINCT user_id) AS in_base FROM usage WHERE {_T} AND user_id IS NOT NULL GROUP BY 1),
pm AS (SELECT brand, count(*) AS active, {dsum0('hours')} AS hours, quantile_cont(hours, 0.5) * 60 AS mm
       FROM th GROUP BY 1),
allh AS (SELECT {dsum0('hours')} AS a FROM th)
SELECT tb.brand, CAST(in_base AS BIGINT) AS in_base, CAST(coalesce(active, 0) AS BIGINT) AS active,
  round(coalesce(pm.hours, 0.0), 6) AS hours, round(mm, 6) AS median_min,
  round({ratio('coalesce(active, 0)', 'in_base')} * 100, 6) AS pct_active,
  round({ratio('coalesce(pm.hours, 0.0)', 'coalesce(active, 0)')}, 6) AS hours_per_active,
  round(CASE WHEN (SELECT a FROM allh) <> 0 THEN coalesce(pm.hours, 0.0) / (SELECT a FROM allh) * 100 END, 6)
    AS pct_hours
FROM tb LEFT JOIN pm ON tb.brand = pm.brand
WHERE tb.brand IN ({", ".join(q(x) for x in cfg.reported_brands)})""")
def pop_panel_by_brand_q(b):
    return PO.pop_panel_by_brand(b.usage, b.cfg)


@report("pop_ranking", sql=lambda cfg: _TH_SQL + f"""
, rk AS (SELECT *, row_number() OVER (ORDER BY hours DESC, user_id) AS rn FROM th)
SELECT user_id, brand, round(hours, 6) AS hours, CAST(courses AS BIGINT) AS courses, CAST(periods AS BIGINT) AS periods,
  CAST(rn AS BIGINT) AS rank,
  CAST(rn AS VARCHAR) || '. ' || brand || ' · D-' || substr((string_split(user_id, '_'))[-1], 1, 4) AS code
FROM rk WHERE rn <= {cfg.teacher_top}""")
def pop_ranking_q(b):
    return PO.pop_ranking(b.usage, b.cfg)


@report("pop_summary", sql=_TH_SQL + f"""
, rk AS (SELECT hours, row_number() OVER (ORDER BY hours DESC) AS rn FROM th),
k AS (SELECT greatest(1, CAST(round_even(count(*) * CAST(0.1 AS DOUBLE), 0) AS BIGINT)) AS k,
        {dsum0('hours')} AS tot FROM th)
SELECT (SELECT CAST(count(DISTINCT user_id) AS BIGINT) FROM usage WHERE {_T}) AS in_base,
  CAST(count(*) AS BIGINT) AS active, round({dsum0('hours')}, 6) AS hours,
  round(quantile_cont(hours, 0.5) * 60, 6) AS median_min,
  round({ratio(dsum('hours'), 'count(*)')} * 60, 6) AS mean_min,
  (SELECT round(CASE WHEN tot > 0 THEN (SELECT {dsum('hours')} FROM rk WHERE rn <= k.k) / tot * 100 END, 6) FROM k)
    AS top10_share,
  (SELECT list(label ORDER BY period_index) FROM periods
   WHERE period_index IN (SELECT DISTINCT period_index FROM usage WHERE {_T})) AS periods
FROM th""")
def pop_summary_q(b):
    return PO.pop_summary(b.usage, b.periods, b.cfg)


@report("pop_panel_courses", order=("-teachers", "-hours", "course_id"), sql=f"""
, c AS (SELECT * FROM usage WHERE {_T} AND hours > 0)
SELECT course_id, max(course_name) AS course_name, CAST(count(DISTINCT user_id) AS BIGINT) AS teachers,
  round({dsum0('hours')}, 6) AS hours,
  round(CAST(count(DISTINCT user_id) AS DOUBLE) / greatest((SELECT count(DISTINCT user_id) FROM c WHERE user_id IS NOT NULL), 1) * 100, 6)
    AS pct_teachers
FROM c GROUP BY course_id""")
def pop_panel_courses_q(b):
    return PO.pop_panel_courses(b.usage, b.cfg)
