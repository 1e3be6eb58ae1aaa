"""Registered single-period reports with their SQL twins."""

from __future__ import annotations


from ..config import SEGMENT_ORDER
from ..operators import snapshot as S
from .registry import report
from .sql import dsum, dsum0, q, r6, ratio, segment_case, values


def _kpi_rows(src: str, items) -> str:
    """items: (kpi, expr_cur, expr_prev) over ``src``."""
    cols = ", ".join(f"{c} AS c{i}, {p} AS p{i}" for i, (_, c, p) in enumerate(items))
    union = " UNION ALL ".join(f"SELECT {q(k)} AS kpi, c{i} AS cv, p{i} AS pv FROM k" for i, (k, _, _) in enumerate(items))
    return f""", k AS (SELECT {cols} FROM {src}),
kr AS ({union})
SELECT kpi, {r6('cv')} AS "current", {r6('pv')} AS previous,
  round((cv - pv) / NULLIF(pv, 0) * 100, 6) AS delta_pct FROM kr"""


def _side(c, s):
    return f"CASE WHEN side = '{s}' THEN {c} END"


@report("panorama_kpis", sql=_kpi_rows("daily_s", [
    ("hours", dsum0(_side("hours", "cur")), dsum0(_side("hours", "prev"))),
    ("unique_contents", f"CAST(coalesce(sum({_side('contents', 'cur')}), 0) AS DOUBLE)",
     f"CAST(coalesce(sum({_side('contents', 'prev')}), 0) AS DOUBLE)"),
    ("active_users", f"CAST(coalesce(sum({_side('active', 'cur')}), 0) AS DOUBLE)",
     f"CAST(coalesce(sum({_side('active', 'prev')}), 0) AS DOUBLE)"),
    ("effective_users", dsum0(_side("effective", "cur")), dsum0(_side("effective", "prev")))]))
def panorama_kpis_q(b):
    return S.panorama_kpis(b.daily_with_side(), b.cfg)


@report("panorama_snapshot", sql=_kpi_rows("usage_s", [
    ("hours", dsum0(_side("hours", "cur")), dsum0(_side("hours", "prev"))),
    ("contents", dsum0(_side("contents", "cur")), dsum0(_side("contents", "prev"))),
    ("users_with_rows", f"CAST(count(DISTINCT {_side('user_id', 'cur')}) AS DOUBLE)",
     f"CAST(count(DISTINCT {_side('user_id', 'prev')}) AS DOUBLE)")]))
def panorama_snapshot_q(b):
    return S.panorama_snapshot(b.with_side(), b.cfg)


@report("panorama_by_brand", sql=lambda cfg: f"""
, g AS (
  SELECT brand, {dsum(_side('hours', 'cur'))} AS hc, {dsum(_side('hours', 'prev'))} AS hp,
    {dsum(_side('contents', 'cur'))} AS cc, {dsum(_side('contents', 'prev'))} AS cp,
    count(DISTINCT {_side('user_id', 'cur')}) AS uc, count(DISTINCT {_side('user_id', 'prev')}) AS up
  FROM usage_s GROUP BY brand)
SELECT v.brand, round(coalesce(hc, 0.0), 6) AS hours_current, round(coalesce(hp, 0.0), 6) AS hours_previous,
  round(coalesce(cc, 0.0), 6) AS contents_current, round(coalesce(cp, 0.0), 6) AS contents_previous,
  CAST(coalesce(uc, 0) AS BIGINT) AS users_current, CAST(coalesce(up, 0) AS BIGINT) AS users_previous
FROM {values('brand', cfg.reported_brands)} LEFT JOIN g ON v.brand = g.brand""")
def panorama_by_brand_q(b):
    return S.panorama_by_brand(b.with_side(), b.cfg)


@report("hours_per_user", sql=f"SELECT user_id, hours, {segment_case('hours')} AS segment FROM hpu_cur")
def hours_per_user_q(b):
    return S.hours_per_user(b.cur, b.cfg)


@report("activation_share", sql=f"""
, g AS (SELECT CASE WHEN hours = 0 THEN 'No activados' ELSE 'Activados' END AS label, count(*) AS users
        FROM hpu_cur GROUP BY 1)
SELECT v.label, round(coalesce(CAST(users AS DOUBLE) / NULLIF((SELECT count(*) FROM hpu_cur), 0), 0.0), 6) AS share
FROM {values('label', ['No activados', 'Activados'])} LEFT JOIN g ON v.label = g.label""")
def activation_share_q(b):
    return S.activation_share(b.cur, b.cfg)


@report("intensity_share", sql=f"""
, a AS (SELECT {segment_case('hours')} AS segment FROM hpu_cur WHERE hours <> 0),
g AS (SELECT segment, count(*) AS users FROM a GROUP BY 1)
SELECT v.segment, round(coalesce(CAST(users AS DOUBLE) / NULLIF((SELECT count(*) FROM a), 0), 0.0), 6) AS share
FROM {values('segment', SEGMENT_ORDER)} LEFT JOIN g ON v.segment = g.segment""")
def intensity_share_q(b):
    return S.intensity_share(b.cur, b.cfg)


@report("segment_counts", sql=f"""
, g AS (SELECT {segment_case('hours')} AS segment, count(*) AS users FROM hpu_cur GROUP BY 1)
SELECT v.segment, CAST(coalesce(users, 0) AS BIGINT) AS users
FROM {values('segment', ('No activados',) + SEGMENT_ORDER)} LEFT JOIN g ON v.segment = g.segment""")
def segment_counts_q(b):
    return S.segment_counts(b.cur, b.cfg)


def _segments_by_brand_sql(cfg):
    segs = ", ".join(
        f"round(coalesce(CAST(count(*) FILTER (WHERE {segment_case('hours')} = {q(s)}) AS DOUBLE) / "
        f"NULLIF(count(*) FILTER (WHERE hours <> 0), 0), 0.0), 6) AS {c}"
        for c, s in zip(S.SEGMENT_COLUMNS, SEGMENT_ORDER))
    brands = ", ".join(q(x) for x in cfg.reported_brands)
    return f"""
, hb AS (SELECT brand, user_id, {dsum0('hours')} AS hours FROM cur
         WHERE user_id IS NOT NULL AND brand IN ({brands}) GROUP BY 1, 2)
SELECT brand, CAST(count(*) AS BIGINT) AS n_users,
  round(CAST(count(*) FILTER (WHERE hours = 0) AS DOUBLE) / count(*), 6) AS not_activated,
  round(CAST(count(*) FILTER (WHERE hours <> 0) AS DOUBLE) / count(*), 6) AS activated, {segs}
FROM hb GROUP BY brand"""


@report("segments_by_brand", sql=_segments_by_brand_sql)
def segments_by_brand_q(b):
    return S.segments_by_brand(b.cur, b.cfg)


_TOP_SHARE_SQL = """
, ranked AS (SELECT hours, row_number() OVER (ORDER BY hours DESC) AS rn FROM {src}),
st AS (SELECT count(*) AS n, {tot} AS tot FROM {src}),
kk AS (SELECT p, greatest(1, CAST(round_even(n * p, 0) AS BIGINT)) AS k, tot
       FROM (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.10 AS DOUBLE))) AS t(p), st),
ts AS (
  SELECT p * 100 AS pct, k,
    round(CASE WHEN tot > 0 THEN (SELECT {rsum} FROM ranked WHERE rn <= kk.k) / tot * 100 END, 6) AS share
  FROM kk)"""


def top_share_sql(src: str) -> str:
    return _TOP_SHARE_SQL.format(src=src, tot=dsum0("hours"), rsum=dsum("hours"))


@report("top_share", sql=top_share_sql("hpu_cur") + "\nSELECT pct, k, share FROM ts")
def top_share_q(b):
    return S.top_share(b.cur, b.cfg)


@report("hours_distribution", sql=top_share_sql("hpu_cur") + f"""
SELECT CAST(count(*) AS BIGINT) AS n_users, CAST(count(*) FILTER (WHERE hours > 0) AS BIGINT) AS n_activated,
  round({ratio('count(*) FILTER (WHERE hours > 0)', 'count(*)')} * 100, 6) AS pct_activated,
  round({dsum0('hours')}, 6) AS hours_total,
  round({ratio(dsum('hours'), 'count(*)')}, 6) AS mean_all,
  round(quantile_cont(hours, 0.5), 6) AS median_all,
  round({ratio(dsum('CASE WHEN hours > 0 THEN hours END'), 'count(*) FILTER (WHERE hours > 0)')}, 6) AS mean_act,
  round(quantile_cont(hours, 0.5) FILTER (WHERE hours > 0), 6) AS median_act,
  round(quantile_cont(hours, 0.25) FILTER (WHERE hours > 0), 6) AS p25_act,
  round(quantile_cont(hours, 0.75) FILTER (WHERE hours > 0), 6) AS p75_act,
  round(quantile_cont(hours, 0.90) FILTER (WHERE hours > 0), 6) AS p90_act,
  round({ratio('count(*) FILTER (WHERE hours > 0 AND hours >= 1.0/3.0)', 'count(*) FILTER (WHERE hours > 0)')} * 100, 6)
    AS pct_ge20min,
  round({ratio('count(*) FILTER (WHERE hours > 0 AND hours >= 1)', 'count(*) FILTER (WHERE hours > 0)')} * 100, 6)
    AS pct_ge1h,
  CAST(count(*) FILTER (WHERE hours > 0 AND hours >= 1.0/3.0) AS BIGINT) AS n_ge20min,
  (SELECT share FROM ts WHERE abs(pct - 1) < 1e-9) AS share_top1,
  (SELECT share FROM ts WHERE abs(pct - 5) < 1e-9) AS share_top5,
  (SELECT share FROM ts WHERE abs(pct - 10) < 1e-9) AS share_top10
FROM hpu_cur""")
def hours_distribution_q(b):
    return S.hours_distribution(b.cur, b.cfg)


#: Hours of a user in each slice that the user is in.
SLICED_HOURS = f"""
, slices(slice_id) AS (VALUES (0), (1), (2), (3)),
sl AS (SELECT slice_id, CASE WHEN slice_id < 2 THEN brand END AS brand,
         CASE WHEN slice_id IN (0, 2) THEN population END AS population, user_id, {dsum0('hours')} AS hours
       FROM cur, slices WHERE user_id IS NOT NULL GROUP BY ALL)"""


def _sliced_distribution_sql() -> str:
    act = "count(*) FILTER (WHERE hours > 0)"
    tops = ", ".join(f"""round(CASE WHEN {dsum0('hours')} > 0 THEN {dsum(f'CASE WHEN rn <= greatest(1, round_even(n * {p}, 0)) THEN hours END')}
    / {dsum0('hours')} * 100 END, 6) AS share_top{round(100 * p)}""" for p in (0.01, 0.05, 0.10))
    quantiles = ", ".join(f"round(quantile_cont(hours, {p}) FILTER (WHERE hours > 0), 6) AS {n}"
                          for n, p in (("median_act", 0.5), ("p25_act", 0.25), ("p75_act", 0.75), ("p90_act", 0.9)))
    return SLICED_HOURS + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY slice_id, brand, population ORDER BY hours DESC) AS rn,
        CAST(count(*) OVER (PARTITION BY slice_id, brand, population) AS DOUBLE) AS n FROM sl)
SELECT CAST(slice_id AS INTEGER) AS slice_id, brand, population, CAST(count(*) AS BIGINT) AS n_users,
  CAST({act} AS BIGINT) AS n_activated, round({ratio(act, 'count(*)')} * 100, 6) AS pct_activated,
  round({dsum0('hours')}, 6) AS hours_total, round({ratio(dsum('hours'), 'count(*)')}, 6) AS mean_all,
  round(quantile_cont(hours, 0.5), 6) AS median_all,
  round({ratio(dsum('CASE WHEN hours > 0 THEN hours END'), act)}, 6) AS mean_act, {quantiles},
  round({ratio('count(*) FILTER (WHERE hours > 0 AND hours >= 1.0/3.0)', act)} * 100, 6) AS pct_ge20min,
  round({ratio('count(*) FILTER (WHERE hours >= 1)', act)} * 100, 6) AS pct_ge1h,
  CAST(count(*) FILTER (WHERE hours > 0 AND hours >= 1.0/3.0) AS BIGINT) AS n_ge20min, {tops}
FROM r GROUP BY slice_id, brand, population"""


@report("hours_distribution_slices", sql=_sliced_distribution_sql())
def hours_distribution_slices_q(b):
    return S.hours_distribution_slices(b.cur, b.cfg)


@report("segment_slices", sql=SLICED_HOURS + f""",
sg AS (SELECT slice_id, brand, population, {segment_case('hours')} AS segment FROM sl),
present AS (SELECT DISTINCT slice_id, brand, population FROM sl)
SELECT CAST(p.slice_id AS INTEGER) AS slice_id, p.brand, p.population, v.segment, CAST(count(sg.segment) AS BIGINT) AS users
FROM present p CROSS JOIN {values('segment', ('No activados',) + SEGMENT_ORDER)}
LEFT JOIN sg ON sg.slice_id = p.slice_id AND sg.brand IS NOT DISTINCT FROM p.brand
  AND sg.population IS NOT DISTINCT FROM p.population AND sg.segment = v.segment
GROUP BY 1, 2, 3, 4""")
def segment_slices_q(b):
    return S.segment_slices(b.cur, b.cfg)


@report("max_progress", sql="SELECT user_id, course_id, progress FROM mp_cur")
def max_progress_q(b):
    return S.max_progress(b.cur, b.cfg)


@report("progress_distribution", sql="""
SELECT progress, CAST(count(*) AS BIGINT) AS pairs,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM mp_cur), 6) AS share
FROM mp_cur GROUP BY progress""")
def progress_distribution_q(b):
    return S.progress_distribution(b.cur, b.cfg)


@report("progress_summary", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS pairs,
  round({ratio('count(*) FILTER (WHERE progress < 20)', 'count(*)')}, 6) AS pct_below20,
  round({ratio('count(*) FILTER (WHERE progress >= 80)', 'count(*)')}, 6) AS pct_at_least80
FROM mp_cur""")
def progress_summary_q(b):
    return S.progress_summary(b.cur, b.cfg)


def _progress_by_brand_sql(cfg):
    brands = ", ".join(q(x) for x in cfg.reported_brands)
    vals = [v for _, v in cfg.progress_bands]
    shares = ", ".join(
        f"round(coalesce({ratio(f'g.n{v}', 'g.pairs')}, 0.0), 6) AS share_{v}" for v in vals)
    ns = ", ".join(f"count(*) FILTER (WHERE progress = {v}) AS n{v}" for v in vals)
    return f"""
, present AS (SELECT DISTINCT brand FROM cur WHERE brand IN ({brands})),
mpb AS (SELECT brand, user_id, course_id, max(progress) AS progress FROM cur
        WHERE user_id IS NOT NULL AND brand IN ({brands}) GROUP BY 1, 2, 3 HAVING max(progress) IS NOT NULL),
g AS (SELECT brand, count(*) AS pairs, {ns} FROM mpb GROUP BY brand)
SELECT present.brand, CAST(coalesce(g.pairs, 0) AS BIGINT) AS pairs, {shares}
FROM present LEFT JOIN g ON present.brand = g.brand"""


@report("progress_by_brand", sql=_progress_by_brand_sql)
def progress_by_brand_q(b):
    return S.progress_by_brand(b.cur, b.cfg)


def funnel_sql(src: str, cfg, name: str = "fz", roster: str = "roster") -> str:
    t = 1.0 / 3.0 if abs(cfg.twenty_minutes - 1.0 / 3.0) < 1e-15 else cfg.twenty_minutes
    tx = "1.0/3.0" if t == 1.0 / 3.0 else repr(t)
    return f"""
, {name}_f AS (SELECT count(*) AS enrolled, count(*) FILTER (WHERE hours > 0) AS gt0,
    count(*) FILTER (WHERE hours >= {tx}) AS ge20, count(*) FILTER (WHERE hours >= 1) AS ge1,
    count(*) FILTER (WHERE hours >= 5) AS ge5 FROM {src}),
{name}_l AS (SELECT count(DISTINCT user_id) AS lic FROM {roster}),
{name}_r AS (
  SELECT 0 AS step, 'licensed' AS stage, lic AS users, 'roster' AS source FROM {name}_l, {name}_f
    WHERE lic > 0 AND lic >= enrolled
  UNION ALL SELECT 1, 'enrolled', enrolled, 'snapshot' FROM {name}_f
  UNION ALL SELECT 2, 'hours_gt_0', gt0, 'snapshot' FROM {name}_f
  UNION ALL SELECT 3, 'hours_ge_20min', ge20, 'snapshot' FROM {name}_f
  UNION ALL SELECT 4, 'hours_ge_1h', ge1, 'snapshot' FROM {name}_f
  UNION ALL SELECT 5, 'hours_ge_5h', ge5, 'snapshot' FROM {name}_f),
{name} AS (
  SELECT step, stage, CAST(users AS BIGINT) AS users, source,
    round({ratio('users', 'first_value(users) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} * 100, 6) AS pct_base,
    round({ratio('users', 'lag(users) OVER (ORDER BY step)')} * 100, 6) AS pct_step,
    (SELECT (SELECT count(user_id) FROM roster) > 0 AND lic < enrolled FROM {name}_l, {name}_f) AS roster_omitted
  FROM {name}_r)"""


@report("funnel", sql=lambda cfg: funnel_sql("hpu_cur", cfg) + "\nSELECT * FROM fz")
def funnel_q(b):
    return S.funnel(b.cur, b.roster, b.cfg, b.whole_roster)


@report("funnel_compare", sql=lambda cfg: funnel_sql("hpu_cur", cfg, "fc") + funnel_sql("hpu_prev", cfg, "fp") + """
SELECT fc.step, fc.stage, fc.users, fc.pct_base, fc.pct_step, fp.users AS users_prev,
  fp.pct_base AS pct_base_prev, fp.pct_step AS pct_step_prev
FROM fc LEFT JOIN fp ON fc.stage = fp.stage""")
def funnel_compare_q(b):
    return S.funnel_compare(S.funnel(b.cur, b.roster, b.cfg, b.whole_roster), S.funnel(b.prev, b.roster, b.cfg, b.whole_roster))


@report("active_vs_effective", sql=f"""
SELECT side, round(CAST(coalesce(sum(active), 0) AS DOUBLE), 6) AS active_ud,
  round(CAST(coalesce(sum(effective_raw), 0) AS DOUBLE), 6) AS effective_ud,
  round({ratio('sum(effective_raw)', 'sum(active)')} * 100, 6) AS ratio,
  round(avg(active), 6) AS active_day_mean, round(quantile_cont(CAST(active AS DOUBLE), 0.5), 6) AS active_day_median,
  round({ratio('coalesce(sum(effective_raw), 0)', 'count(*)')}, 6) AS effective_day_mean,
  round(quantile_cont(CAST(effective_raw AS DOUBLE), 0.5), 6) AS effective_day_median,
  CAST(count(*) AS BIGINT) AS days
FROM daily_s GROUP BY side""")
def active_vs_effective_q(b):
    return S.active_vs_effective(b.daily_with_side(), b.cfg)


def cert_sql(src: str) -> str:
    return f"""
, pu AS (SELECT user_id, count(*) AS c FROM {src} WHERE certified AND user_id IS NOT NULL GROUP BY user_id)
SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (WHERE certified) AS BIGINT) AS certificates,
  round({ratio('count(*) FILTER (WHERE certified)', 'count(*)')} * 100, 6) AS rate_pair,
  CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  CAST(count(DISTINCT user_id) FILTER (WHERE certified) AS BIGINT) AS users_with_cert,
  round({ratio('count(DISTINCT user_id) FILTER (WHERE certified)', 'count(DISTINCT user_id)')} * 100, 6) AS rate_user,
  (SELECT round(avg(c), 6) FROM pu) AS cert_per_user_mean,
  (SELECT round(quantile_cont(CAST(c AS DOUBLE), 0.5), 6) FROM pu) AS cert_per_user_median,
  CAST(count(*) FILTER (WHERE progress >= 90) AS BIGINT) AS pairs_done,
  round({ratio('count(*) FILTER (WHERE progress >= 90 AND certified)', 'count(*) FILTER (WHERE progress >= 90)')} * 100, 6)
    AS cert_rate_done,
  CAST(count(*) FILTER (WHERE certified AND progress < 20) AS BIGINT) AS incoherent,
  round({ratio(dsum('CASE WHEN certified THEN hours END'), dsum('hours'))} * 100, 6) AS pct_hours_cert
FROM {src}"""


@report("certification", sql=cert_sql("cur"))
def certification_q(b):
    return S.certification(b.cur, b.cfg)


@report("certification_by_period", sql=f"""
SELECT u.period_index, p.label, CAST(count(*) FILTER (WHERE certified) AS BIGINT) AS certificates,
  CAST(count(DISTINCT user_id) FILTER (WHERE certified) AS BIGINT) AS users_with_cert,
  round_even({ratio('count(DISTINCT user_id) FILTER (WHERE certified)', 'count(DISTINCT user_id)')} * 100, 1) AS rate_user,
  round_even({ratio('count(*) FILTER (WHERE certified)', 'count(*)')} * 100, 2) AS rate_pair
FROM usage u JOIN periods p ON u.period_index = p.period_index GROUP BY u.period_index, p.label""")
def certification_by_period_q(b):
    return S.certification_by_period(b.usage, b.periods, b.cfg)


def _cert_group_sql(col: str) -> str:
    return f"""
SELECT '{col}' AS group_column, g.{col} AS group_value, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
  CAST(count(*) FILTER (WHERE certified) AS BIGINT) AS certificates,
  CAST(count(DISTINCT user_id) FILTER (WHERE certified) AS BIGINT) AS users_with_cert,
  round_even({ratio('count(DISTINCT user_id) FILTER (WHERE certified)', 'count(DISTINCT user_id)')} * 100, 1) AS rate_user,
  (SELECT round_even(avg(c), 2) FROM (SELECT count(*) AS c FROM cur x WHERE x.certified AND x.user_id IS NOT NULL
     AND x.{col} = g.{col} GROUP BY x.user_id)) AS cert_per_user_mean,
  (SELECT round(quantile_cont(CAST(c AS DOUBLE), 0.5), 6) FROM (SELECT count(*) AS c FROM cur x WHERE x.certified
     AND x.user_id IS NOT NULL AND x.{col} = g.{col} GROUP BY x.user_id)) AS cert_per_user_median
FROM cur g WHERE g.{col} IS NOT NULL GROUP BY g.{col}"""


@report("certification_by_group", order=("-certificates", "group_value"), within=("group_column",), sql="\n".join(
    [_cert_group_sql("brand"), "UNION ALL", _cert_group_sql("center"), "UNION ALL", _cert_group_sql("level")]))
def certification_by_group_q(b):
    parts = [S.certification_by_group(b.cur, c, b.cfg) for c in ("brand", "center", "level")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- catalogue (2.D)
from ..functions.names import normalise_text  # noqa: E402
from ..operators import catalog as K  # noqa: E402
from ..operators import paths as PT  # noqa: E402

_CATALOG_SQL = f"""
, cat AS (
  SELECT course_id, max(course_name) AS course_name, {dsum0('hours')} AS hours, count(*) AS enrolments,
    count(DISTINCT user_id) AS users, count(*) FILTER (WHERE certified) AS certificates,
    avg(progress) AS progress_mean, quantile_cont(progress, 0.5) AS progress_median,
    min(template) AS template, min(course_created) AS created
  FROM cur GROUP BY course_id),
pv AS (SELECT course_id, {dsum0('hours')} AS hours_prev FROM prev GROUP BY course_id),
catx AS (
  SELECT cat.course_id, course_name, round(hours, 6) AS hours, CAST(enrolments AS BIGINT) AS enrolments,
    CAST(users AS BIGINT) AS users, CAST(certificates AS BIGINT) AS certificates,
    round(progress_mean, 6) AS progress_mean, round(progress_median, 6) AS progress_median, template, created,
    round({ratio('hours', 'users')}, 6) AS hours_per_user,
    CAST(datediff('day', created, (SELECT max(created) FROM cat)) AS INTEGER) AS age_days,
    hours < {{dormant}} AS dormant, round(coalesce(pv.hours_prev, 0.0), 6) AS hours_prev,
    round(hours - coalesce(pv.hours_prev, 0.0), 6) AS delta, hours AS hours_raw
  FROM cat LEFT JOIN pv ON cat.course_id = pv.course_id)"""


def _catalog_sql(cfg):
    return _CATALOG_SQL.replace("{dormant}", repr(float(cfg.dormant_hours)))


@report("course_catalog", order=("-hours", "course_id"), sql=lambda cfg: _catalog_sql(cfg) + "\nSELECT * EXCLUDE (hours_raw) FROM catx")
def course_catalog_q(b):
    return K.course_catalog(b.cur, b.prev, b.cfg)


@report("catalog_cohorts", sql=lambda cfg: _catalog_sql(cfg) + f"""
SELECT CAST(date_trunc('month', created) AS DATE) AS month, CAST(count(*) AS BIGINT) AS courses,
  round({dsum0('hours')}, 6) AS hours, CAST(sum(users) AS BIGINT) AS users,
  CAST(count(*) FILTER (WHERE dormant) AS BIGINT) AS dormant,
  round({dsum0('hours')} / count(*), 6) AS hours_per_course
FROM catx WHERE created IS NOT NULL GROUP BY 1""")
def catalog_cohorts_q(b):
    return K.catalog_cohorts(K.course_catalog(b.cur, b.prev, b.cfg))


@report("catalog_summary", sql=lambda cfg: _catalog_sql(cfg) + f"""
, tot AS (SELECT {dsum0('hours')} AS t FROM catx),
rk AS (SELECT hours, row_number() OVER (ORDER BY hours DESC) AS rn FROM catx)
SELECT CAST(count(*) AS BIGINT) AS courses, CAST(count(*) FILTER (WHERE dormant) AS BIGINT) AS dormant,
  round({dsum0('hours')}, 6) AS hours_total,
  round(CASE WHEN (SELECT t FROM tot) <> 0 THEN (SELECT {dsum0('hours')} FROM rk WHERE rn <= 5) / (SELECT t FROM tot) * 100 END, 6)
    AS share_top5,
  round(CASE WHEN (SELECT t FROM tot) <> 0 THEN (SELECT {dsum0('hours')} FROM rk WHERE rn <= 10) / (SELECT t FROM tot) * 100 END, 6)
    AS share_top10,
  round({ratio(dsum('hours'), 'count(*)')}, 6) AS hours_mean, round(quantile_cont(hours, 0.5), 6) AS hours_median
FROM catx""")
def catalog_summary_q(b):
    return K.catalog_summary(K.course_catalog(b.cur, b.prev, b.cfg), b.cfg)


@report("template_performance", order=("-hours", "template"), sql=f"""
, g AS (SELECT template, {dsum0('hours')} AS hours, count(*) AS enrolments, count(DISTINCT user_id) AS users,
          count(DISTINCT course_id) AS courses FROM cur WHERE template IS NOT NULL GROUP BY 1),
pu AS (SELECT template, user_id, {dsum0('hours')} AS h FROM cur WHERE template IS NOT NULL AND user_id IS NOT NULL
       GROUP BY 1, 2),
med AS (SELECT template, quantile_cont(h, 0.5) AS m FROM pu GROUP BY 1),
pr AS (SELECT template, user_id, course_id, max(progress) AS p FROM cur
       WHERE template IS NOT NULL AND progress IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2, 3),
av AS (SELECT template, {ratio('count(*) FILTER (WHERE p < 20)', 'count(*)')} * 100 AS lo,
         {ratio('count(*) FILTER (WHERE p >= 80)', 'count(*)')} * 100 AS hi FROM pr GROUP BY 1)
SELECT g.template, round(hours, 6) AS hours, CAST(enrolments AS BIGINT) AS enrolments, CAST(users AS BIGINT) AS users,
  CAST(courses AS BIGINT) AS courses, round(hours / enrolments, 6) AS hours_per_enrolment,
  round(med.m, 6) AS hours_per_user_median, round(av.lo, 6) AS pct_below20, round(av.hi, 6) AS pct_at_least80
FROM g LEFT JOIN med ON g.template = med.template LEFT JOIN av ON g.template = av.template""")
def template_performance_q(b):
    return K.template_performance(b.cur, b.cfg)


def _group_sql(col: str) -> str:
    return f"""
SELECT * FROM (
  WITH uh AS (SELECT {col} AS gv, user_id, {dsum0('hours')} AS h, max(CAST(certified AS INTEGER)) AS cert
              FROM cur WHERE {col} IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2),
  lic AS (SELECT {col} AS gv, count(DISTINCT user_id) AS licences FROM roster WHERE {col} IS NOT NULL GROUP BY 1),
  g AS (SELECT gv, count(*) AS users, {dsum0('h')} AS hours, {ratio(dsum('h'), 'count(*)')} AS mean,
          quantile_cont(h, 0.5) AS median, count(*) FILTER (WHERE h > 0) AS activated,
          {ratio(dsum('CASE WHEN h > 0 THEN h END'), 'count(*) FILTER (WHERE h > 0)')} AS mean_act,
          quantile_cont(h, 0.5) FILTER (WHERE h > 0) AS median_act,
          count(*) FILTER (WHERE cert = 1) AS users_with_cert FROM uh GROUP BY gv)
  SELECT g.gv AS group_value, '{col}' AS group_column, CAST(users AS BIGINT) AS users, round(hours, 6) AS hours,
    round(mean, 6) AS mean, round(median, 6) AS median, CAST(activated AS BIGINT) AS activated,
    round({ratio('activated', 'users')} * 100, 6) AS pct_activated, round(mean_act, 6) AS mean_act,
    round(median_act, 6) AS median_act, CAST(users_with_cert AS BIGINT) AS users_with_cert,
    CAST(licences AS BIGINT) AS licences, round({ratio('users', 'licences')} * 100, 6) AS pct_licence_enrolled,
    round({ratio('activated', 'licences')} * 100, 6) AS pct_licence_effective
  FROM g LEFT JOIN lic ON g.gv = lic.gv)"""


@report("group_breakdown", order=("-hours", "group_value"), within=("group_column",), sql="\n".join([_group_sql("center"), "UNION ALL", _group_sql("level")]))
def group_breakdown_q(b):
    return K.group_breakdown(b.cur, b.roster, ("center", "level"), b.cfg)


# ---------------------------------------------------------------- rankings (2.E)
_DELTA_SQL = f"""
, cd AS (
  SELECT course_id, arg_max(course_name, period_index) AS course_name,
    {dsum0(_side('hours', 'cur'))} AS hc, {dsum0(_side('hours', 'prev'))} AS hp
  FROM usage_s GROUP BY course_id),
delta AS (SELECT course_id, course_name, round(hc, 6) AS hours_cur, round(hp, 6) AS hours_prev,
            round(hc - hp, 6) AS delta, hc, hp, hc - hp AS d FROM cd)"""


@report("course_hours_delta", sql=_DELTA_SQL + "\nSELECT course_id, course_name, hours_cur, hours_prev, delta FROM delta")
def course_hours_delta_q(b):
    return K.course_hours_delta(b.with_side(), b.cfg)


@report("top_courses_hours", sql=lambda cfg: _DELTA_SQL + f"""
SELECT course_id, course_name, hours_cur, hours_prev, delta FROM delta ORDER BY hc DESC, course_id LIMIT {cfg.top_n}""")
def top_courses_hours_q(b):
    return K.top_courses_hours(K.course_hours_delta(b.with_side(), b.cfg), b.cfg)


@report("top_gainers", sql=lambda cfg: _DELTA_SQL + f"""
SELECT course_id, course_name, hours_cur, hours_prev, delta FROM delta WHERE hours_prev >= 1
ORDER BY d DESC, course_id LIMIT {cfg.top_n}""")
def top_gainers_q(b):
    return K.top_gainers(K.course_hours_delta(b.with_side(), b.cfg), b.cfg)


@report("top_losers", sql=lambda cfg: _DELTA_SQL + f"""
SELECT course_id, course_name, hours_cur, hours_prev, delta FROM delta WHERE hours_prev >= 1
ORDER BY d, course_id LIMIT {cfg.top_n}""")
def top_losers_q(b):
    return K.top_losers(K.course_hours_delta(b.with_side(), b.cfg), b.cfg)


_CU_SQL = f"""
, c AS (SELECT course_id, max(course_name) AS course_name, count(DISTINCT user_id) AS users_cur,
          {dsum('hours')} AS hours_cur FROM cur WHERE hours > 0 GROUP BY course_id),
p AS (SELECT course_id, count(DISTINCT user_id) AS users_prev, {dsum('hours')} AS hours_prev
      FROM prev WHERE hours > 0 GROUP BY course_id),
cu AS (SELECT c.course_id, c.course_name, CAST(users_cur AS BIGINT) AS users_cur, round(hours_cur, 6) AS hours_cur,
         CAST(coalesce(users_prev, 0) AS BIGINT) AS users_prev, round(coalesce(hours_prev, 0.0), 6) AS hours_prev,
         CAST(users_cur - coalesce(users_prev, 0) AS BIGINT) AS delta_users
       FROM c LEFT JOIN p ON c.course_id = p.course_id WHERE users_cur > 0)"""


@report("course_users", order=("-users_cur", "course_id"), sql=_CU_SQL + "\nSELECT * FROM cu")
def course_users_q(b):
    return K.course_users(b.with_side(), b.cfg)


@report("course_users_summary", sql=_CU_SQL + """
SELECT CAST(count(*) AS BIGINT) AS courses, round(quantile_cont(CAST(users_cur AS DOUBLE), 0.5), 6) AS median_users,
  CAST(count(*) FILTER (WHERE users_cur = 1) AS BIGINT) AS single_user_courses FROM cu""")
def course_users_summary_q(b):
    return K.course_users_summary(K.course_users(b.with_side(), b.cfg), b.cfg)


@report("course_users_extremes", sql=lambda cfg: _CU_SQL + f"""
SELECT * FROM (SELECT *, 'top' AS kind FROM cu ORDER BY users_cur DESC, course_id LIMIT {cfg.top_n})
UNION ALL
SELECT * FROM (SELECT *, 'bottom' AS kind FROM cu ORDER BY users_cur, course_id DESC LIMIT {cfg.top_n})""")
def course_users_extremes_q(b):
    return K.course_users_extremes(K.course_users(b.with_side(), b.cfg), b.cfg)


# ---------------------------------------------------------------- paths (2.D)
def _norm_sql(x: str) -> str:
    ascii_ = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({ascii_}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _path_sql(cfg) -> str:
    norm: dict = {}
    for t in cfg.path_targets:
        norm[normalise_text(t)] = t
    order = {t: i for i, t in enumerate(cfg.path_targets)}
    whens = [f"WHEN n = {q(k)} THEN {q(v)}" for k, v in norm.items()]
    whens += [f"WHEN contains(n, {q(k)}) THEN {q(v)}" for k, v in norm.items() if k]
    case = "CASE " + " ".join(whens) + " END" if whens else "NULL"
    ocase = "CASE target " + " ".join(f"WHEN {q(t)} THEN {i}" for t, i in order.items()) + " END"
    return f"""
, names AS (SELECT DISTINCT course_name, {_norm_sql('course_name')} AS n FROM cur WHERE course_name IS NOT NULL),
pm AS (SELECT course_name, n AS normalised, {case} AS target FROM names),
pmo AS (SELECT *, CAST({ocase} AS INTEGER) AS target_order FROM pm),
er AS (SELECT u.*, pmo.target, pmo.target_order FROM cur u JOIN pmo ON u.course_name = pmo.course_name
       WHERE pmo.target IS NOT NULL),
ut AS (SELECT user_id, target, max(progress) AS p, max(CAST(hours > 0 AS INTEGER)) AS consumed,
         {dsum0('hours')} AS hours FROM er WHERE user_id IS NOT NULL GROUP BY 1, 2),
pu AS (SELECT user_id, count(*) FILTER (WHERE consumed = 1) AS consumed, count(*) AS enrolled,
         count(*) FILTER (WHERE p >= 90) AS completed, {dsum0('hours')} AS hours FROM ut GROUP BY 1)"""


@report("path_match", sql=lambda cfg: _path_sql(cfg) + "\nSELECT course_name, normalised, target, target_order FROM pmo")
def path_match_q(b):
    return PT.path_match(b.cur, b.cfg)


@report("path_by_course", sql=lambda cfg: _path_sql(cfg) + f"""
, g AS (SELECT target, target_order, count(DISTINCT user_id) AS users, {dsum0('hours')} AS hours,
          count(*) FILTER (WHERE certified) AS certificates, avg(progress) AS pm,
          quantile_cont(progress, 0.5) AS pmed FROM er GROUP BY 1, 2),
dn AS (SELECT target, {ratio('count(*) FILTER (WHERE p >= 90)', 'count(*)')} * 100 AS completed_pct FROM ut GROUP BY 1)
SELECT g.target, target_order, CAST(users AS BIGINT) AS users, round(hours, 6) AS hours,
  CAST(certificates AS BIGINT) AS certificates, round(pm, 6) AS progress_mean, round(pmed, 6) AS progress_median,
  round(completed_pct, 6) AS completed_pct
FROM g LEFT JOIN dn ON g.target = dn.target""")
def path_by_course_q(b):
    return PT.path_by_course(b.cur, b.cfg)


@report("path_coverage", sql=lambda cfg: _path_sql(cfg) + f"""
SELECT CAST(count(*) AS BIGINT) AS users, round(avg(consumed), 6) AS coverage_mean,
  round(quantile_cont(CAST(consumed AS DOUBLE), 0.5), 6) AS coverage_median,
  round(avg(completed), 6) AS completed_mean, round(quantile_cont(CAST(completed AS DOUBLE), 0.5), 6) AS completed_median,
  CAST(count(*) FILTER (WHERE completed >= {len(cfg.path_targets)}) AS BIGINT) AS finished_all,
  round({ratio(dsum('hours'), 'count(*)')}, 6) AS hours_mean, round(quantile_cont(hours, 0.5), 6) AS hours_median,
  round({dsum0('hours')}, 6) AS hours_total,
  round(avg(enrolled), 6) AS enrolled_mean, round(quantile_cont(CAST(enrolled AS DOUBLE), 0.5), 6) AS enrolled_median,
  CAST(count(*) FILTER (WHERE consumed > 0) AS BIGINT) AS users_with_consumption,
  round(CASE WHEN (SELECT {dsum0('hours')} FROM cur) <> 0
        THEN {dsum0('hours')} / (SELECT {dsum0('hours')} FROM cur) * 100 END, 6) AS pct_platform_hours
FROM pu""")
def path_coverage_q(b):
    return PT.path_coverage(b.cur, b.cfg)


@report("path_distributions", sql=lambda cfg: _path_sql(cfg) + """
SELECT 'consumed' AS kind, CAST(consumed AS BIGINT) AS n_targets, CAST(count(*) AS BIGINT) AS users FROM pu GROUP BY 2
UNION ALL
SELECT 'completed' AS kind, CAST(completed AS BIGINT) AS n_targets, CAST(count(*) AS BIGINT) AS users FROM pu GROUP BY 2""")
def path_distributions_q(b):
    return PT.path_distributions(b.cur, b.cfg)


@report("path_not_found", sql=lambda cfg: _path_sql(cfg) + f"""
SELECT v.target, v.ord AS target_order FROM {values('target', cfg.path_targets)}
WHERE v.target NOT IN (SELECT DISTINCT target FROM er)""")
def path_not_found_q(b):
    return PT.path_not_found(b.cur, b.cfg)


@report("path_found", sql=lambda cfg: _path_sql(cfg) + f"""
SELECT CAST(count(*) AS BIGINT) AS targets, CAST(count(*) FILTER (WHERE v.target IN (SELECT DISTINCT target FROM er)) AS BIGINT) AS found
FROM {values('target', cfg.path_targets)}""")
def path_found_q(b):
    return PT.path_found(b.cur, b.cfg)
