"""Registered row-level projections and slicing (2.C) with SQL twins.

Projections run over the distinct values they act on (users, level texts,
bands...) derived from the driver's tables, so each check covers every value
present in the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.clean import clean_users
from ..functions.names import normalise_name
from ..operators import catalog as K
from ..operators import population as PO
from ..operators import snapshot as S
from ..operators.slicing import brands_present, filter_brand, slice_cube
from ..sources import fixtures
from .registry import report
from .sql import brand_case, center_case, dsum0, level_case, period_label, progress_case, q, strip


def _users(spark, sf_dir):
    return fixtures.usage_raw(spark, sf_dir).select("user_id", "level").distinct()


@report("clean_users", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT user_id, brand, center, level, population FROM usage""")
def clean_users_q(spark, sf_dir, cfg):
    return clean_users(_users(spark, sf_dir), cfg).select("user_id", "brand", "center", "level", "population").distinct()


@report("brand_of_user", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT user_id, {brand_case('user_id', cfg)} AS brand FROM usage_raw""")
def brand_of_user_q(spark, sf_dir, cfg):
    return _users(spark, sf_dir).select("user_id", C.brand_of(F.col("user_id"), cfg).alias("brand")).distinct()


@report("center_of_domain", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT user_id, lower({strip("(string_split(coalesce(user_id, 'nan'), '@'))[-1]")}) AS domain,
  {center_case('user_id', cfg)} AS center FROM usage_raw""")
def center_of_domain_q(spark, sf_dir, cfg):
    return _users(spark, sf_dir).select("user_id", C.domain_of(F.col("user_id")).alias("domain"),
                                        C.center_of_domain(F.col("user_id"), cfg).alias("center")).distinct()


@report("fill_center", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT user_id, {center_case('user_id', cfg)} AS center FROM usage_raw""")
def fill_center_q(spark, sf_dir, cfg):
    u = fixtures.usage_raw(spark, sf_dir).select("user_id", "center").distinct()
    return u.select("user_id", C.fill_center(F.col("center"), F.col("user_id"), cfg).alias("center")).distinct()


@report("normalise_level", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT level_raw, {level_case('level_raw', cfg)} AS level FROM usage_raw""")
def normalise_level_q(spark, sf_dir, cfg):
    u = fixtures.usage_raw(spark, sf_dir).select(F.col("level").alias("level_raw")).distinct()
    return u.select("level_raw", C.normalise_level(F.col("level_raw"), cfg).alias("level"))


@report("population", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT level_raw, CASE WHEN {level_case('level_raw', cfg)} = 'Docentes' THEN 'Docentes' ELSE 'Alumnos' END
  AS population FROM usage_raw""")
def population_q(spark, sf_dir, cfg):
    u = fixtures.usage_raw(spark, sf_dir).select(F.col("level").alias("level_raw")).distinct()
    return u.select("level_raw", C.population(C.normalise_level(F.col("level_raw"), cfg)).alias("population"))


@report("segment_hours", sql="""
SELECT user_id, period_index, hours, CASE WHEN hours = 0 THEN 'No activados' WHEN hours <= 1 THEN 'Exploradores'
  WHEN hours <= 5 THEN 'Constantes' WHEN hours <= 20 THEN 'Intensivos' ELSE 'Power users' END AS segment FROM panel""")
def segment_hours_q(b):
    return b.panel.select("user_id", "period_index", "hours", C.segment(F.col("hours")).alias("segment"))


@report("progress_value", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT progress_band, {progress_case('progress_band', cfg)} AS progress FROM usage_raw""")
def progress_value_q(spark, sf_dir, cfg):
    u = fixtures.usage_raw(spark, sf_dir).select("progress_band").distinct()
    return u.select("progress_band", C.progress_value(F.col("progress_band"), cfg).alias("progress"))


@report("cert_flag", raw=True, sql=f"""
SELECT DISTINCT certified_raw, coalesce(lower({strip('certified_raw')}) = 'si', false) AS certified FROM usage_raw""")
def cert_flag_q(spark, sf_dir, cfg):
    u = fixtures.usage_raw(spark, sf_dir).select("certified_raw").distinct()
    return u.select("certified_raw", C.cert_flag(F.col("certified_raw")).alias("certified"))


@report("pct_change", sql=f"""
, cd AS (SELECT course_id, {dsum0("CASE WHEN side = 'cur' THEN hours END")} AS hc,
           {dsum0("CASE WHEN side = 'prev' THEN hours END")} AS hp FROM usage_s GROUP BY 1)
SELECT course_id, round((hc - hp) / NULLIF(hp, 0) * 100, 6) AS pct_change FROM cd""")
def pct_change_q(b):
    s = F.col("side")
    from ..functions.aggs import dsum0 as _d, r6
    g = b.with_side().groupBy("course_id").agg(_d(F.when(s == "cur", F.col("hours")), b.cfg).alias("hc"),
                                               _d(F.when(s == "prev", F.col("hours")), b.cfg).alias("hp"))
    return g.select("course_id", r6(C.pct_change(F.col("hc"), F.col("hp"))).alias("pct_change"))


@report("halve_effective", sql="SELECT day, effective_raw, effective FROM daily")
def halve_effective_q(b):
    return b.daily.select("day", "effective_raw", "effective")


@report("period_index", raw=True, sql="""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER)
  AS month_index, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_index FROM orders""")
def period_index_q(spark, sf_dir, cfg):
    d = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", C.period_of_date(F.col("day"), "month").alias("month_index"),
                    C.period_of_date(F.col("day"), "quarter").alias("quarter_index"))


@report("period_label", raw=True, sql=lambda cfg: f"""
SELECT DISTINCT m AS month_index, {period_label('m', type(cfg)(grain='month'))} AS label
FROM (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m FROM orders
      UNION ALL SELECT CAST(month(o_orderdate) AS INTEGER) FROM orders)""")
def period_label_q(spark, sf_dir, cfg):
    o = fixtures.table(spark, sf_dir, "orders")
    m = o.select(C.period_of_date(F.col("o_orderdate"), "month").alias("m")).unionByName(
        o.select(F.month("o_orderdate").cast("int").alias("m")))
    return m.distinct().select(F.col("m").alias("month_index"), C.period_label(F.col("m"), "month").alias("label"))


@report("window_mid_month", sql="""
SELECT d.side, month(min(day) + CAST(floor(datediff('day', min(day), max(day)) / 2) AS INTEGER)) AS mid_month
FROM daily_s d GROUP BY d.side""")
def window_mid_month_q(b):
    g = b.daily_with_side().groupBy("side").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    return g.select("side", C.window_mid_month(F.col("a"), F.col("z")).alias("mid_month"))


@report("normalise_name", sql="""
SELECT DISTINCT course_name,
  trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(course_name), '[^\\x00-\\x7F]', '', 'g')),
       '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalised FROM usage""")
def normalise_name_q(b):
    return b.usage.select("course_name").distinct().withColumn("normalised", normalise_name(F.col("course_name")))


@report("pseudonym_code", sql=lambda cfg: f"""
, th AS (SELECT user_id, brand, {dsum0('hours')} AS hours FROM usage
         WHERE population = 'Docentes' AND hours > 0 AND user_id IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (ORDER BY hours DESC, user_id) AS rn FROM th)
SELECT user_id, CAST(rn AS VARCHAR) || '. ' || brand || ' · D-' || substr((string_split(user_id, '_'))[-1], 1, 4) AS code
FROM rk WHERE rn <= {cfg.teacher_top}""")
def pseudonym_code_q(b):
    return PO.pop_ranking(b.usage, b.cfg).select("user_id", "code")


@report("coerce_dates", raw=True, sql="""
SELECT o_orderkey, CAST(TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS DATE) AS order_day,
  CAST(TRY_CAST(o_orderpriority AS TIMESTAMP) AS DATE) AS priority_day FROM orders""")
def coerce_dates_q(spark, sf_dir, cfg):
    o = fixtures.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.coerce_date(F.col("o_orderdate").cast("string")).alias("order_day"),
                    C.coerce_date(F.col("o_orderpriority")).alias("priority_day"))


@report("pseudonymise", sql="""
SELECT DISTINCT user_id, CASE WHEN user_id IS NOT NULL THEN 'u_' || substr(sha1(user_id), 1, 16) END AS pseudonym
FROM usage""")
def pseudonymise_q(b):
    return b.usage.select("user_id").distinct().withColumn("pseudonym", C.pseudonym(F.col("user_id")))


# ---------------------------------------------------------------- slicing (2.C)
def _brands2(cfg):
    return list(cfg.reported_brands[:2])


@report("filter_brand", sql=lambda cfg: f"""
SELECT brand, CAST(count(*) AS BIGINT) AS rows_, round({dsum0('hours')}, 6) AS hours FROM cur
WHERE brand IN ({", ".join(q(x) for x in _brands2(cfg))}) GROUP BY brand""")
def filter_brand_q(b):
    from ..functions.aggs import dsum0 as _d, n_rows, r6
    u = filter_brand(b.cur, _brands2(b.cfg))
    return u.groupBy("brand").agg(n_rows(u).cast("long").alias("rows_"), r6(_d("hours", b.cfg)).alias("hours"))


def _filter_population_sql(cfg):
    from .reports_period import funnel_sql
    return f"""
, hpu_t AS (SELECT user_id, {dsum0('hours')} AS hours FROM cur
  WHERE user_id IS NOT NULL AND population = 'Docentes' GROUP BY 1),
roster_t AS (SELECT * FROM roster WHERE population = 'Docentes')""" + funnel_sql("hpu_t", cfg, roster="roster_t") + """
SELECT * FROM fz"""


@report("filter_population", sql=_filter_population_sql)
def filter_population_q(b):
    t = b.restrict(population="Docentes")
    return S.funnel(t.cur, t.roster, t.cfg, t.whole_roster)


@report("slice_cube", sql=f"""
, pu AS (SELECT brand, population, user_id, {dsum0('hours')} AS h FROM cur WHERE user_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT brand, population, CAST(grouping(brand, population) AS INTEGER) AS slice_id,
  CAST(count(*) AS BIGINT) AS users, CAST(count(*) FILTER (WHERE h > 0) AS BIGINT) AS activated,
  round({dsum0('h')}, 6) AS hours
FROM pu GROUP BY CUBE (brand, population)""")
def slice_cube_q(b):
    return slice_cube(b.cur, b.cfg)


@report("brands_present", sql=lambda cfg: f"""
SELECT v.brand, v.ord FROM (VALUES {", ".join(f"({q(x)}, {i})" for i, x in enumerate(cfg.reported_brands))}) AS v(brand, ord)
WHERE v.brand IN (SELECT DISTINCT brand FROM panel)""")
def brands_present_q(b):
    return brands_present(b.panel, b.cfg)


@report("course_names", sql="""
SELECT course_id, arg_max(course_name, period_index) AS course_name FROM usage GROUP BY course_id""")
def course_names_q(b):
    return K.course_names(b.usage)
