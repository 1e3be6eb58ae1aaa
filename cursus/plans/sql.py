"""SQL twins of the canonical tables, for the DuckDB oracle.

``prefix(cfg)`` returns a WITH-list over the driver's views (customer, orders,
lineitem, part, nation, region) that rebuilds usage, daily, roster, the period
dimension and the user x period panel exactly as the Spark side does. Oracle
queries append their own CTEs and a final SELECT. Where it is cheap, the
oracles use set formulations (EXISTS / anti joins) instead of the windows the
Spark side uses, so the check is independent.
"""

from __future__ import annotations

from ..config import MONTH_ABBR, Config

DEC = "DECIMAL(38,12)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dsum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS {DEC})) AS DOUBLE)"


def dsum0(x: str) -> str:
    return f"coalesce({dsum(x)}, 0.0)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def ratio(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def brand_case(user: str, cfg: Config) -> str:
    u = f"lower(coalesce({user}, 'nan'))"
    whens = " ".join(f"WHEN contains({u}, {q(k)}) THEN {q(v)}" for k, v in cfg.brand_rules)
    return f"CASE {whens} ELSE {q(cfg.other_brand)} END"


def center_case(user: str, cfg: Config) -> str:
    last = f"(string_split(coalesce({user}, 'nan'), '@'))[-1]"
    dom = f"lower({strip(last)})"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in cfg.domain_center)
    return f"CASE {dom} {whens} ELSE {q(cfg.other_center)} END"


def level_case(level: str, cfg: Config) -> str:
    s = f"replace(lower({strip(f'coalesce({level}, {q(str())})')}), ' ,', ',')"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in cfg.level_map)
    return f"CASE {s} {whens} ELSE 'Sin dato' END"


def progress_case(band: str, cfg: Config) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {float(v)}" for k, v in cfg.progress_bands)
    return f"CAST(CASE {band} {whens} ELSE NULL END AS DOUBLE)"


def period_of(day: str, cfg: Config) -> str:
    if cfg.grain == "quarter":
        return f"CAST(year({day}) * 4 + quarter({day}) - 1 AS INTEGER)"
    return f"CAST(year({day}) * 12 + month({day}) - 1 AS INTEGER)"


def period_end(day: str, cfg: Config) -> str:
    if cfg.grain == "quarter":
        return f"last_day(CAST(date_trunc('quarter', {day}) AS DATE) + INTERVAL 2 MONTH)"
    return f"last_day({day})"


def period_label(idx: str, cfg: Config) -> str:
    if cfg.grain == "quarter":
        return (f"('Q' || CAST({idx} % 4 + 1 AS VARCHAR) || '-' || "
                f"lpad(CAST(({idx} // 4) % 100 AS VARCHAR), 2, '0'))")
    names = "[" + ", ".join(q(m) for m in MONTH_ABBR) + "]"
    return (f"(CASE WHEN {idx} <= 12 THEN {names}[{idx}] ELSE {names}[{idx} % 12 + 1] || '-' || "
            f"lpad(CAST(({idx} // 12) % 100 AS VARCHAR), 2, '0') END)")


def segment_case(h: str) -> str:
    return (f"CASE WHEN {h} = 0 THEN 'No activados' WHEN {h} <= 1 THEN 'Exploradores' "
            f"WHEN {h} <= 5 THEN 'Constantes' WHEN {h} <= 20 THEN 'Intensivos' ELSE 'Power users' END")


def values(col: str, items, alias: str = "v") -> str:
    """A literal one-column table (labels with their order)."""
    rows = ", ".join(f"({q(x)}, {i})" for i, x in enumerate(items))
    return f"(VALUES {rows}) AS {alias}({col}, ord)"


def prefix(cfg: Config) -> str:
    grain_idx = ("CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER)"
                 if cfg.grain == "quarter" else
                 "CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER)")
    return f"""WITH people AS (
  SELECT c_custkey AS k,
    CASE WHEN c_custkey % 97 = 5 THEN 'Test' WHEN c_custkey % 50 = 1 THEN 'asima' ELSE 'c' END
      || CAST(c_custkey AS VARCHAR) || '@' ||
    CASE r_name WHEN 'AFRICA' THEN 'afri.example' WHEN 'AMERICA' THEN 'amer.example' WHEN 'ASIA' THEN 'asi.example'
                WHEN 'EUROPE' THEN 'euro.example' ELSE 'me.example' END AS user_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Superior' WHEN 'BUILDING' THEN ' medioSuperior'
         WHEN 'FURNITURE' THEN 'LICENCIATURA' WHEN 'HOUSEHOLD' THEN 'MedioSuperior ,Superior' ELSE NULL END AS level_raw
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
usage_raw AS (
  SELECT p.user_id, p.level_raw, p_brand AS course_id, 'Curso ' || p_brand AS course_name, p_type AS template,
    CAST(DATE '1995-01-01' + CAST(substr(p_brand, 7) AS INTEGER) * 45 AS DATE) AS course_created,
    CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE CAST(l_quantity AS DOUBLE) / 10 END AS hours,
    CAST(l_linenumber AS DOUBLE) AS contents,
    CASE WHEN round(l_discount * 100) < 3 THEN 'Entre 0% y 20%' WHEN round(l_discount * 100) < 5 THEN 'Entre 20% y 50%'
         WHEN round(l_discount * 100) < 8 THEN 'Entre 50% y 80%' WHEN round(l_discount * 100) < 10 THEN 'Entre 80% y 100%'
         ELSE NULL END AS progress_band,
    CASE WHEN l_linestatus = 'F' AND round(l_discount * 100) >= 8 THEN ' Si ' WHEN l_linenumber = 7 THEN 'SI'
         WHEN l_linestatus = 'F' THEN 'No' ELSE NULL END AS certified_raw,
    {grain_idx} AS period_index,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS period_month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN people p ON o_custkey = p.k),
usage AS (
  SELECT user_id, course_id, course_name, template, course_created, hours, contents, progress_band, certified_raw,
    period_index, period_month,
    {brand_case('user_id', cfg)} AS brand,
    {center_case('user_id', cfg)} AS center,
    {level_case('level_raw', cfg)} AS level,
    CASE WHEN {level_case('level_raw', cfg)} = 'Docentes' THEN 'Docentes' ELSE 'Alumnos' END AS population,
    {progress_case('progress_band', cfg)} AS progress,
    coalesce(lower({strip('certified_raw')}) = 'si', false) AS certified
  FROM usage_raw WHERE NOT regexp_matches(coalesce(user_id, 'nan'), {q(cfg.test_pattern)}, 'i')),
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS hours,
    CAST(count(*) AS BIGINT) AS contents, CAST(count(DISTINCT o_custkey) AS BIGINT) AS active,
    CAST(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS BIGINT) AS effective_raw,
    CAST(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS DOUBLE) / {float(cfg.effective_divisor)} AS effective
  FROM orders GROUP BY 1),
roster AS (
  SELECT user_id, {brand_case('user_id', cfg)} AS brand, {center_case('user_id', cfg)} AS center,
    {level_case('level_raw', cfg)} AS level,
    CASE WHEN {level_case('level_raw', cfg)} = 'Docentes' THEN 'Docentes' ELSE 'Alumnos' END AS population
  FROM people WHERE NOT regexp_matches(coalesce(user_id, 'nan'), {q(cfg.test_pattern)}, 'i')),
dper AS (
  SELECT {period_of('day', cfg)} AS period_index, max(day) AS last_day FROM daily GROUP BY 1),
dcomplete AS (
  SELECT period_index FROM dper
  WHERE period_index < (SELECT max(period_index) FROM dper) OR last_day >= {period_end('last_day', cfg)}),
pdim AS (
  SELECT u.period_index, (c.period_index IS NOT NULL) AS complete
  FROM (SELECT DISTINCT period_index FROM usage) u LEFT JOIN dcomplete c ON u.period_index = c.period_index),
periods AS (
  SELECT period_index,
    CAST(row_number() OVER (ORDER BY period_index) - 1 AS INTEGER) AS pos,
    {period_label('period_index', cfg)} || CASE WHEN complete THEN '' ELSE '*' END AS label,
    NOT complete AS partial,
    CASE WHEN complete AND row_number() OVER (PARTITION BY complete ORDER BY period_index DESC) = 1 THEN 'cur'
         WHEN complete AND row_number() OVER (PARTITION BY complete ORDER BY period_index DESC) = 2 THEN 'prev' END AS side,
    CAST(count(*) OVER () - 1 AS INTEGER) AS max_pos
  FROM pdim),
cur AS (SELECT * FROM usage WHERE period_index = (SELECT period_index FROM periods WHERE side = 'cur')),
prev AS (SELECT * FROM usage WHERE period_index = (SELECT period_index FROM periods WHERE side = 'prev')),
usage_s AS (SELECT u.*, p.side FROM usage u JOIN periods p ON u.period_index = p.period_index WHERE p.side IS NOT NULL),
daily_s AS (
  SELECT d.*, p.side FROM daily d JOIN periods p ON {period_of('d.day', cfg)} = p.period_index
  WHERE p.side IS NOT NULL),
hpu_cur AS (SELECT user_id, {dsum0('hours')} AS hours FROM cur WHERE user_id IS NOT NULL GROUP BY 1),
hpu_prev AS (SELECT user_id, {dsum0('hours')} AS hours FROM prev WHERE user_id IS NOT NULL GROUP BY 1),
mp_cur AS (
  SELECT user_id, course_id, max(progress) AS progress FROM cur WHERE user_id IS NOT NULL
  GROUP BY 1, 2 HAVING max(progress) IS NOT NULL),
mp_prev AS (
  SELECT user_id, course_id, max(progress) AS progress FROM prev WHERE user_id IS NOT NULL
  GROUP BY 1, 2 HAVING max(progress) IS NOT NULL),
panel AS (
  SELECT u.user_id, u.period_index, p.pos, p.label, p.max_pos, {dsum0('u.hours')} AS hours,
    min(u.brand) AS brand, min(u.population) AS population
  FROM usage u JOIN periods p ON u.period_index = p.period_index
  WHERE u.user_id IS NOT NULL
  GROUP BY u.user_id, u.period_index, p.pos, p.label, p.max_pos),
act AS (SELECT * FROM panel WHERE hours > 0),
firsts AS (SELECT user_id, min(pos) AS first_pos FROM act GROUP BY user_id),
actx AS (
  SELECT a.*, (a.pos = f.first_pos) AS is_new,
    EXISTS (SELECT 1 FROM act b WHERE b.user_id = a.user_id AND b.pos = a.pos - 1) AS is_recurring,
    EXISTS (SELECT 1 FROM act b WHERE b.user_id = a.user_id AND b.pos = a.pos + 1) AS returns_next
  FROM act a JOIN firsts f ON a.user_id = f.user_id)"""
