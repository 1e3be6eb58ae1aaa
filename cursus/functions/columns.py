"""Row-level projections as native Column expressions (no UDFs).

Every function maps Columns to a Column so that Catalyst can fold, push down
and code-generate them inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ACTIVATED, MONTH_ABBR, NO_LEVEL, NOT_ACTIVATED, SEGMENT_ORDER, STUDENTS, TEACHERS, Config


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(x: Column) -> Column:
    # Python's str.strip(): all leading/trailing whitespace, not just spaces.
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _lookup(pairs, key: Column) -> Column:
    """Dictionary lookup through a literal map (folded into the expression)."""
    m = F.create_map(*[F.lit(v) for kv in pairs for v in kv])
    return F.try_element_at(m, key)


def user_text(user) -> Column:
    """The user as text: a missing user is the string 'nan', as after stringifying."""
    return F.coalesce(_c(user).cast("string"), F.lit("nan"))


def is_test_account(user, cfg: Config) -> Column:
    """Case-insensitive regex search of the test pattern (dots stay wildcards)."""
    return user_text(user).rlike("(?i)" + cfg.test_pattern)


def brand_of(user, cfg: Config) -> Column:
    """First rule whose key occurs anywhere in lower(user), in rule order."""
    u = F.lower(user_text(user))
    out = None
    for key, name in cfg.brand_rules:
        cond = u.contains(key)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(cfg.other_brand)) if out is not None else F.lit(cfg.other_brand)


def domain_of(user) -> Column:
    """Text after the last '@', trimmed and lowered."""
    return F.lower(_strip(F.element_at(F.split(user_text(user), "@"), -1)))


def center_of_domain(user, cfg: Config) -> Column:
    return F.coalesce(_lookup(cfg.domain_center, domain_of(user)), F.lit(cfg.other_center))


def fill_center(center, user, cfg: Config) -> Column:
    """Keep a supplied center; null or empty falls back to the domain's center."""
    if center is None:
        return center_of_domain(user, cfg)
    return F.coalesce(F.nullif(_c(center).cast("string"), F.lit("")), center_of_domain(user, cfg))


def normalise_level(level, cfg: Config) -> Column:
    """null->'' -> strip -> lower -> ' ,' becomes ',' -> level map, else 'Sin dato'."""
    if level is None:
        return F.lit(NO_LEVEL)
    s = F.replace(F.lower(_strip(F.coalesce(_c(level).cast("string"), F.lit("")))), F.lit(" ,"), F.lit(","))
    return F.coalesce(_lookup(cfg.level_map, s), F.lit(NO_LEVEL))


def population(level_norm) -> Column:
    return F.when(_c(level_norm) == TEACHERS, F.lit(TEACHERS)).otherwise(F.lit(STUDENTS))


def segment(hours) -> Column:
    """0 -> No activados; <=1; <=5; <=20; else Power users (negatives: Exploradores)."""
    h = _c(hours)
    return (F.when(h == 0, F.lit(NOT_ACTIVATED))
            .when(h <= 1, F.lit(SEGMENT_ORDER[0]))
            .when(h <= 5, F.lit(SEGMENT_ORDER[1]))
            .when(h <= 20, F.lit(SEGMENT_ORDER[2]))
            .otherwise(F.lit(SEGMENT_ORDER[3])))


def activation(hours) -> Column:
    return F.when(_c(hours) == 0, F.lit(NOT_ACTIVATED)).otherwise(F.lit(ACTIVATED))


def progress_value(band, cfg: Config) -> Column:
    """Band text -> 10/35/65/90; unknown -> null."""
    return _lookup(cfg.progress_bands, _c(band).cast("string")).cast("double")


def cert_flag(certified_raw) -> Column:
    return F.coalesce(F.lower(_strip(_c(certified_raw).cast("string"))) == "si", F.lit(False))


def pct_change(cur, prev) -> Column:
    """(cur-prev)/prev*100; null when prev is 0 or null."""
    return F.try_divide(_c(cur) - _c(prev), _c(prev)) * 100.0


def period_of_date(d, grain: str) -> Column:
    d = _c(d)
    if grain == "quarter":
        return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def period_end(d, grain: str) -> Column:
    """Last day of the period containing date d."""
    d = _c(d)
    if grain == "quarter":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return F.last_day(d)


def period_label(idx, grain: str) -> Column:
    """Month grain: index<=12 -> 'Ene'..'Dic', else 'Mmm-yy'. Quarter grain: 'Qn-yy'."""
    i = _c(idx)
    if grain == "quarter":
        return F.concat(F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"), F.lit("-"),
                        F.lpad(F.pmod(F.floor(i / 4), F.lit(100)).cast("string"), 2, "0"))
    names = F.array(*[F.lit(m) for m in MONTH_ABBR])
    short = F.try_element_at(names, i.cast("int"))
    long_ = F.concat(F.element_at(names, (F.pmod(i, F.lit(12)) + 1).cast("int")), F.lit("-"),
                     F.lpad(F.pmod(F.floor(i / 12), F.lit(100)).cast("string"), 2, "0"))
    return F.when(i <= 12, short).otherwise(long_)


def day_month_label(d) -> Column:
    """dd-Mmm with Spanish month abbreviations."""
    names = F.array(*[F.lit(m) for m in MONTH_ABBR])
    return F.concat(F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.lit("-"), F.element_at(names, F.month(d)))


def cutoff_label(d) -> Column:
    """dd-Mmm-yyyy, or 's/d' when there is no date."""
    return F.coalesce(F.concat(day_month_label(d), F.lit("-"), F.year(d).cast("string")), F.lit("s/d"))


def range_label(dmin, dmax) -> Column:
    """'dd-Mmm → dd-Mmm' of the first and last valid day, 's/d' if none."""
    return F.coalesce(F.concat(day_month_label(dmin), F.lit(" → "), day_month_label(dmax)), F.lit("s/d"))


def window_mid_month(dmin, dmax) -> Column:
    """Month of the midpoint min + (max-min)/2 of a date window."""
    return F.month(F.date_add(_c(dmin), F.floor(F.datediff(_c(dmax), _c(dmin)) / 2).cast("int")))


def coerce_date(x) -> Column:
    """Unparsable text becomes null."""
    c = _c(x)
    return F.to_date(F.try_to_timestamp(c.cast("string")))


def pseudonym(user) -> Column:
    """'u_' + first 16 hex digits of SHA-1(user); a missing user stays missing."""
    u = _c(user).cast("string")
    return F.when(u.isNotNull(), F.concat(F.lit("u_"), F.substring(F.sha1(u), 1, 16)))


def pseudonym_code(rank, brand, user) -> Column:
    """'rank. brand · D-' + first 4 chars of the last '_' piece of the user id."""
    tail = F.substring(F.element_at(F.split(_c(user).cast("string"), "_"), -1), 1, 4)
    return F.concat(_c(rank).cast("string"), F.lit(". "), _c(brand), F.lit(" · D-"), tail)
