"""Registry of named reports: a Spark builder and, where expressible, a SQL twin.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame over the
driver's tables mapped to the canonical ones (FIXTURES.md), with
``config.TEST`` as parameters. The SQL twin is the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import TEST, Config
from ..operators.ranking import ranked, ranked_sql
from .base import Base, fixture_base
from .reads import columns_read
from .sql import prefix


@dataclass
class Entry:
    name: str
    build: Callable[[Base], DataFrame]
    sql: Callable[[Config], str] | None
    raw: bool = False   # build takes (spark, sf_dir, cfg) instead of a Base
    order: tuple = ()   # columns of the rank that the report has, and of the groups it counts in
    within: tuple = ()

    def over(self, base: Base) -> DataFrame:
        """The report over the coarsest of the base's tables that answers it."""
        return self.build(base.reading(columns_read(self.name)))


REGISTRY: dict[str, Entry] = {}


def report(name: str, sql: Callable[[Config], str] | str | None = None, raw: bool = False, order: tuple = (),
           within: tuple = ()):
    """Register ``fn(base) -> DataFrame`` (or ``fn(spark, sf_dir, cfg)`` when raw); with an order it gets a rank."""
    def deco(fn):
        s = sql if (sql is None or callable(sql)) else (lambda cfg, _s=sql: _s)
        build = (lambda *a: ranked(fn(*a), order, within)) if order else fn
        REGISTRY[name] = Entry(name, build, s, raw, order, within)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str, cfg: Config = TEST) -> DataFrame:
    e = REGISTRY[name]
    if e.raw:
        return e.build(spark, sf_dir, cfg)
    return e.over(fixture_base(spark, sf_dir, cfg))


def run_on(name: str, base: Base, spark: SparkSession | None = None, sf_dir: str | None = None) -> DataFrame:
    """Build a report over an existing (e.g. materialised) base."""
    e = REGISTRY[name]
    if e.raw:
        return e.build(spark, sf_dir, base.cfg)
    return e.over(base)


def oracle(name: str, cfg: Config = TEST) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    sql = prefix(cfg) + "\n" + e.sql(cfg)
    return ranked_sql(sql, e.order, e.within) if e.order else sql


def load_all() -> dict[str, Entry]:
    # Importing the report modules fills the registry.
    from . import (reports_clean, reports_misc, reports_panel, reports_period, reports_previous,  # noqa: F401
                   reports_sources)
    return REGISTRY
