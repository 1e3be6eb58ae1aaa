"""Reports of the current period over the previous one, and the change of progress in points."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.aggs import ratio, r6
from ..operators import paths as PT
from ..operators import snapshot as S
from . import reports_period  # noqa: F401  (registers the reports this module repeats)
from .registry import REGISTRY, report
from .sql import ratio as sratio


def _previous(name: str):
    """The SQL twin of a report over the current period's tables, over the previous ones."""
    current = REGISTRY[name].sql
    return lambda cfg: re.sub(r"\b(hpu_|mp_)?cur\b", r"\1prev", current(cfg))


@report("progress_distribution_prev", sql=_previous("progress_distribution"))
def progress_distribution_prev_q(b):
    return S.progress_distribution(b.prev, b.cfg)


@report("progress_summary_prev", sql=_previous("progress_summary"))
def progress_summary_prev_q(b):
    return S.progress_summary(b.prev, b.cfg)


@report("hours_distribution_prev", sql=_previous("hours_distribution"))
def hours_distribution_prev_q(b):
    return S.hours_distribution(b.prev, b.cfg)


@report("certification_prev", sql=_previous("certification"))
def certification_prev_q(b):
    return S.certification(b.prev, b.cfg)


@report("path_by_course_prev", sql=_previous("path_by_course"))
def path_by_course_prev_q(b):
    return PT.path_by_course(b.prev, b.cfg)


@report("path_coverage_prev", sql=_previous("path_coverage"))
def path_coverage_prev_q(b):
    return PT.path_coverage(b.prev, b.cfg)


def _shares(source: str) -> str:
    return (f"SELECT {sratio('count(*) FILTER (WHERE progress < 20)', 'count(*)')} AS lo, "
            f"{sratio('count(*) FILTER (WHERE progress >= 80)', 'count(*)')} AS hi FROM {source}")


@report("progress_change", sql=f"""
, c AS ({_shares('mp_cur')}), p AS ({_shares('mp_prev')})
SELECT round((c.lo - p.lo) * 100, 6) AS below20_pp, round((c.hi - p.hi) * 100, 6) AS at_least80_pp FROM c, p""")
def progress_change_q(b):
    """Change of the shares of (user, course) pairs below 20 and at or above 80 percent, in points; one pass."""
    pairs = (b.with_side().where(F.col("user_id").isNotNull() & F.col("progress").isNotNull())
             .groupBy("side", "user_id", "course_id").agg(F.max("progress").alias("p")))

    def share(side, condition):
        there = F.col("side") == side
        return ratio(F.count_if(there & condition), F.count_if(there))

    low, high = F.col("p") < 20, F.col("p") >= 80
    return pairs.agg(r6((share("cur", low) - share("prev", low)) * 100).alias("below20_pp"),
                     r6((share("cur", high) - share("prev", high)) * 100).alias("at_least80_pp"))
