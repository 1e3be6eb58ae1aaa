"""Which usage columns a report reads, so that it can be given the coarsest rollup that has them.

A report that is not listed may name any column of the finest rollup. Every rollup has the columns that slices
and periods need (brand, population, period_index). ``tests/test_rollups.py`` holds each report over its rollup against the
same report over usage.
"""

from __future__ import annotations

from ..operators.rollups import KEYS, MEASURES

_BY_COURSE = ("course_id", "course_name", "hours")
_BY_NAME = ("course_name",)
_BY_USER = ("user_id", "hours", "contents")

READS = {
    _BY_COURSE: ("course_hours_delta", "top_courses_hours", "top_gainers", "top_losers", "pct_change", "course_names"),
    _BY_NAME: ("path_match", "path_not_found", "path_found", "normalise_name"),
    ("brand", "hours", "rows"): ("filter_brand",),
    _BY_USER: ("panorama_snapshot", "panorama_by_brand", "hours_per_user", "activation_share", "intensity_share",
               "segment_counts", "segments_by_brand", "top_share", "hours_distribution", "hours_distribution_prev",
               "funnel", "funnel_compare", "filter_population", "slice_cube", "hours_distribution_slices", "segment_slices", "pop_by_period", "pop_current_row",
               "pop_by_brand", "pop_active_ever", "pop_panel_by_brand", "pop_summary", "pseudonymise"),
}
#: Reports that count the rows of the tables themselves.
STORED_ROWS = ("base_bundle",)
_COLUMNS = {name: columns for columns, names in READS.items() for name in names}


def columns_read(name: str) -> tuple | None:
    """Columns that the report reads of usage; None if it must have usage itself."""
    if name in STORED_ROWS:
        return None
    return _COLUMNS.get(name, (*KEYS["pairs"], *MEASURES))
