"""Ranks for reports that are read in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(report: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The report with its ``rank`` from 1, over columns in order ("-hours" is falling), within groups.

    Reports have one row a course, template or group, so a rank needs no more
    than those few rows in one task; usage rows never come here.
    """
    keys = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    return report.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*keys)))


def ranked_sql(sql: str, order: Sequence[str], within: Sequence[str] = ()) -> str:
    """The SQL twin: a query with its rank."""
    keys = ", ".join(f"{c[1:]} DESC NULLS LAST" if c.startswith("-") else f"{c} NULLS LAST" for c in order)
    part = f"PARTITION BY {', '.join(within)} " if within else ""
    return f"SELECT *, CAST(row_number() OVER ({part}ORDER BY {keys}) AS INTEGER) AS rank FROM (\n{sql}\n) ranked"
