"""Report bundle for one slice, and digests of reports that are stored and compared.

``report_bundle`` returns a dict of lazy DataFrames; nothing runs until a
report is written or collected, so a dashboard request executes only the
report it shows. Teacher reports always read the base without the population
filter; by-brand reports read the population-filtered base without the
brand filter; daily-series reports read the whole series, and reports of
every slice the whole base.
"""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .base import Base
from .registry import REGISTRY, load_all

BUNDLE_LEVEL = {"base_bundle", "report_bundle", "result_digest", "result_diff"}
BY_BRAND = {"panorama_by_brand", "segments_by_brand", "progress_by_brand", "growth_by_brand",
            "certification_by_group"}
WHOLE_SERIES = {"panorama_kpis", "active_vs_effective", "series_union", "series_calendar_fill", "series_gaps",
                "long_series", "rolling_7", "trend_28", "seasonal_index", "year_ago_7", "yoy_by_month",
                "daily_trends", "daily_summary", "date_range_label", "halve_effective", "window_mid_month",
                "complete_periods", "period_sides", "periods_dim", "period_manifest",
                "bundle_meta"}
#: Reports that give every slice themselves.
EVERY_SLICE = {"slice_cube", "hours_distribution_slices", "segment_slices", "growth_slices"}


def bundle_builders(base: Base, brands=None, population: str | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every registered report for the slice (brands, population), as a builder
    that returns the lazy DataFrame. Building a plan is driver work (analysis),
    so bundles build inside the same worker threads that run the jobs."""
    load_all()
    pop = base.restrict(population=population)
    sliced = pop.restrict(brands=brands)
    teachers = base.restrict(brands=brands)
    out = {}
    for name, e in REGISTRY.items():
        if e.raw or name in BUNDLE_LEVEL:
            continue
        if name.startswith("pop_") or name == "pseudonym_code":
            b = teachers
        elif name in BY_BRAND:
            b = pop
        elif name in WHOLE_SERIES or name in EVERY_SLICE:
            b = base
        else:
            b = sliced
        out[name] = (lambda _e=e, _b=b: _e.over(_b))
    return out


def report_bundle(base: Base, brands=None, population: str | None = None) -> dict[str, DataFrame]:
    """Every registered report over the base, for the slice (brands, population)."""
    return {name: build() for name, build in bundle_builders(base, brands, population).items()}


def _row_hash(df: DataFrame, places: int | None, but: str | None = None):
    """Hash of a row's columns in the order of their names, doubles rounded to ``places``."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name != but:
            c = F.col(f"`{f.name}`")
            cols.append(F.round(c, places) if places is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return F.xxhash64(*cols) if cols else F.lit(0)


def result_digest(df: DataFrame, places: int | None = 6, place: str | None = "rank") -> DataFrame:
    """One row (rows, digest, order_digest, columns), independent of how rows are stored.

    ``digest`` is the exact sum of row hashes, doubles to 6 decimals, or as they
    are without ``places``. If the report has a column ``place`` that says where
    a row is read, that column is left out of ``digest``; ``order_digest`` is the sum
    of hashes of (row hash, place), null without one. Both are sums, so digests
    of parts of a report add up to its own. ``columns`` are names and types.
    """
    place = place if place in df.columns else None
    h = _row_hash(df, places, place)
    at = F.xxhash64(h, F.col(place)) if place else F.lit(None).cast("long")
    exact = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("string")
    return df.select(h.cast("decimal(38,0)").alias("h"), at.cast("decimal(38,0)").alias("at")).agg(
        F.count(F.lit(1)).cast("long").alias("rows"), exact("h").alias("digest"),
        (exact("at") if place else F.lit(None).cast("string")).alias("order_digest"),
        F.lit(", ".join(f"{n} {t}" for n, t in sorted(df.dtypes))).alias("columns"))


#: Reports of a bundle that run at the same time.
PARALLELISM = 8


DIGESTS = "report string, rows long, digest string, order_digest string, columns string"


def bundle_digest(bundle: dict[str | tuple, DataFrame | Callable[[], DataFrame]], parallelism: int = PARALLELISM,
                  schema: str = DIGESTS, places: int | None = 6) -> DataFrame:
    """One row per report: name (or the values of a name that is a tuple) and its digests.

    Each report is digested by its own Spark job (a union of ~100 report plans
    would make one enormous plan to optimise). The jobs are independent, so
    they are submitted concurrently from a small thread pool (SparkSession is
    thread-safe); only the one row of digests of each report reaches the driver.
    Values may be DataFrames or builders returning one; what a builder returns is
    let go after its job, so that the driver can drop its plan and broadcasts.
    """
    if not bundle:
        raise ValueError("empty bundle")
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    ended = itertools.count(1)

    def one(item):
        name, df = item
        df = df() if callable(df) else df
        r = tuple(result_digest(df, places).first())
        del df
        # frames in reference cycles hold their plans in the JVM; a collection stops all threads, so there is one a round
        if next(ended) % parallelism == 0:
            gc.collect()
        return *(name if isinstance(name, tuple) else (name,)), *r

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        rows = list(ex.map(one, list(bundle.items())))
    return spark.createDataFrame(rows, schema)


def store_digests(digests: DataFrame, root: str, run: str) -> None:
    """Keep a run's digests, to be compared with a later run's; a run is stored once."""
    digests.coalesce(1).write.mode("error").parquet(f"{root.rstrip('/')}/run={run}")


def read_digests(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/run={run}")


def digest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What became of each report from digests ``a`` to ``b``: change, rows_before, rows_after.

    ``change`` is added, removed, columns (other names or types), values (other
    rows), order (the same rows read in another order) or same. Sliced digests
    are compared by slice and report.
    """
    keys = [c for c in ("slice", "report") if c in a.columns and c in b.columns]
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]), "full")
    change = (F.when(F.col("x.rows").isNull(), "added").when(F.col("y.rows").isNull(), "removed")
              .when(F.col("x.columns") != F.col("y.columns"), "columns")
              .when((F.col("x.rows") != F.col("y.rows")) | (F.col("x.digest") != F.col("y.digest")), "values")
              .when(~F.col("x.order_digest").eqNullSafe(F.col("y.order_digest")), "order").otherwise("same"))
    return both.select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], change.alias("change"),
                       F.col("x.rows").alias("rows_before"), F.col("y.rows").alias("rows_after"))


def result_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in a and only in b (multiset difference both ways), as counts."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    right = b.exceptAll(a).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return a.sparkSession.range(1).select(left.cast("long").alias("only_left"), right.cast("long").alias("only_right"))


def sliced_digest(base: Base, slices: dict[str, list | None], parallelism: int = PARALLELISM) -> DataFrame:
    """One row per slice and report: slice and the digests; slices are brand lists by name, None for all brands.

    Reports that read no brand filter are the same in every slice and run once.
    """
    whole = BY_BRAND | WHOLE_SERIES | EVERY_SLICE
    first, *others = slices
    builders = {name: bundle_builders(base, brands) for name, brands in slices.items()}
    # a report's slices follow each other: their plans differ by a literal, so the code generated for one serves the next
    jobs = {(name, report): builders[name][report] for report in builders[first]
            for name in ([first] if report in whole else slices)}
    done = bundle_digest(jobs, parallelism, "slice string, " + DIGESTS)
    shared = done.where((F.col("slice") == first) & F.col("report").isin(sorted(whole)))
    return reduce(DataFrame.unionByName, [shared.withColumn("slice", F.lit(name)) for name in others], done)


def bundle_diff(a: dict[str, DataFrame | Callable[[], DataFrame]], b: dict[str, DataFrame | Callable[[], DataFrame]],
                parallelism: int = PARALLELISM, root: str | None = None) -> DataFrame:
    """Per report of either bundle: change (see ``digest_diff``), and rows only on each side.

    Both bundles are digested, doubles unrounded, and the digests stored (below ``root``, a shared folder by default)
    and compared. Only reports of the same columns whose rows changed are then compared row by row.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    root = root or shared_dir(spark, f"digests-{uuid.uuid4().hex[:12]}")
    for run, side in (("before", a), ("after", b)):
        store_digests(bundle_digest(side, parallelism, places=None), root, run)
    # one row a report
    diff = digest_diff(read_digests(spark, root, "before"), read_digests(spark, root, "after")).collect()

    def only(r) -> tuple[int, int]:
        if r["change"] == "values":
            x, y = (side[r["report"]]() if callable(side[r["report"]]) else side[r["report"]] for side in (a, b))
            n = result_diff(x, y.select(*(f"`{c}`" for c in x.columns))).first()
            return int(n["only_left"]), int(n["only_right"])
        if r["change"] in ("same", "order"):
            return 0, 0
        return int(r["rows_before"] or 0), int(r["rows_after"] or 0)

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        counts = list(ex.map(only, diff))
    rows = [(r["report"], r["change"], *n) for r, n in zip(diff, counts)]
    return spark.createDataFrame(sorted(rows), "report string, change string, only_left long, only_right long")
