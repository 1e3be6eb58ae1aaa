"""File sources: newest-file selection, raw CSV exports, snapshot discovery,
prepared Parquet layout, roster, window and calendar modes.

File selection uses the Hadoop FileSystem listing (metadata only, as Spark's
own file index does), so it works on any filesystem Spark can read; the data
itself is always read by Spark in parallel with an explicit schema and
only the allow-listed columns.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (CONTENT_PATTERN, DAILY_ACTIVE_COLUMN, DAILY_CONTENT_COLUMN, DAILY_EFFECTIVE_COLUMN,
                      DAILY_HOURS_COLUMN, HOURS_PATTERN, MONTH_NAMES, MONTH_TOKENS, ROSTER_PATTERN, USAGE_COLUMNS,
                      USAGE_PATTERN, USERS_PATTERN, Config)
from ..functions import columns as C
from ..functions.clean import clean_users
from ..operators.periods import complete_periods
from . import versions

# ---------------------------------------------------------------- listing
def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, modification time in ms) of every entry matching a glob."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    st = fs.globStatus(path)
    if st is None:
        return []
    return [(s.getPath().toString(), int(s.getModificationTime())) for s in st]


def newest(spark: SparkSession, pattern: str) -> str:
    """The most recently modified match of a glob; error when there is none."""
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no file matches {pattern}")
    return max(files, key=lambda x: (x[1], x[0]))[0]


#: Files up to this size are read whole for their header, many to a task; of a larger one a task reads the beginning.
SMALL_FILE = 4 << 20
#: No file is split, and none shares a task with another, if opening one is counted as this many bytes.
ALONE = 1 << 46


def _head_lines(batches):
    """The first line of each file, and the ones after it until its quotes are closed; stops when a file
    that has the task to itself (``alone``) gave its own."""
    head: dict[str, str] = {}
    done: set[str] = set()
    for batch in batches:
        for path, value, alone in zip(*(c.to_pylist() for c in batch.columns)):
            if path not in done:
                head[path] = f"{head[path]}\n{value}" if path in head else value
                if head[path].count('"') % 2 == 0:
                    done.add(path)
                    if alone:
                        yield pa.RecordBatch.from_pydict({"file": [path], "header": [head[path]]})
                        return
    yield pa.RecordBatch.from_pydict({"file": pa.array(list(head), pa.string()), "header": pa.array(list(head.values()), pa.string())})


def headers(spark: SparkSession, paths) -> dict[str, list[str]]:
    """Header -> files that have it, of the CSV files at the given paths: globs, files, or folders of part files.

    Executors read the headers, Spark lists the files; the driver opens none and gets one row a file. A header is the
    first line, without a byte-order mark, and goes on where a quoted name holds a line feed. Small files are packed and
    read whole; a larger one has a task of its own that stops after the header. Files without a line have no rows
    to give. Hidden files do not count; files may be as large and as many as the listing holds.
    """
    scan = spark.newSession()  # settings of its own: the caller's stay as they are
    scan.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    lines = scan.read.option("recursiveFileLookup", True).text(paths)  # listed once
    out: dict[str, list[str]] = {}
    for alone in (False, True):
        size = F.col("_metadata.file_size")
        some = lines.where(size > SMALL_FILE if alone else size <= SMALL_FILE).select(
            F.col("_metadata.file_path").alias("file"), "value", F.lit(alone).alias("alone"))
        for r in some.mapInArrow(_head_lines, "file string, header string").collect():  # one row a file
            out.setdefault(r.header, []).append(unquote(r.file))
        for key in ("maxPartitionBytes", "openCostInBytes"):
            scan.conf.set(f"spark.sql.files.{key}", str(ALONE))
        scan.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return {header: sorted(files) for header, files in sorted(out.items())}


def read_latest(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """Read the newest CSV (with header) matching ``pattern`` inside ``folder``."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(newest(spark, os.path.join(folder, pattern)))


# ---------------------------------------------------------------- usage
def conform_usage(raw: DataFrame, cfg: Config) -> DataFrame:
    """Allow-listed raw columns -> canonical names and types; missing optional
    columns become typed nulls; malformed numbers and dates become null."""
    cols = set(raw.columns)
    out = []
    for src, dst in USAGE_COLUMNS:
        c = F.col(f"`{src}`") if src in cols else F.lit(None).cast("string")
        if dst in ("hours", "contents"):
            c = c.try_cast("double")
        elif dst == "course_created":
            c = C.coerce_date(c)
        else:
            c = c.cast("string")
        out.append(c.alias(dst))
    extra = [F.col(x) for x in ("period_index", "side") if x in cols]
    return raw.select(*out, *extra)


def read_csv_by_header(spark: SparkSession, paths, cfg: Config, *extra) -> DataFrame:
    """CSV exports with the conformed usage columns, each file read by its own header.

    Spark applies one header to all files of a read, by position, so files are
    grouped by header, each group is read and conformed by name, and the groups
    are put together. Only a group whose header holds a line feed is read with
    quoted line feeds, which keeps Spark from splitting its files.
    ``extra`` columns are added to each read.
    """
    try:
        found = headers(spark, paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no file matches {paths}") from e
    groups = []
    for header, same in found.items():
        raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", "\n" in header).csv(same)
        groups.append(conform_usage(raw.select("*", *extra), cfg))
    if not groups:
        columns = ", ".join(f"`{src}` string" for src, _ in USAGE_COLUMNS)
        empty = spark.createDataFrame([], columns)
        return conform_usage(empty.select("*", *[F.lit(None).cast("int").alias("period_index") for _ in extra]), cfg)
    return reduce(DataFrame.unionByName, groups)


def read_usage_csv(spark: SparkSession, paths, cfg: Config) -> DataFrame:
    """Usage export(s): only the allow-listed columns, by name, conformed and cleaned."""
    return clean_users(read_csv_by_header(spark, paths, cfg), cfg)


_TOKEN_RE = re.compile(r"(?:[A-Za-z0-9_]+=)?([a-z]{3})_(\d{2})")


_SNAPSHOT_RE = re.compile(r"snapshot_(\d+)\.parquet")
_MONTH_FILE_RE = re.compile(r".*__([A-Za-z]+)\.csv")
_PART_RE = re.compile(r"part-\d+-(.+?)(?:[.-]c\d+)?\.csv(?:\.gz)?")


def period_of(path: str) -> int | None:
    """The period a path names: ``snapshot_<n>.parquet`` is period n, a folder <mmm>_<yy> (also
    key=<mmm>_<yy>) its month, a file ``...__<month>.csv`` outside such a folder that month's number."""
    *_, folder, name = ["", *path.rstrip("/").split("/")]
    tokens, months = dict(MONTH_TOKENS), dict(MONTH_NAMES)
    if m := _SNAPSHOT_RE.fullmatch(name):
        return int(m.group(1))
    if m := _TOKEN_RE.fullmatch(folder.lower()):
        return (2000 + int(m.group(2))) * 12 + tokens[m.group(1)] - 1 if m.group(1) in tokens else None
    if m := _MONTH_FILE_RE.fullmatch(name):
        return months.get(m.group(1).lower())
    return None


def newest_exports(files: list[tuple[str, int]]) -> dict[int, list[str]]:
    """Period -> files of its newest export, from (path, modification time).

    An export is a file, or all part files of one write. Two folders of the
    same month (ene_26 and jan_26) are one period.
    """
    exports: dict[int, dict[str, list[tuple[int, str]]]] = {}
    for path, mtime in files:
        period = period_of(path)
        if period is None or path.rsplit("/", 1)[-1].startswith(("_", ".")):
            continue
        folder, _, name = path.rpartition("/")
        part = _PART_RE.fullmatch(name)
        exports.setdefault(period, {}).setdefault(f"{folder}/{part.group(1)}" if part else path, []).append((mtime, path))
    return {period: sorted(p for _, p in max(found.values(), key=max)) for period, found in sorted(exports.items())}


def snapshot_files(spark: SparkSession, root: str, file_glob: str = USAGE_PATTERN) -> list[tuple[int, str]]:
    """(period_index, file) of the newest export of every period below ``root``: in month
    folders, or beside each other as ``snapshot_<n>.parquet`` or ``...__<month>.csv``."""
    found = list_files(spark, os.path.join(root, "*", file_glob))
    found += list_files(spark, os.path.join(root, "snapshot_*.parquet"))
    found += [f for f in list_files(spark, os.path.join(root, "*__*.csv")) if _MONTH_FILE_RE.fullmatch(f[0].rsplit("/", 1)[-1])]
    return [(period, path) for period, paths in newest_exports(found).items() for path in paths]


def snapshot_periods(spark: SparkSession, root: str, file_glob: str = USAGE_PATTERN) -> DataFrame:
    """(period_index) of the periods that have a snapshot below ``root``, by their names alone."""
    periods = sorted({period for period, _ in snapshot_files(spark, root, file_glob)})
    return spark.createDataFrame([(p,) for p in periods], "period_index int")


def period_from_path(path_col, cfg: Config):
    """period_index from a file path: folder <mmm>_<yy> -> (2000+yy)*12 + month-1,
    'snapshot_<n>.parquet' -> n, '...__<spanish month>.csv' -> month number."""
    folder = F.regexp_extract(path_col, r"/(?:[A-Za-z0-9_]+=)?([a-zA-Z]{3})_(\d{2})/[^/]+$", 1)
    yy = F.regexp_extract(path_col, r"/(?:[A-Za-z0-9_]+=)?([a-zA-Z]{3})_(\d{2})/[^/]+$", 2)
    tok = F.create_map(*[F.lit(x) for kv in MONTH_TOKENS for x in kv])
    by_folder = (F.lit(2000) + yy.cast("int")) * 12 + F.try_element_at(tok, F.lower(folder)) - 1
    snap = F.regexp_extract(path_col, r"snapshot_(\d+)\.parquet", 1)
    names = F.create_map(*[F.lit(x) for kv in MONTH_NAMES for x in kv])
    month = F.try_element_at(names, F.lower(F.regexp_extract(path_col, r"__([A-Za-z]+)\.csv$", 1)))
    return (F.when(folder != "", by_folder)
            .when(snap != "", snap.cast("int"))
            .otherwise(month)).cast("int")


def read_exports(spark: SparkSession, files: list[tuple[int, str]], cfg: Config) -> DataFrame:
    """Usage rows of (period_index, path) pairs, CSV by header or Parquet, with their period."""
    period = period_from_path(F.col("_metadata.file_path"), cfg).alias("period_index")
    csv = [p for _, p in files if not p.endswith(".parquet")]
    reads = [read_csv_by_header(spark, csv, cfg, period)] if csv else []
    for n, path in files:  # a Parquet snapshot has its own schema, raw or canonical
        if path.endswith(".parquet"):
            raw = spark.read.parquet(path)
            names = {dst: src for src, dst in USAGE_COLUMNS}
            raw = raw.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in raw.columns])
            reads.append(conform_usage(raw.withColumn("period_index", F.lit(n)), cfg))
    return clean_users(reduce(DataFrame.unionByName, reads), cfg)


def read_period_snapshots(spark: SparkSession, root: str, cfg: Config, file_glob: str = USAGE_PATTERN) -> DataFrame:
    """All discovered snapshots as one usage table with a period_index column."""
    files = snapshot_files(spark, root, file_glob)
    if not files:
        raise FileNotFoundError(f"no period snapshots under {root}")
    return read_exports(spark, files, cfg)


# ---------------------------------------------------------------- daily series
def read_daily_series(spark: SparkSession, folder: str, pattern: str, value_col: str, name: str) -> DataFrame:
    """Newest daily export: (day, <name>) with unparsable dates dropped."""
    s = read_latest(spark, folder, pattern)
    return (s.select(C.coerce_date(F.col("fecha")).alias("day"), F.col(f"`{value_col}`").try_cast("double").alias(name))
            .where(F.col("day").isNotNull()))


def read_daily(spark: SparkSession, folder: str, cfg: Config) -> DataFrame:
    """The three daily exports joined by day: hours, contents, active and effective
    users (effective halved, raw kept)."""
    h = read_daily_series(spark, folder, HOURS_PATTERN, DAILY_HOURS_COLUMN, "hours")
    c = read_daily_series(spark, folder, CONTENT_PATTERN, DAILY_CONTENT_COLUMN, "contents")
    a = read_latest(spark, folder, USERS_PATTERN)
    u = a.select(C.coerce_date(F.col("fecha")).alias("day"),
                 F.col(f"`{DAILY_ACTIVE_COLUMN}`").try_cast("long").alias("active"),
                 F.col(f"`{DAILY_EFFECTIVE_COLUMN}`").try_cast("long").alias("effective_raw")).where(
        F.col("day").isNotNull())
    d = h.join(c, "day", "full").join(u, "day", "full")
    return halve_effective(d.withColumn("contents", F.col("contents").cast("long")), cfg)


def halve_effective(daily: DataFrame, cfg: Config) -> DataFrame:
    """Keep the raw effective-user count and divide the main column by the divisor."""
    return daily.withColumn("effective", F.col("effective_raw") / F.lit(float(cfg.effective_divisor)))


# ---------------------------------------------------------------- roster
def read_roster(spark: SparkSession, folders: list[str], cfg: Config) -> DataFrame:
    """First folder holding a roster export wins, newest file there; cleaned like
    usage. No roster anywhere -> an empty frame with the roster schema."""
    for folder in folders:
        files = list_files(spark, os.path.join(folder, ROSTER_PATTERN))
        if files:
            raw = read_latest(spark, folder, ROSTER_PATTERN)
            cols = set(raw.columns)

            def pick(*names):
                for n in names:
                    if n in cols:
                        return F.col(f"`{n}`")
                return F.lit(None).cast("string")
            r = raw.select(pick("Usuario").alias("user_id"), pick("Centro").alias("center"),
                           pick("Curso", "Nivel").alias("level"),
                           pick("Horas de aprendizaje").try_cast("double").alias("hours"),
                           pick("Contenidos consumidos", "Nº de contenidos consumidos").try_cast("double").alias("contents"),
                           pick("Cursos activos").try_cast("long").alias("active_courses"))
            return clean_users(r, cfg).select("user_id", "brand", "center", "level", "population", "hours", "contents",
                                              "active_courses")
    schema = ("user_id string, brand string, center string, level string, population string, hours double, "
              "contents double, active_courses long")
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- modes
def read_current_previous(spark: SparkSession, cur_dir: str, prev_dir: str, cfg: Config):
    """Window mode: newest usage export of each folder with a side column, and the
    daily exports of each folder with the same side."""
    u = (read_usage_csv(spark, newest(spark, os.path.join(cur_dir, USAGE_PATTERN)), cfg)
         .withColumn("side", F.lit("cur"))
         .unionByName(read_usage_csv(spark, newest(spark, os.path.join(prev_dir, USAGE_PATTERN)), cfg)
                      .withColumn("side", F.lit("prev"))))
    d = (read_daily(spark, cur_dir, cfg).withColumn("side", F.lit("cur"))
         .unionByName(read_daily(spark, prev_dir, cfg).withColumn("side", F.lit("prev"))))
    return u, d


def read_calendar(spark: SparkSession, root: str, daily_dir: str, cfg: Config, file_glob: str = USAGE_PATTERN):
    """Calendar mode: usage and daily series of the latest complete month and the one before it,
    each with ``period_index`` and ``side``.

    A month counts if it has a snapshot and the daily series covers it whole; only the two
    months' exports are read. Fewer than two such months are an error.
    """
    files = snapshot_files(spark, root, file_glob)
    daily = read_daily(spark, daily_dir, cfg)
    whole = {r.period_index for r in complete_periods(daily, cfg).collect()}  # one row a month
    months = sorted({p for p, _ in files} & whole)
    if len(months) < 2:
        raise FileNotFoundError("calendar mode needs at least two complete months")
    side = F.when(F.col("period_index") == months[-1], "cur").when(F.col("period_index") == months[-2], "prev")
    usage = read_exports(spark, [f for f in files if f[0] in months[-2:]], cfg)
    days = daily.withColumn("period_index", C.period_of_date(F.col("day"), cfg.grain))
    return usage.withColumn("side", side), days.withColumn("side", side).where(F.col("side").isNotNull())


def read_prepared(spark: SparkSession, root: str, cfg: Config):
    """Prepared layout written by the preparation job: usage partitioned by
    period_index, daily series, roster. Population derived when absent; raw
    effective users rebuilt (effective x divisor) when absent. All tables are of the
    version that was published last when this was called."""
    root = versions.current(spark, root)
    u = spark.read.parquet(os.path.join(root, "usage"))
    if "population" not in u.columns:
        u = u.withColumn("population", C.population(C.normalise_level(F.col("level"), cfg)))
    d = spark.read.parquet(os.path.join(root, "daily"))
    if "effective_raw" not in d.columns:
        d = d.withColumn("effective_raw", (F.col("effective") * cfg.effective_divisor).cast("long"))
    r = spark.read.parquet(os.path.join(root, "roster")) if list_files(spark, os.path.join(root, "roster")) else None
    return u, d, r


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of the prepared layout: mode, cur, prev, partial; all null without one."""
    schema = "mode string, cur int, prev int, partial array<int>"
    path = os.path.join(versions.current(spark, root), "manifest")
    if not list_files(spark, path):
        return spark.createDataFrame([(None, None, None, None)], schema)
    return spark.read.schema(schema).json(path)
