"""Raw export layout derived from the driver's tables, for the source/sink reports.

Writes, under a folder of the shared checkpoint directory:

  month_to_month/snapshot=<mmm>_<yy>/part-*.csv.gz   usage per calendar month (raw headers)
  daily/Horas_de_aprendizaje_1.csv/              an older hours export (to be ignored)
  daily/Horas_de_aprendizaje_2.csv/              the newest hours export
  daily/Consumo_mensual_1.csv/, daily/Usuarios_mensuales_1.csv/
  current/..., previous/...                       window-mode exports of the two sides
  roster_b/Listado_de_usuarios_1.csv/             roster (the first candidate folder is empty)

Everything is written by Spark from the given tables, the parts that a report reads when it is first run. The
tables are joined once, into joined/, from which usage of all parts is made; only months are shuffled again.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (DAILY_ACTIVE_COLUMN, DAILY_CONTENT_COLUMN, DAILY_EFFECTIVE_COLUMN, DAILY_HOURS_COLUMN,
                      USAGE_COLUMNS, Config)
from ..functions import columns as C
from ..functions.clean import clean_users
from ..operators.periods import periods_dim
from ..session import shared_dir
from . import fixtures

# Spanish month tokens used for the export folder names.
FOLDER_TOKENS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")

#: Files of the month folders; usage is long, so they are compressed.
MONTH_FILES = "*.csv.gz"
#: Parts of the layout; a part is written when it is first asked for.
PARTS = ("months", "daily", "sides", "roster")

_DONE: dict = {}


def _csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _raw_columns() -> list:
    """The export's columns, as text, of raw usage rows."""
    return [F.col(dst).cast("string").alias(src) for src, dst in USAGE_COLUMNS]


def _month_index():
    return C.period_of_date(F.col("day"), "month")


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw usage rows with the export's column names and a monthly period index."""
    u = fixtures.usage_raw(spark, sf_dir, grain="month")
    return u.select(*_raw_columns(), F.col("period_index").alias("month_index"))


def folder_token(month_index) -> F.Column:
    names = F.array(*[F.lit(t) for t in FOLDER_TOKENS])
    return F.concat(F.element_at(names, (F.pmod(month_index, F.lit(12)) + 1).cast("int")), F.lit("_"),
                    F.lpad(F.pmod(F.floor(month_index / 12), F.lit(100)).cast("string"), 2, "0"))


def _daily_exports(daily: DataFrame, folder: str, hours_name: str = "Horas_de_aprendizaje_1.csv") -> None:
    day = F.date_format("day", "yyyy-MM-dd").alias("fecha")
    _csv(daily.select(day, F.col("hours").alias(DAILY_HOURS_COLUMN)), os.path.join(folder, hours_name))
    _csv(daily.select(day, F.col("contents").alias(DAILY_CONTENT_COLUMN)),
         os.path.join(folder, "Consumo_mensual_1.csv"))
    _csv(daily.select(day, F.col("active").alias(DAILY_ACTIVE_COLUMN),
                      F.col("effective_raw").alias(DAILY_EFFECTIVE_COLUMN)),
         os.path.join(folder, "Usuarios_mensuales_1.csv"))


def _write_months(usage: DataFrame, root: str) -> None:
    """Usage a month folder, from rows of ``fixtures.joined``; they are shuffled as they are, texts are made after that."""
    # every other month has its columns in reverse order and one more among them
    names = [src for src, _ in USAGE_COLUMNS]
    reverse = [F.col(f"`{c}`") for c in names[::-1]]
    reverse.insert(3, F.lit("x").alias("Otra columna"))
    for odd, columns in ((0, [F.col(f"`{c}`") for c in names]), (1, reverse)):
        rows = usage.withColumn("month_index", _month_index()).where(F.col("month_index") % 2 == odd)
        months = fixtures.usage_columns(rows.hint("rebalance", F.col("month_index")), "month")
        (months.select(folder_token(F.col("period_index")).alias("snapshot"), *_raw_columns()).select("snapshot", *columns)
         .write.mode("append" if odd else "overwrite").option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("compression", "gzip").partitionBy("snapshot").csv(os.path.join(root, "month_to_month")))


def _write_daily(daily: DataFrame, root: str) -> None:
    d = os.path.join(root, "daily")
    _csv(daily.select(F.date_format("day", "yyyy-MM-dd").alias("fecha"),
                      (F.col("hours") * 2).alias(DAILY_HOURS_COLUMN)), os.path.join(d, "Horas_de_aprendizaje_1.csv"))
    _daily_exports(daily, d, "Horas_de_aprendizaje_2.csv")


def _write_sides(usage: DataFrame, daily: DataFrame, cfg: Config, root: str) -> None:
    """Window mode: usage and daily series of the current and previous period."""
    raw = fixtures.usage_columns(usage, cfg.grain)
    # one row a period
    periods = periods_dim(clean_users(raw.select("user_id", "period_index"), cfg), daily, cfg).checkpoint(eager=True)
    days = daily.withColumn("period_index", C.period_of_date(F.col("day"), cfg.grain))
    for side, folder in (("cur", "current"), ("prev", "previous")):
        dim = F.broadcast(periods.where(F.col("side") == side).select("period_index"))
        _csv(raw.join(dim, "period_index", "left_semi").select(*_raw_columns()),
             os.path.join(root, folder, f"consumo_por_usuario__{side}.csv"))
        _daily_exports(days.join(dim, "period_index", "left_semi"), os.path.join(root, folder))


def _write_roster(people: DataFrame, root: str) -> None:
    _csv(people.select(F.col("user_id").alias("Usuario"), F.lit(None).cast("string").alias("Centro"),
                       F.col("level_raw").alias("Curso"), (F.col("k") % 7 / 2).alias("Horas de aprendizaje"),
                       (F.col("k") % 5).alias("Contenidos consumidos"), (F.col("k") % 3).alias("Cursos activos")),
         os.path.join(root, "roster_b", "Listado_de_usuarios_1.csv"))


def ensure(spark: SparkSession, sf_dir: str, cfg: Config, parts=PARTS) -> str:
    """Write the given parts of the layout, each once per session and folder; returns its root."""
    key = (spark.sparkContext.applicationId, sf_dir, cfg.grain)
    tag = hashlib.sha1(repr(key).encode()).hexdigest()[:12]
    root = shared_dir(spark, f"exports-{tag}")
    done = _DONE.setdefault(key, {})

    def kept(name: str, df: DataFrame) -> DataFrame:
        """A table that several parts are made of, written once."""
        if name not in done:
            df.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(root, name))
            done[name] = True
        return spark.read.parquet(os.path.join(root, name))

    write = {
        "months": lambda: _write_months(kept("joined", fixtures.joined(spark, sf_dir)), root),
        "daily": lambda: _write_daily(kept("series", fixtures.daily(spark, sf_dir, cfg)), root),
        "sides": lambda: _write_sides(kept("joined", fixtures.joined(spark, sf_dir)),
                                      kept("series", fixtures.daily(spark, sf_dir, cfg)), cfg, root),
        "roster": lambda: _write_roster(fixtures.people(spark, sf_dir), root),
    }
    for part in parts:
        if part not in done:
            write[part]()
            done[part] = True
    return root
