"""Canonical tables derived from the TPC-H-shaped test tables.

customer -> a user (an invented address whose domain carries the region, so the
brand/center/test-account rules have work to do), part brand -> a course,
lineitem -> a usage row, order date -> the period, orders per day -> the daily
platform series. Everything is a lazy DataFrame over the given parquet files,
so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions.clean import clean_users


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (k, user_id, level_raw). nation/region are fixed 25/5-row dims."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey))
    k = F.col("c_custkey")
    prefix = F.when(k % 97 == 5, "Test").when(k % 50 == 1, "asima").otherwise("c")
    domain = (F.when(F.col("r_name") == "AFRICA", "afri.example")
              .when(F.col("r_name") == "AMERICA", "amer.example")
              .when(F.col("r_name") == "ASIA", "asi.example")
              .when(F.col("r_name") == "EUROPE", "euro.example")
              .otherwise("me.example"))
    seg = F.col("c_mktsegment")
    level_raw = (F.when(seg == "AUTOMOBILE", "Superior").when(seg == "BUILDING", " medioSuperior")
                 .when(seg == "FURNITURE", "LICENCIATURA").when(seg == "HOUSEHOLD", "MedioSuperior ,Superior"))
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey)
            .select(k.alias("k"),
                    F.concat(prefix, k.cast("string"), F.lit("@"), domain).alias("user_id"),
                    level_raw.alias("level_raw")))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders x part x people, only the columns that usage rows are made of.

    Orders meet their people first, so that lineitem, the longest table, goes through as few exchanges and with as few
    columns as can be. Orders grow with lineitem: they are shuffled whatever their size, never broadcast from the driver.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus",
        F.when(F.col("l_returnflag") == "R", F.lit(0.0)).otherwise(F.col("l_quantity").cast("double") / 10).alias("hours"),
        F.round(F.col("l_discount") * 100).alias("disc"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    pp = people(spark, sf_dir)
    od = od.join(pp, od.o_custkey == pp.k).select("o_orderkey", "day", "user_id", "level_raw")
    return (li.join(od.hint("merge"), li.l_orderkey == od.o_orderkey)
            .join(pt, li.l_partkey == pt.p_partkey)
            .select("user_id", "level_raw", "day", "p_brand", "p_type", "hours", "disc", "l_linenumber", "l_linestatus"))


def usage_columns(rows: DataFrame, grain: str = "quarter") -> DataFrame:
    """Raw usage rows (before cleaning) from rows of ``joined``."""
    disc = F.col("disc")
    band = (F.when(disc < 3, "Entre 0% y 20%").when(disc < 5, "Entre 20% y 50%")
            .when(disc < 8, "Entre 50% y 80%").when(disc < 10, "Entre 80% y 100%"))
    cert = (F.when((F.col("l_linestatus") == "F") & (disc >= 8), " Si ")
            .when(F.col("l_linenumber") == 7, "SI")
            .when(F.col("l_linestatus") == "F", "No"))
    return rows.select(
        F.col("user_id"),
        F.col("level_raw").alias("level"),
        F.col("p_brand").alias("course_id"),
        F.concat(F.lit("Curso "), F.col("p_brand")).alias("course_name"),
        F.col("p_type").alias("template"),
        F.date_add(F.lit("1995-01-01").cast("date"),
                   (F.substring("p_brand", 7, 10).cast("int") * 45)).alias("course_created"),
        F.col("hours"),
        F.col("l_linenumber").cast("double").alias("contents"),
        band.alias("progress_band"),
        cert.alias("certified_raw"),
        F.lit(None).cast("string").alias("center"),
        C.period_of_date(F.col("day"), grain).alias("period_index"),
    )


def usage_raw(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """Raw usage rows (before cleaning) of the given tables."""
    return usage_columns(joined(spark, sf_dir), grain)


def usage(spark: SparkSession, sf_dir: str, cfg: Config) -> DataFrame:
    """Cleaned canonical usage: one row per raw usage row, test accounts removed."""
    return clean_users(usage_raw(spark, sf_dir, cfg.grain), cfg)


def daily(spark: SparkSession, sf_dir: str, cfg: Config) -> DataFrame:
    """Daily platform series from orders: hours, contents, active and effective users."""
    od = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_custkey", "o_totalprice", "o_orderstatus")
    # a row a day and user first: one exchange, no copies of the rows for the second distinct count
    users = od.groupBy("day", "o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("price"), F.count(F.lit(1)).alias("orders"),
        F.max(F.col("o_orderstatus") == "F").alias("effective"))
    g = users.groupBy("day").agg(
        (F.sum("price").cast("double") / 1000).alias("hours"), F.sum("orders").cast("long").alias("contents"),
        F.count("o_custkey").cast("long").alias("active"),
        F.count(F.when(F.col("effective"), F.col("o_custkey"))).cast("long").alias("effective_raw"))
    return g.withColumn("effective", F.col("effective_raw") / F.lit(float(cfg.effective_divisor)))


def roster(spark: SparkSession, sf_dir: str, cfg: Config) -> DataFrame:
    """Licence list: every invented user, cleaned like usage."""
    p = people(spark, sf_dir).select("user_id", F.col("level_raw").alias("level"))
    return clean_users(p, cfg).select("user_id", "brand", "center", "level", "population")
