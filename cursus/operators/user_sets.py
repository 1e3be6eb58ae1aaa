"""Index of user sets: distinct users over any periods, courses, brands and populations without reading usage.

Every user has a number that never changes. Users are spread over parts by hash and numbered within their part, so
no task numbers all of them, and new users continue their part's count. A cell of the index (period, course,
brand, population, with hours or without) holds its users as bitmaps of 32,768 numbers, 4 KB each, of which all but
the set bits compress away when stored. Sets of cells are united by OR, so counts over any cells are exact. With ``approx`` a
cell also keeps an HLL sketch, a few KB whatever its size, whose united estimate has a relative standard error of
1.04 / sqrt(2^LG_K), 0.8 percent.

Rows without a user are in no set, as for ``count(DISTINCT user_id)``. The index is partitioned by period: a period
that is delivered again replaces its cells, after its new users were numbered (``extend_numbers``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("period_index", "course_id", "brand", "population", "active")
#: Users of a part, about; parts are numbered SPAN apart, a multiple of the bits of a bitmap.
PART_USERS = 1 << 18
SPAN = 1 << 32
LG_K = 14


def _numbered(users: DataFrame, parts: int, last: DataFrame | None = None) -> DataFrame:
    """(user_id, part, parts, number) of distinct users, in each part from 1 or after ``last``'s (part, n)."""
    u = users.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("user_id"))
    u = u.withColumn("place", place.cast("long"))
    if last is not None:
        u = u.join(last, "part", "left").withColumn("place", F.col("place") + F.coalesce("n", F.lit(0)))
    return u.select("user_id", "part", F.lit(parts).alias("parts"), (F.col("part") * SPAN + F.col("place")).alias("number"))


def _users(rows: DataFrame) -> DataFrame:
    return rows.select("user_id").where(F.col("user_id").isNotNull()).distinct()


def user_numbers(rows: DataFrame, part_users: int = PART_USERS) -> DataFrame:
    """Numbers of all users of the rows; the number of parts follows from how many there are (one count)."""
    users = _users(rows)
    n = users.agg(F.count(F.lit(1))).first()[0]
    return _numbered(users, max(1, -(-n // part_users)))


def extend_numbers(numbers: DataFrame, rows: DataFrame) -> DataFrame:
    """The numbers with those of the rows' users that have none yet; no number changes."""
    first = numbers.select("parts").first()
    if first is None:
        return user_numbers(rows)
    last = numbers.groupBy("part").agg(F.max(F.col("number") - F.col("part") * SPAN).alias("n"))
    return numbers.unionByName(_numbered(_users(rows).join(numbers, "user_id", "left_anti"), first[0], last))


def user_sets(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(cell, bucket, bits): the users of each cell; rows are usage or a rollup with users and courses.

    Numbers, not bitmaps, go through the exchange: users of a bucket are spread over all tasks, and a task that made
    bitmaps before it would make one of 4 KB for nearly every row. After it a set is whole in its task.
    """
    active = F.coalesce(F.col("hours") > 0, F.lit(False))
    r = rows.where(F.col("user_id").isNotNull()).withColumn("active", active).select("user_id", *CELL)
    n = r.join(numbers.select("user_id", "number"), "user_id").select(
        *CELL, F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    return n.repartition("bucket", "period_index").groupBy(*CELL, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def user_sketches(rows: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(cell, sketch): HLL sketches of the users of each cell."""
    active = F.coalesce(F.col("hours") > 0, F.lit(False))
    r = rows.where(F.col("user_id").isNotNull()).withColumn("active", active)
    return r.groupBy(*CELL).agg(F.hll_sketch_agg("user_id", lg_k).alias("sketch"))


def distinct_users(index: DataFrame, *keys: str | Column) -> DataFrame:
    """Distinct users of the index's rows by ``keys``: exact over sets, estimated over sketches.

    Filter the index first (periods, brands, ``active``); keys are names or aliased columns.
    """
    if "sketch" in index.columns:
        return index.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
    united = index.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("c"))
    names = united.columns[:-2]
    return united.groupBy(*names).agg(F.sum("c").cast("long").alias("users"))


def rolling_users(index: DataFrame, periods: DataFrame, width: int, *keys: str) -> DataFrame:
    """Distinct users of the last ``width`` listed periods up to each period (fewer at the start), by ``keys``.

    A cell goes to the at most ``width`` windows that it lies in; a window in which a key has no users has no row.
    """
    dim = F.broadcast(periods.select("period_index", "pos", "max_pos"))
    ends = F.explode(F.sequence(F.col("pos"), F.least(F.col("pos") + width - 1, F.col("max_pos"))))
    spread = index.join(dim, "period_index").withColumn("end_pos", ends).drop("period_index", "pos", "max_pos")
    label = F.broadcast(periods.select(F.col("pos").alias("end_pos"), "period_index", "label"))
    return distinct_users(spread, "end_pos", *keys).join(label, "end_pos").select("period_index", "label", *keys, "users")
