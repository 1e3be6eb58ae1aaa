"""Mixing sources to target weights by repetition rates.

``mix_plan`` sums the sizes of each source, derives the source's target and its
repetition rate (target over size), and gives each document floor(rate) copies
plus one more where a hash of its id, seeded, falls below the fraction.
``emit`` repeats the rows.

Targets: sources in code-point order, null last, get the given weights in turn
and share ``share`` times the size of all documents; no target is above
``most`` times its source's size, and what is left over goes to the other
sources by weight until none is above. That fixed point is
target = min(most * size, level * weight), with one level for all, found from
one row a source.

Cases: a null text has size 0; a null source is a source of its own; a source
of size 0 has target 0 and rate 0, its documents are not emitted; repeated rows
each get the same copies; an empty table gives an empty plan; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORD = r"[^ \t-\r]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix"


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: source, source_size, target, rate, from rows of source and size."""
    # One row a source from here on: the windows hold as many rows as there are sources.
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    # Raising the level caps sources in the order of size / weight.
    everything = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    later = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(all_rows) * F.lit(share)
                     - F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * F.lit(float(most)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(later))
    # The first source that is not capped at the level left to it sets the level of all that follow.
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(float(most))
    s = s.withColumn("final", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(
        everything.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    capped = F.col("source_size") * F.lit(float(most))
    target = F.when(F.col("final").isNull(), capped).otherwise(F.least(capped, F.col("final") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"),
                    F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of a key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, the columns of ``keep``, size, source_size, target, rate, copies."""
    columns = dict.fromkeys(["doc_id", "source", *keep])
    targets = cut(source_targets(docs.select("source", size_of().alias("size")), weights, share, most))
    sized = docs.select(*columns, size_of().alias("size"))
    rated = sized.join(targets.withColumnRenamed("source", "mix_source"),
                       F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    whole = F.floor("rate")
    copies = whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("bigint")
    return rated.withColumn("copies", copies.cast("int"))


def emit(plan: DataFrame) -> DataFrame:
    """The rows of a plan, each as often as its copies tell; ``copy`` counts from 1."""
    return plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def taken_sql(weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> str:
    """DuckDB SQL of the plan's doc_id, size, source_size, target and taken."""
    cases = " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS weight FROM src),
levels AS (
  SELECT a.source, a.source_size, a.weight,
    ((SELECT sum(source_size) FROM weighted) * {share}::DOUBLE
      - coalesce(sum(b.source_size) FILTER (WHERE b.source_size / b.weight < a.source_size / a.weight), 0) * {float(most)}::DOUBLE)
    / sum(b.weight) FILTER (WHERE b.source_size / b.weight >= a.source_size / a.weight) AS level
  FROM weighted a CROSS JOIN weighted b GROUP BY a.source, a.source_size, a.weight),
final AS (
  SELECT max(level) AS level FROM levels),  -- levels rise up to the first source that fits, then fall
targets AS (
  SELECT source, source_size,
    least(source_size * {float(most)}::DOUBLE, coalesce((SELECT level FROM final) * weight, source_size * {float(most)}::DOUBLE)) AS target
  FROM weighted),
rated AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CAST(s.size * (floor(r.rate) + CASE WHEN
    CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE
    < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
