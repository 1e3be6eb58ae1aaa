"""Bounded samples of labelled documents to learn from, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row is held out if crc32 of its doc_id, as text, has this remainder by 4.
FOLDS, HELD = 4, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """Is the row held out from learning? A null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: str = "fit") -> DataFrame:
    """At most ``most`` labelled doc_ids that are not held out, chosen by hash, with their texts: text, label.

    The ids are few by construction, so they are broadcast. A doc_id with
    several labels counts with the largest; null labels and ids don't count.
    """
    known = labels.select(F.col("doc_id").alias("fit_id"), F.col(label).cast("int").alias("label")).where(
        F.col("fit_id").isNotNull() & F.col("label").isNotNull() & ~held_out("fit_id"))
    chosen = (known.groupBy("fit_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64(F.lit(seed), "fit_id"), "fit_id").limit(most))
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("fit_id"))
            .select("text", "label"))
