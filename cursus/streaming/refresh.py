"""Refresh job: new period exports land in a folder; the prepared usage table is
rebuilt for exactly the periods that arrived.

A file stream with ``Trigger.AvailableNow`` tells which files are new (kept in
the streaming checkpoint, so a restarted run resumes). For every period that a
new file belongs to, the batch function lists the period's exports, reads the
newest one whole, all its part files, each by its own header, and overwrites the
period's partition. So the result does not depend on how files fall into
batches: an older export never comes back, a re-delivered one replaces its
period. Files in folders that name no period are skipped. No watermark or state
is needed: each export is a complete snapshot.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..sources.files import list_files, newest_exports, period_of, read_exports
from ..sources.sinks import write_usage
from .derived import refresh_derived


def refresh_usage(spark: SparkSession, landing_glob: str, out_path: str, checkpoint: str, cfg: Config,
                  pseudonymise: bool = True, derived: str | None = None):
    """Run one AvailableNow refresh and wait for it; returns the finished query.

    With ``derived``, a folder, the derived tables there follow (``streaming.derived``): the touched periods are read
    and replaced, no others.
    """
    arrived = spark.readStream.text(landing_glob).select(F.col("_metadata.file_path").alias("file"))

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        # one name for each new file
        touched = {period_of(r.file) for r in batch.distinct().collect()} - {None}
        exports = newest_exports(list_files(spark, landing_glob))
        files = [(period, path) for period in sorted(touched) for path in exports.get(period, [])]
        if files:
            write_usage(read_exports(spark, files, cfg), out_path, pseudonymise=pseudonymise, by_file=True)
            if derived:
                refresh_derived(spark, out_path, derived, {period for period, _ in files}, cfg)

    q = (arrived.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def landing_glob(root: str) -> str:
    return os.path.join(root, "month_to_month", "*", "*.{csv,csv.gz}")
