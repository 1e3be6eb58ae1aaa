"""Folders that all executors see, bounded Arrow batches, and worker-level caches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts handed to one vectorised step together, in bytes. A longer text is a
#: step of its own: texts are never cut.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is missing, the session's checkpoint folder is used. A
    local session without either gets a temporary folder; on a cluster that is
    an error, since executors would each write to their own disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cursus-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing = {"lock": threading.Lock(), "open": 0, "before": None}


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a query that runs in here when the query ends, not when the driver happens to
    collect its garbage, which it does the more rarely the larger its heap is. The session's own setting comes back."""
    with _freeing["lock"]:
        if not _freeing["open"]:
            _freeing["before"] = spark.conf.get(_FREED, None)
        _freeing["open"] += 1
        spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        with _freeing["lock"]:
            _freeing["open"] -= 1
            if not _freeing["open"]:
                spark.conf.unset(_FREED) if _freeing["before"] is None else spark.conf.set(_FREED, _freeing["before"])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read back; its shuffle files go as soon as it is written."""
    path = shared_folder(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``most`` bytes each."""
    n, lo = batch.num_rows, 0
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    import numpy as np
    import pyarrow.compute as pc
    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch],
               schema: str, text: str = "text") -> DataFrame:
    """``fn`` over bounded slices of the Arrow batches of each partition."""
    def run(batches):
        for b in batches:
            for part in chunks(b, text):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers stay for other tasks, and count in their executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, whatever task runs."""
    module = sys.modules.setdefault("cursus_llm_worker", types.ModuleType("cursus_llm_worker"))
    return module.__dict__.setdefault(name, {})
