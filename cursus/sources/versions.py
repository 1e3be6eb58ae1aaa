"""Versioned publishing of tables that belong together.

A version is a folder that is written once, ``versions/<name>``. It is published
by an empty file ``_published/<number>-<name>``, which is made last: creating
one file is atomic in every store, nothing is renamed, and nothing that a reader
may have open is overwritten. Readers list the published names once and take the
largest number, so they see all tables of one version. Whoever fails in between
leaves a folder that no reader finds. The last ``keep`` versions stay for readers
that began before; older ones go, and so do folders that were never
published after GRACE_HOURS.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

KEEP = 3
GRACE_HOURS = 24


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder and their times (ms); none if it does not exist."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path(folder))}


def published(spark: SparkSession, root: str) -> list[str]:
    """Published marks "<number>-<name>", oldest first; two publishers with one number are in the order of their names."""
    return sorted(n for n in _names(spark, f"{root}/_published") if not n.startswith("."))


def current(spark: SparkSession, root: str) -> str:
    """The folder of the last published version; ``root`` itself where nothing was published."""
    marks = published(spark, root)
    return f"{root}/versions/{marks[-1].split('-', 1)[1]}" if marks else root


def publish(spark: SparkSession, root: str, tables: dict[str, Callable[[str], None]], keep: int = KEEP) -> str:
    """Write each table to its folder of a new version, then publish it; returns the version's folder."""
    root = root.rstrip("/")
    name = uuid.uuid4().hex
    folder = f"{root}/versions/{name}"
    for table, write in tables.items():
        write(f"{folder}/{table}")
    marks = published(spark, root)
    number = int(marks[-1].split("-", 1)[0]) + 1 if marks else 1
    fs, path = _fs(spark, root)
    fs.mkdirs(path(f"{root}/_published"))
    fs.createNewFile(path(f"{root}/_published/{number:012d}-{name}"))
    clean(spark, root, keep)
    return folder


def clean(spark: SparkSession, root: str, keep: int = KEEP, grace_hours: float = GRACE_HOURS) -> None:
    """Remove versions before the last ``keep``, and old folders that were never published."""
    fs, path = _fs(spark, root)
    marks = published(spark, root)
    for mark in marks[:-keep] if keep else []:
        # the mark first: a reader that lists it later could not find the folder
        fs.delete(path(f"{root}/_published/{mark}"), False)
    known = {m.split("-", 1)[1] for m in published(spark, root)}
    gone = {m.split("-", 1)[1] for m in marks} - known
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    for name, time in _names(spark, f"{root}/versions").items():
        if name in gone or (name not in known and now - time > grace_hours * 3_600_000):
            fs.delete(path(f"{root}/versions/{name}"), True)
