"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names: they cut lineage and survive executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that this process wrote and has not deleted, and the frames that read them.
_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, local mode takes a temporary one; a cluster has to name one, as executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tallyloom-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: later jobs restart from these files.

    The shuffles of the write are deleted with it.  Spark otherwise waits until the driver's heap happens to be
    collected, and the files of all rounds of a loop lie on the executors' disks until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later plan reads; frames that are not stored tables are left alone."""
    for table in tables:
        path = _paths.pop(table, None) if table is not None else None
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside the block are deleted when it ends; the function it yields marks those that stay."""
    before, kept = len(_written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_paths[table])
        return table

    try:
        yield keep
    finally:
        for path in [p for p in _written[before:] if p not in kept]:
            _written.remove(path)
            _delete(SparkSession.getActiveSession(), path)


def release(spark: SparkSession) -> None:
    """Delete the tables this process wrote; call it when the results that read them are stored."""
    while _written:
        _delete(spark, _written.pop())
