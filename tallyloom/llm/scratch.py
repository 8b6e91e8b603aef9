"""Stored intermediate tables, caches of Python workers and the size of Arrow batches."""

from __future__ import annotations

import sys
import types

from pyspark.sql import SparkSession

from ..storage import discard, passing, release, stored

materialise = stored
__all__ = ["bound_batches", "discard", "materialise", "passing", "release", "worker_cache"]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, also when functions arrive pickled by value."""
    module = sys.modules.setdefault("_tallyloom_worker", types.ModuleType("_tallyloom_worker"))
    return module.__dict__.setdefault("cache", {})


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by size rather than by rows, so that a Python worker's memory does not follow the texts' lengths; the
    reader of Parquet holds fewer rows for the same reason."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")
