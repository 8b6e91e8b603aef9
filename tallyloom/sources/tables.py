"""Tables by name under a folder, settings, and lookups in caches."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choices reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files; hidden ones are left out by the reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def settings(rows: DataFrame) -> DataFrame:
    """Key-value rows as one row with a map; the last of a repeated key in key, value order counts."""
    last = rows.groupBy("key").agg(F.max("value").alias("value"))
    return last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def first_existing(names: list[str], entries: list[tuple[str, bool]]) -> str | None:
    """The first enabled entry that names an existing sheet, else the first sheet."""
    return next((name for name, enabled in entries if enabled and name in names), names[0] if names else None)


def with_row_id(df: DataFrame, *order: str | Column) -> DataFrame:
    """Adds ``row_id`` 0, 1, 2, ... in the given order.

    Rows are laid out in ranges of the order and stored once, each with its place: a second pass over the order would
    sample other ranges.  The counts of the stored ranges shift the places, so no task sorts the whole table.  Equal
    rows keep the places they were stored with.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in counts], accumulate((n for _, n in counts), initial=0), strict=False))
    shift = spark.createDataFrame(list(before.items()), "_part long, _before long")
    return numbered.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn("row_id", F.col("_before") + local).select(*df.columns, "row_id")


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str, version: int, version_column: str = "version") -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses): entries of another format version do not count."""
    fresh = cache.filter(F.col(version_column) == version)
    return wanted.join(fresh, key), wanted.join(fresh, key, "left_anti")


def has_stale(wanted: DataFrame, cache: DataFrame, key: str, version: int, version_column: str = "version") -> DataFrame:
    """Wanted keys that are only cached in another format version."""
    hits, misses = cache_lookup(wanted, cache, key, version, version_column)
    return misses.join(cache, key, "left_semi")


def own_or_source_files(files_: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, ...) files of each job: its own, else those of the job it was copied from (one step)."""
    own = files_
    without = jobs.join(own, "job_id", "left_anti").filter("source_job_id IS NOT NULL").select(F.col("job_id").alias("_job"), "source_job_id")
    borrowed = own.join(without, own["job_id"] == without["source_job_id"]).select(F.col("_job").alias("job_id"), *[c for c in own.columns if c != "job_id"])
    return own.unionByName(borrowed)
