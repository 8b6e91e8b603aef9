"""Sinks: exports as CSV, long and wide tables, checked writes and side tables for failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_exported, retype_cell


def ordered_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; columns in order of first appearance."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Labelled streams one below the other, with their label as ``origin``."""
    return ordered_union([df.withColumn("origin", F.lit(name)) for name, df in parts.items()])


def retyped(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_num`` where a cell's text is a number."""
    return rows.select("*", *[retype_cell(F.col(c)).alias(f"{c}_num") for c in columns])


def wide_fields(values: DataFrame, fields: Sequence[str], entity: str = "job_id") -> DataFrame:
    """Long values (entity, field_id, value) as one row per entity and a column per field, in the given order."""
    return values.groupBy(entity).pivot("field_id", list(fields)).agg(F.first("value", ignorenulls=True))


def field_order(fields: DataFrame) -> list[str]:
    """Field ids of several jobs in order of first appearance (job order, place); a small dimension."""
    return [r["field_id"] for r in fields.groupBy("field_id").agg(F.min(F.struct("job_order", "place")).alias("m")).orderBy("m").collect()]


def name_value(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One record as (name, value) rows."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def template_cells(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sheet, ref, value, number): each field's value in all its cells (mapping: field_id, sheet, ref)."""
    return values.join(mapping, "field_id").select("sheet", "ref", "value", parse_exported(F.col("value")).alias("number"))


def template_changes(values: DataFrame, mapping: DataFrame, current: DataFrame) -> DataFrame:
    """(sheet, ref, field_id, old, new, changed): the first field of each cell against the cell's present text."""
    first = Window.partitionBy("sheet", "ref").orderBy("ord", "field_id")
    new = values.join(mapping, "field_id").withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    joined = new.join(current.select("sheet", "ref", F.col("text").alias("old")), ["sheet", "ref"], "left")
    return joined.select("sheet", "ref", "field_id", F.coalesce("old", F.lit("")).alias("old"), F.col("value").alias("new"), (F.coalesce("old", F.lit("")) != F.col("value")).alias("changed"))


def approved(changes: DataFrame) -> DataFrame:
    return changes.filter("approved")


def matches_export(verdicts: DataFrame, most: int | None = 20) -> DataFrame:
    """One row per match of ``verdict_by_row`` results, rows without a match once, with the true count."""
    listed = verdicts if most is None else verdicts.withColumn("matches", F.slice("matches", F.lit(1), F.lit(most)))
    return listed.select("row_id", "match_count", F.posexplode_outer("matches").alias("place", "b_row"))


def write_csv(rows: DataFrame, path: str, quote_all: bool = True) -> None:
    rows.write.option("header", True).option("quoteAll", quote_all).mode("overwrite").csv(path)


class ReadBackError(ValueError):
    """What was written is not what was meant."""


def checked_write(rows: DataFrame, path: str, key: Column | None = None) -> None:
    """Write Parquet and compare row count and a checksum over all columns with what is read back."""
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(c) for c in rows.columns]).cast("decimal(38,0)"))).first()
    rows.write.mode("overwrite").parquet(path)
    if sums(rows) != sums(rows.sparkSession.read.parquet(path)):
        raise ReadBackError(path)


def append_checked(rows: DataFrame, path: str, existing: DataFrame, capacity: int | None = None) -> None:
    """Append in the existing layout: its columns and order win, unknown columns are refused, capacity is checked first."""
    if extra := [c for c in rows.columns if c not in existing.columns]:
        raise ReadBackError(f"columns that the layout lacks: {extra}")
    if capacity is not None and existing.count() + rows.count() > capacity:
        raise ReadBackError("the file is full")
    out = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in existing.columns])
    out.write.mode("append").parquet(path)
