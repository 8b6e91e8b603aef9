"""Which files of a folder tree to take, and how they form dossiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_contained


@dataclass(frozen=True)
class PathFilters:
    """All words in lower case; names are whole path segments."""

    extension: str = ".pdf"
    excluded_names: tuple[str, ...] = ()
    exclude_words: tuple[str, ...] = ()
    profile_exclude_words: tuple[str, ...] = ()
    include_words: tuple[str, ...] = ()


#: Names of files and folders that systems leave behind.
JUNK = ("__macosx", "thumbs.db", "desktop.ini", "$recycle.bin", "system volume information")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def excluded_name(path: Column, names: Sequence[str] = ()) -> Column:
    """True if a segment is hidden, a lock file, junk or a given name."""
    listed = [*JUNK, *names]
    return F.exists(_segments(F.lower(path)), lambda s: s.startswith(".") | s.startswith("~$") | s.isin(*listed))


def path_verdict(path: Column, filters: PathFilters) -> Column:
    """struct(kept, reason, matched): extension, names, exclude words, profile's exclude words, include words, in turn."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    bad, worse, good = (first_contained(p, w) for w in (filters.exclude_words, filters.profile_exclude_words, filters.include_words))
    out = lambda kept, reason, matched: F.struct(F.lit(kept).alias("kept"), F.lit(reason).cast("string").alias("reason"), matched.alias("matched"))
    none = F.lit(None).cast("string")
    verdict = (
        F.when(~p.endswith(filters.extension), out(False, "extension", none))
        .when(excluded_name(p, filters.excluded_names), out(False, "excluded_name", none))
        .when(bad.isNotNull(), out(False, "exclude_word", bad))
        .when(worse.isNotNull(), out(False, "profile_exclude_word", worse))
    )
    if filters.include_words:
        return verdict.when(good.isNull(), out(False, "include_word", none)).otherwise(out(True, None, good))
    return verdict.otherwise(out(True, None, none))


def parent_folder(path: Column) -> Column:
    s = _segments(path)
    return F.array_join(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), "/")


def dossiers(paths: DataFrame, filters: PathFilters, path: str = "path") -> DataFrame:
    """(dossier, first, rows): kept files by folder, files outside any folder each on their own, in order of appearance."""
    kept = paths.withColumn("_v", path_verdict(F.col(path), filters)).filter("_v.kept")
    folder = parent_folder(F.col(path))
    name = F.when(folder == "", F.concat(F.lit("#"), F.col("row_id").cast("string"))).otherwise(folder)
    return kept.groupBy(name.alias("dossier")).agg(F.min("row_id").alias("first"), F.array_sort(F.collect_list("row_id")).alias("rows"))


def skipped(paths: DataFrame, filters: PathFilters, path: str = "path") -> DataFrame:
    return paths.select("row_id", path, path_verdict(F.col(path), filters).alias("v")).filter("NOT v.kept").select("row_id", path, "v.reason", "v.matched")


def merge_dossiers(groups: DataFrame, merged: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """Dossiers under the names that users merged them to (dossier, target); the ones in ``split`` fall into single files."""
    named = groups.join(merged, "dossier", "left").withColumn("dossier", F.coalesce("target", "dossier")).drop("target")
    rows = named.select("dossier", F.explode("rows").alias("row_id"))
    if split is not None:
        rows = rows.join(split.select("dossier").distinct().withColumn("_s", F.lit(True)), "dossier", "left")
        rows = rows.withColumn("dossier", F.when(F.col("_s"), F.concat_ws("#", "dossier", F.col("row_id").cast("string"))).otherwise(F.col("dossier"))).drop("_s")
    return rows.groupBy("dossier").agg(F.min("row_id").alias("first"), F.array_sort(F.collect_list("row_id")).alias("rows"))


def detect_profile(rows: DataFrame, profiles: Sequence[tuple[str, Sequence[str]]], default: str, text: str = "path", chosen: str | None = None) -> DataFrame:
    """Adds ``profile``: the chosen one, else the first with a keyword in the text, else the default."""
    found = None
    for name, words in profiles:
        hit = first_contained(F.lower(F.col(text)), [w.lower() for w in words]).isNotNull()
        found = F.when(hit, name) if found is None else found.when(hit, name)
    found = F.lit(default) if found is None else found.otherwise(default)
    return rows.withColumn("profile", F.coalesce(F.col(chosen), found) if chosen else found)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in order of appearance, with that order."""
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")


def last_non_blank(rows: DataFrame, group: Sequence[str], order: str, text: str, name: str) -> DataFrame:
    """Adds the nearest earlier row's text that isn't blank."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.nullif(F.trim(text), F.lit("")), ignorenulls=True).over(w))
