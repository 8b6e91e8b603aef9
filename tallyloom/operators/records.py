"""Enrolment records: layout, validation, life cycle, expiry and numbering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_years, expiry_bucket, rome_day, to_date, track_text
from ..functions.text import advance_if_accepted, coerce_option, safe_name, strip, text_of

MIN_PAIRS, MAX_PAIRS = 5, 20
STATUSES = ("pending", "exported", "archived")


@dataclass(frozen=True)
class FieldRule:
    """One field of a record: where it comes from, where it goes, and what its value must be."""

    id: str
    label: str
    type: str = "text"  # text, date, number, email or select
    required: bool = False
    max_length: int | None = None
    fixed: str | None = None
    options: tuple[str, ...] = ()
    flow_column: str | None = None
    track_column: str | None = None


def track_headers(base: Sequence[str], questions: int) -> list[str]:
    """The layout widened to a question and an answer column for each of max(5, questions) pairs, 20 at most."""
    n = min(MAX_PAIRS, max(MIN_PAIRS, questions))
    return [*base, *[h for i in range(1, n + 1) for h in (f"DOMANDA {i}", f"RISPOSTA {i}")]]


def pair_capacity(headers: Sequence[str]) -> int:
    """How many pairs from 1 on a layout holds without a gap."""
    known = {" ".join(h.upper().split()) for h in headers}
    n = 0
    while {f"DOMANDA {n + 1}", f"RISPOSTA {n + 1}"} <= known:
        n += 1
    return n


def flow_to_records(rows: DataFrame, fields: Sequence[FieldRule], questions: int = 0) -> DataFrame:
    """Flat file rows as records: headers match without regard to case and spaces, options get their zeros back.

    ``idd`` maps question numbers to answers, from four spellings of the answer's header.  Rows without any value go.
    """
    known = {" ".join(c.replace("’", "'").upper().split()): c for c in rows.columns}
    pick = lambda name: F.col(f"`{known[' '.join(name.upper().split())]}`") if name and " ".join(name.upper().split()) in known else F.lit(None)
    columns = []
    for f in fields:
        value = F.lit(f.fixed) if f.fixed is not None else strip(text_of(pick(f.flow_column)))
        value = track_text(value) if f.type == "date" else value
        columns.append((coerce_option(value, f.options) if f.options else value).alias(f.id))
    answers = []
    for i in range(1, questions + 1):
        spellings = [pick(s) for s in (f"RISPOSTA {i}", f"RISPOSTA{i}", f"RISP {i}", f"R{i}")]
        answers += [F.lit(str(i)), F.coalesce(*[F.nullif(strip(text_of(c)), F.lit("")) for c in spellings], F.lit(""))]
    idd = (F.create_map(*answers) if answers else F.create_map().cast("map<string,string>")).alias("idd")
    full = F.lit(False)
    for c in rows.columns:
        full = full | (strip(text_of(F.col(f"`{c}`"))) != "")
    return rows.filter(full).select(*columns, idd)


def records_to_track(records: DataFrame, fields: Sequence[FieldRule], headers: Sequence[str], questions: Sequence[str] = (), activation: Column | None = None) -> DataFrame:
    """Records in a fixed layout, all text: columns by header, dates normalised, questionnaire only for activations."""
    by_header = {" ".join((f.track_column or "").upper().split()): f for f in fields if f.track_column}
    active = F.lit(True) if activation is None else activation
    out = []
    for h in headers:
        key = " ".join(h.upper().split())
        kind, _, number = key.partition(" ")
        if key in by_header:
            f = by_header[key]
            value = F.lit(f.fixed) if f.fixed is not None else F.col(f.id)
            c = track_text(value) if f.type == "date" else text_of(value)
        elif kind in ("DOMANDA", "RISPOSTA") and number.isdigit() and int(number) <= len(questions):
            answer = F.coalesce(F.try_element_at("idd", F.lit(number)), F.lit(""))
            c = F.when(active & (answer != ""), F.lit(questions[int(number) - 1]) if kind == "DOMANDA" else answer).otherwise("")
        else:
            c = F.lit("")
        out.append(c.alias(h))
    return records.select(*out)


def errors(fields: Sequence[FieldRule]) -> Column:
    """Violations of a record, in the fields' order: array of (field, error)."""
    found = []
    for f in fields:
        v = strip(text_of(F.lit(f.fixed) if f.fixed is not None else F.col(f.id)))
        bad = F.when(v == "", F.lit("required") if f.required else F.lit(None).cast("string"))
        if f.max_length is not None:
            bad = bad.when(F.length(v) > f.max_length, "too long")
        if f.type == "date":
            bad = bad.when(to_date(v).isNull(), "not a date")
        if f.type == "number":
            bad = bad.when(~F.translate(v, ",", ".").rlike(r"^-?\d+(\.\d+)?$"), "not a number")
        if f.type == "email":
            bad = bad.when(~v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "not an e-mail address")
        if f.type == "select" and f.options:
            bad = bad.when(~v.isin(*f.options), "not an option")
        found.append(F.when(bad.isNotNull(), F.struct(F.lit(f.id).alias("field"), bad.alias("error"))))
    return F.array_compact(F.array(*found))


def missing_answers(questions: int, applies: Column) -> Column:
    """Numbers of the questions without an answer, where the questionnaire applies."""
    every = F.sequence(F.lit(1), F.lit(questions)) if questions else F.array().cast("array<int>")
    return F.when(applies, F.filter(every, lambda i: F.coalesce(F.try_element_at("idd", i.cast("string")), F.lit("")) == "")).otherwise(F.array().cast("array<int>"))


def search(records: DataFrame, text: str, columns: Sequence[str], status: str | None = None, limit: int = 1000, order: str = "id") -> DataFrame:
    """Records one of whose columns contains the text in any case, of a status if given, the newest first."""
    out = records
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
        out = out.filter(hit)
    if status:
        out = out.filter(F.col("status") == status)
    return out.orderBy(F.desc(order)).limit(limit)


def by_expiry(records: DataFrame, end: str, now: Column, order: str = "row_id") -> DataFrame:
    """(bucket, place, id): records whose end falls into the month before, of or after ``now``, numbered by end date.

    A bucket is ranked month day by month day, so no task sorts a bucket as a whole: places within a day are shifted by
    the counts of the days before, of which there are 31 at most in a bucket.
    """
    d = to_date(F.col(end))
    rows = records.select(expiry_bucket(d, now).alias("bucket"), d.alias("end"), F.col(order).alias("id")).filter("bucket IS NOT NULL")
    days = rows.groupBy("bucket", "end").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("bucket", "end").orderBy("id")))
    return ranked.join(F.broadcast(days.select("bucket", "end", before.alias("_before"))), ["bucket", "end"]).select("bucket", (F.col("_before") + F.col("_r")).alias("place"), "id")


def renew(records: DataFrame, ids: DataFrame, years: int = 1, start: str = "start", end: str = "end") -> DataFrame:
    """The named records moved by years and pending again; the rest unchanged."""
    named = records.join(ids.select("id").distinct().withColumn("_named", F.lit(True)), "id", "left")
    moved = lambda c: F.when(F.col("_named"), add_years(F.col(c), years)).otherwise(F.col(c))
    return named.withColumn(start, moved(start)).withColumn(end, moved(end)).withColumn("status", F.when(F.col("_named"), "pending").otherwise(F.col("status"))).drop("_named")


def archive(records: DataFrame, ids: DataFrame, batch: str, at: Column) -> DataFrame:
    """The named records archived under a batch; the rest unchanged."""
    named = records.join(ids.select("id").distinct().withColumn("_named", F.lit(True)), "id", "left")
    put = lambda c, v: F.when(F.col("_named"), v).otherwise(F.col(c))
    return named.withColumn("status", put("status", F.lit("archived"))).withColumn("export_batch", put("export_batch", F.lit(batch))).withColumn("exported_at", put("exported_at", at)).drop("_named")


def promote(records: DataFrame, columns: Mapping[str, str], data: str = "data") -> DataFrame:
    """Searchable columns from a map column: new name -> key."""
    return records.select("*", *[F.coalesce(F.try_element_at(data, F.lit(key)), F.lit("")).alias(name) for name, key in columns.items()])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: bool = False) -> DataFrame:
    """Insert or update by key (insert or ignore with ``keep_old``); a repeated new key counts once, the greatest row."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in new.columns if c not in keys])
    once = new.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r").select(*old.columns)
    if keep_old:
        return old.unionByName(once.join(old, list(keys), "left_anti"))
    return old.join(once, list(keys), "left_anti").unionByName(once)


def delete_where(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows without those whose columns equal all given values; an empty condition is refused."""
    if not equal:
        raise ValueError("refusing to delete without a condition")
    hit = F.lit(True)
    for c, v in equal.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return rows.filter(~hit)


def next_numbers(numbering: DataFrame, accepted: Column) -> DataFrame:
    """A numbering table (current) advanced where the accepted number is the suggested one."""
    return numbering.withColumn("current", advance_if_accepted(F.col("current"), accepted))


def export_name(policy: Column, when: Column, prefix: str = "TRACCIATO") -> Column:
    """A file name from the policy number and the calendar day in Rome."""
    return F.concat(F.lit(prefix + "_"), safe_name(policy), F.lit("_"), rome_day(when), F.lit(".xlsx"))


