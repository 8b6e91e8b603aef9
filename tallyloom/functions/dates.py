"""Dates written by people, as Column expressions.  Text dates are dd/MM/yyyy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, strip, text_of

ITALIAN = "dd/MM/yyyy"
_DMY, _YMD = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})"
#: Lines about issuing or printing a document never date its content.
ISSUE_LINE = r"(?i)(EMESS|EMISSIONE|STAMPAT|RILASCIAT|DATA\s+DOC)"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _rolled(y: Column, m: Column, d: Column) -> Column:
    """A date whose month and day may overflow into the next months, as in 31/02."""
    month = F.expr("DATE '1970-01-01'")
    return F.date_add(F.add_months(month, ((y - 1970) * 12 + m - 1).cast("int")), (d - 1).cast("int"))


def to_date(c: Column) -> Column:
    """d/m/yyyy with / . or -, or yyyy-mm-dd...; days and months that overflow roll over; else null."""
    s = strip(text_of(c))
    part = lambda pattern, i: _int(F.regexp_extract(s, pattern, i))
    return F.when(s.rlike(_DMY), _rolled(part(_DMY, 3), part(_DMY, 2), part(_DMY, 1))).when(s.rlike(_YMD), _rolled(part(_YMD, 1), part(_YMD, 2), part(_YMD, 3)))


def from_serial(c: Column) -> Column:
    """A spreadsheet's day number (1 is 1899-12-31) as a date."""
    return F.date_from_unix_date((F.floor(c) - 25569).cast("int"))


def to_text(d: Column) -> Column:
    return F.coalesce(F.date_format(d, ITALIAN), F.lit(""))


def track_text(c: Column, offset_days: int = 0) -> Column:
    """The date as text, moved by days; what isn't a date passes unchanged, null as ''."""
    d = to_date(c)
    return F.when(d.isNotNull(), to_text(F.date_add(d, offset_days))).otherwise(text_of(c))


def first_of_month(c: Column) -> Column:
    return to_text(F.trunc(to_date(c), "month"))


def add_years(c: Column, years: int = 1) -> Column:
    """The date moved by years, 29/02 to 28/02; what isn't a date passes unchanged."""
    d = to_date(c)
    return F.when(d.isNotNull(), to_text(F.add_months(d, 12 * years))).otherwise(text_of(c))


def expiry_bucket(d: Column, now: Column) -> Column:
    """past, current or next by whole months against ``now``; null otherwise."""
    months = (F.year(d) * 12 + F.month(d)) - (F.year(now) * 12 + F.month(now))
    return F.when(months == -1, "past").when(months == 0, "current").when(months == 1, "next")


def rome_day(ts: Column) -> Column:
    """The calendar day in Rome of a UTC timestamp, yyyyMMdd."""
    return F.date_format(F.from_utc_timestamp(ts, "Europe/Rome"), "yyyyMMdd")


def normalise_date(c: Column) -> Column:
    """Four notations as dd/MM/yyyy; day 1-31 and month 1-12 are checked, the calendar is not; else null."""
    s = strip(text_of(c))
    ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    part = lambda i, j: F.when(s.rlike(_DMY), _int(F.regexp_extract(s, _DMY, i))).when(s.rlike(ymd), _int(F.regexp_extract(s, ymd, j)))
    d, m, y = part(1, 3), part(2, 2), part(3, 1)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(d.between(1, 31) & m.between(1, 12), F.concat_ws("/", two(d), two(m), y.cast("string")))


def text_day(c: Column) -> Column:
    """A strict dd/MM/yyyy text as a date (overflow rolls over), else null."""
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), to_date(c))


def newer_wins(old: Column, new: Column) -> Column:
    """True if a value dated ``new`` may replace one dated ``old``: a dated value never yields to an older or undated one."""
    a, b = text_day(old), text_day(new)
    return F.coalesce(~(a.isNotNull() & (b.isNull() | (b < a))), F.lit(True))


def _dates_of(c: Column, year: str = r"\d{4}") -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"(?<!\d)(\d{{1,2}}[/.]\d{{1,2}}[/.]{year})(?!\d)"), 1)
    return F.filter(F.transform(found, normalise_date), lambda d: d.isNotNull())


def labelled_date(text: Column, label: str, reach: int, last: bool = False) -> Column:
    """The first (or last) date within ``reach`` characters after a label on its line."""
    line = F.regexp_extract(text_of(text), rf"(?i){label}(?![A-Za-z0-9_])[^\n]{{0,{reach}}}", 0)
    dates = _dates_of(line)
    return F.get(dates, (F.size(dates) - 1) if last else F.lit(0))


def latest_date(text: Column) -> Column:
    """The latest 20xx date on lines that aren't about issuing or printing."""
    kept = F.filter(lines(text), lambda x: ~x.rlike(ISSUE_LINE))
    days = F.transform(F.flatten(F.transform(kept, lambda x: _dates_of(x, r"20\d{2}"))), text_day)
    return F.date_format(F.array_max(days), ITALIAN)


#: Labels that date a document, in order, with their reach and whether the line's last date counts.
DATE_LABELS = (("SCADENZA", 100, False), ("PERIODO", 140, True), ("DECORRENZA", 100, False), ("EFFETTO", 100, False))


def document_date(text: Column) -> Column:
    """The most advanced coverage date a document states: end, period end, start, effect, else its latest date."""
    return F.coalesce(*[labelled_date(text, *x) for x in DATE_LABELS], latest_date(text))
