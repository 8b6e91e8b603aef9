"""Numbers written by people: parsing, exact money arithmetic and formatting, as Column expressions.

Money is DECIMAL(18,2) and rates are DECIMAL(6,3), so products are exact and ties are seen as ties.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip, text_of

MONEY, RATE = "decimal(18,2)", "decimal(6,3)"
ROUNDINGS = ("half_up", "half_even")


def _try(kind: str, c: Column) -> Column:
    return c.try_cast(kind)


def _prefix_number(c: Column) -> Column:
    """The number a text starts with, whatever follows; null if none."""
    return _try("double", F.regexp_extract(c, r"^([+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)", 1))


def parse_amount(c: Column) -> Column:
    """Italian or English amounts as double: the later of comma and dot is the decimal mark; a lone comma is one.

    Currency signs, spaces and apostrophes go; (x) is negative; what follows the number is ignored; null if unreadable.
    """
    s = F.regexp_replace(text_of(c), f"[€{SPACE}'’]", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    # one pass each, and no branches: dots before a comma and commas before a dot only separate thousands
    s = F.regexp_replace(F.regexp_replace(s, r"\.(?=.*,)", ""), r",(?=.*\.)", "")
    return _prefix_number(F.regexp_replace(s, "^([^,]*),", "$1."))


def to_money(c: Column) -> Column:
    """A double or decimal as money, rounded half up at cents."""
    return _try(MONEY, F.round(_try("decimal(28,8)", c), 2))


def to_cents(c: Column) -> Column:
    """A double as money in the arithmetic of doubles: hundredfold and rounded, ties away from zero.

    A plain cast goes by the shortest text of the double, so 1000.51 * 1.5 = 1500.7649999999999 would lose its cent.
    """
    return (F.round(c * F.lit(100.0)).cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def apply_rate(net: Column, rate: Column, rounding: str = "half_up") -> Column:
    """net x (1 + rate) in exact arithmetic, rounded to cents: ties away from zero, or to even."""
    if rounding not in ROUNDINGS:
        raise ValueError(f"rounding must be one of {ROUNDINGS}")
    exact = (net.cast(MONEY) * (F.lit(1).cast("decimal(7,3)") + rate.cast(RATE))).cast("decimal(30,5)")
    return (F.round(exact, 2) if rounding == "half_up" else F.bround(exact, 2)).cast(MONEY)


def round_half_up(c: Column, places: int = 2) -> Column:
    return F.round(c.cast("decimal(28,10)"), places)


def format_italian(c: Column, places: int = 2) -> Column:
    """1234.5 as 1.234,50; null stays null."""
    return F.translate(F.format_number(c, places), ",.", ".,")


def _dotless(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(""))


def parse_grouped(c: Column) -> Column:
    """Amounts by the grammar of grouped digits, or null: a comma is decimal, dots between threes are thousands, one
    or two digits after the last dot are decimals if the groups before allow it."""
    s = strip(F.regexp_replace(text_of(c), "(?i)€|(?<![a-z0-9_])euro?(?![a-z0-9_])", " "))
    ok = s.rlike(f"^-?[0-9{SPACE}.,]+$")
    s = F.regexp_replace(s, f"[{SPACE}]", "")
    decimals = s.rlike(r"^-?\d+(\.\d{3})*\.\d{1,2}$")
    number = (
        F.when(F.contains(s, F.lit(",")), _prefix_number(F.regexp_replace(_dotless(s), "^([^,]*),", "$1.")))
        .when(decimals, _try("double", F.concat(_dotless(F.regexp_extract(s, r"^(.*)\.(\d+)$", 1)), F.lit("."), F.regexp_extract(s, r"^(.*)\.(\d+)$", 2))))
        .otherwise(_prefix_number(_dotless(s)))
    )
    return F.when(ok, number)


def parse_pure(c: Column) -> Column:
    """Only a bare Italian amount, with a euro sign at most; anything else is null."""
    s = strip(text_of(c))
    ok = s.rlike(f"^[€{SPACE}]*[0-9][0-9.{SPACE}]*(?:,[0-9]+)?[{SPACE}]*€?$")
    return F.when(ok, _try("double", F.replace(_dotless(F.regexp_replace(s, f"[€{SPACE}]", "")), F.lit(","), F.lit("."))))


def loose_amount(c: Column) -> Column:
    """The first run of digits with dots and spaces between, and a decimal comma, as an amount."""
    run = F.regexp_extract(text_of(c), f"([0-9][0-9.{SPACE}]*(?:,[0-9]+)?)", 1)
    return _try("double", F.replace(F.regexp_replace(run, f"[.{SPACE}]", ""), F.lit(","), F.lit(".")))


def amounts_in(c: Column) -> Column:
    """Amounts of a line in order: not dates with dots, not bare years 1900-2099."""
    runs = F.regexp_extract_all(text_of(c), F.lit(r"(\d[\d.]*(?:,\d+)?)"), 1)
    kept = F.filter(runs, lambda r: ~r.rlike(r"^\d{1,2}[.\-]\d{1,2}[.\-]\d{2,4}$") & ~r.rlike(r"^(19|20)\d{2}$"))
    return F.filter(F.transform(kept, parse_grouped), lambda n: n.isNotNull())


def parse_exported(c: Column) -> Column:
    """A value for a numeric cell: amounts become numbers; dates, texts and codes with a leading zero stay out (null)."""
    s = strip(text_of(c))
    code = s.rlike(r"^0\d+$")
    number = s.rlike("^-?[0-9]{1,3}(\\.[0-9]{3})*(,[0-9]+)?$") | s.rlike(r"^-?\d+(,\d+)?$") | s.rlike(r"^-?\d+\.\d{1,2}$")
    return F.when(~code & number, parse_grouped(s))


def retype_cell(c: Column) -> Column:
    """Numbers of an exported cell: plain integers within 2**53, d.d and 1,234.5; ids with leading zeros stay text (null)."""
    s = strip(text_of(c))
    plain, grouped = s.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$"), s.rlike(r"^-?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    n = F.when(plain, _try("double", s)).when(grouped, _try("double", F.replace(s, F.lit(","), F.lit(""))))
    return F.when(F.abs(n) <= 2.0**53, n)


def to_number(c: Column) -> Column:
    """Permissive: all but digits, comma, dot and minus goes; a dot before three digits separates thousands."""
    s = F.regexp_replace(F.regexp_replace(text_of(c), r"[^0-9,.\-]", ""), r"\.(?=\d{3}(\D|$))", "")
    s = F.regexp_replace(s, "^([^,]*),", "$1.")
    return F.when(~s.isin("", "-", "."), _try("double", s))


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays of one length; null if their lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """A vector divided by its norm; null where the norm is 0 or unknown, so that its cosine counts as 0."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of one length; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def plausible_amount(c: Column, least: float = 50.0) -> Column:
    return c > least


def money_text_if_present(c: Column, text: Column) -> Column:
    """A bare number of cents, 127010, as 1.270,10 if the text has it so; else unchanged."""
    s = text_of(c)
    shown = format_italian(_try("decimal(18,2)", s) / F.lit(100))
    return F.when(s.rlike(r"^\d{3,}$") & F.contains(text, shown), shown).otherwise(s)
