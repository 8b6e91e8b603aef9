"""Checksums and sanity of identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, squeeze, strip, text_of

#: Contribution of each character at odd places (from 1) of a 16-character fiscal code, for 0-9 and A-Z.
ODD_PLACES = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
#: Fixed value: its structure; digits may be replaced by letters.
CODE_STRUCTURE = "^[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$"
#: What people and models write for a missing value.
PLACEHOLDERS = (
    "non specificato", "non specificata", "non indicato", "non indicata", "non presente", "non disponibile",
    "non applicabile", "non riportato", "non riportata", "non pervenuto", "non definito", "non definita",
    "non trovato", "non trovata", "non previsto", "non prevista", "n/d", "n.d.", "n.d", "nd", "n/a", "n.a.", "n.a",
    "na", "null", "none", "nil", "undefined", "nessuno", "nessuna", "sconosciuto", "sconosciuta", "da definire",
    "da compilare", "da verificare", "vuoto", "assente", "mancante", "x", "xxx", "?", "??", "???", "...",
)


def valid_vat(c: Column) -> Column:
    """An 11-digit number with its check digit, whose first ten digits aren't all alike."""
    s = text_of(c)
    digit = lambda i: F.ascii(F.substring(s, i + 1, 1)) - 48
    total = None
    for i in range(10):
        d = digit(i) if i % 2 == 0 else F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
        total = d if total is None else total + d
    check = F.pmod(F.lit(10) - total % 10, F.lit(10))
    return F.when(s.rlike(r"^[0-9]{11}$") & ~s.rlike(r"^([0-9])\1{9}"), check == digit(10)).otherwise(F.lit(False))


def valid_fiscal_code(c: Column) -> Column:
    """A 16-character code: structure and check letter, in any case."""
    s = F.upper(text_of(c))
    odd = F.array(*map(F.lit, ODD_PLACES))

    def place(i: int) -> Column:
        a = F.ascii(F.substring(s, i + 1, 1))
        index = F.when(a < 58, a - 48).otherwise(a - 55)
        return F.get(odd, index) if i % 2 == 0 else F.when(a < 58, a - 48).otherwise(a - 65)

    total = None
    for i in range(15):
        total = place(i) if total is None else total + place(i)
    return F.when(s.rlike(CODE_STRUCTURE), F.ascii(F.substring(s, 16, 1)) == 65 + total % 26).otherwise(F.lit(False))


def clean_fiscal_id(c: Column) -> Column:
    """The validated VAT number or fiscal code in a value, else null.

    Spaces, dots and dashes go.  A zero-padded VAT number is cut to 11 digits; letters that OCR takes for digits are
    repaired in 11-character values, if the result passes the check.
    """
    s = F.upper(F.regexp_replace(text_of(c), f"[{SPACE}.\\-]", ""))
    tail, repaired = F.right(s, F.lit(11)), F.translate(s, "OISBL", "0158L")
    padded = s.rlike(r"^0{1,5}[0-9]{11}$")
    return (
        F.when(s.rlike("^[0-9]{11}$"), F.when(valid_vat(s), s))
        .when(padded & valid_vat(tail), tail)
        .when(F.length(s) == 16, F.when(valid_fiscal_code(s), s))
        .when(valid_vat(repaired), repaired)
    )


def is_placeholder(c: Column) -> Column:
    """True where a value only says that there is none: null, blank, dashes, or a known phrase in full."""
    edge = f"[\"'«»()\\[\\]{{}}{SPACE}]+"
    v = F.lower(squeeze(F.regexp_replace(strip(text_of(c)), f"^{edge}|{edge}$", "")))
    return (v == "") | v.isin(*PLACEHOLDERS) | v.rlike(f"^[-–—_.·{SPACE}]+$") | v.rlike(f"^vedi[{SPACE}]")


def is_garbage(c: Column) -> Column:
    """True for identifiers with doubled punctuation or 30 % or more of other characters than letters and digits."""
    s = strip(text_of(c))
    alnum = F.length(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    return F.when(s == "", F.lit(False)).otherwise(s.rlike(r"([^A-Za-z0-9])\1") | (alnum / F.length(s) <= 0.7))


def has_digit_run(text: Column, digits: Column) -> Column:
    """True if a whole block of digits in the text equals ``digits`` (four or more).

    A block may hold dots, commas and letters that OCR takes for digits, which do not count; ``00`` or, after a comma,
    one or two decimals may follow the digits.
    """
    blocks = F.regexp_extract_all(text_of(text), F.lit("([0-9oOiIlLsS.,]+)"), 1)

    def hit(block: Column) -> Column:
        clean = F.regexp_replace(block, "[^0-9]", "")
        rest = F.substr(clean, F.length(digits) + 1)
        return clean.startswith(digits) & (rest.isin("", "00") | (F.contains(block, F.lit(",")) & (F.length(rest) <= 2)))

    return F.coalesce((F.length(digits) >= 4) & F.exists(blocks, hit), F.lit(False))
