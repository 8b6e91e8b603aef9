"""String expressions: every function takes and returns a Column, so a plan keeps them inside code generation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular-expression class body; spelled out because engines differ on no-break spaces.
SPACE = r"\s   -     　﻿"
#: A word boundary among ASCII letters, digits and underscore only.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
TRANSFORMS = ("default", "letters_only", "digits_only", "last6", "last4")


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into one ASCII letter and marks, from the Unicode tables."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def text_of(c: Column) -> Column:
    """The value as text, null as an empty one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), "[̀-ͯ]", "")


def last_chars(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.right(c, F.lit(n)))


def normalise_key(c: Column, transform: str = "default") -> Column:
    """A comparison key: upper case, no spaces, dots or apostrophes, no leading zeros; '' for null.

    ``letters_only`` works on the upper-cased text itself; ``digits_only``, ``last6`` and ``last4`` on the key's digits.
    """
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform!r}")
    upper = F.upper(strip(text_of(c)))
    if transform == "letters_only":
        return F.regexp_replace(upper, "[^A-Z]", "")
    base = F.regexp_replace(F.regexp_replace(upper, f"[{SPACE}.'`]", ""), "^0+([^0])", "$1")
    if transform == "default":
        return base
    digits = F.regexp_replace(base, "[^0-9]", "")
    return {"digits_only": digits, "last6": last_chars(digits, 6), "last4": last_chars(digits, 4)}[transform]


def alphanumeric(c: Column) -> Column:
    """Upper case, A-Z and 0-9 only; accented letters go."""
    return F.regexp_replace(F.upper(text_of(c)), "[^A-Z0-9]", "")


def parse_ignore_words(raw: str | None) -> list[str]:
    """Words to leave out of fuzzy matching: split at , ; and newline, alphanumeric, two characters at least, distinct."""
    words = (re.sub("[^A-Z0-9]", "", w.upper()) for w in re.split(r"[,;\n]", raw or ""))
    return list(dict.fromkeys(w for w in words if len(w) >= 2))


def without_words(c: Column, words: Iterable[str]) -> Column:
    """Every occurrence of each word removed, one word after the other."""
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def char_grams(c: Column, n: int) -> Column:
    """Distinct character n-grams in order of first occurrence; an empty array for shorter texts."""
    size = F.length(c) - (n - 1)
    return F.when(size >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def normalise_label(c: Column) -> Column:
    """Folded, lower case, dashes, slashes, underscores and colons as spaces, spaces squeezed."""
    return squeeze(F.regexp_replace(F.lower(fold_accents(text_of(c))), "[-‐-―/_:;]+", " "))


def letters_and_digits(c: Column, spaced: bool = False) -> Column:
    """Folded, lower case, a-z and 0-9; other runs go, or become one space."""
    folded = F.lower(fold_accents(text_of(c)))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")) if spaced else F.regexp_replace(folded, "[^a-z0-9]", "")


def fold_spaced(c: Column) -> Column:
    return squeeze(F.lower(fold_accents(text_of(c))))


def normalise_header(c: Column) -> Column:
    """Typographic apostrophes as plain ones, spaces squeezed, upper case."""
    return F.upper(squeeze(F.translate(text_of(c), "‘’ʼ´`", "'''''")))


def collapse_lines(c: Column) -> Column:
    """Per line: runs of spaces as one, none at the ends."""
    return F.array_join(F.transform(F.split(text_of(c), "\n"), squeeze), "\n")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def useful_length(c: Column) -> Column:
    """Length with runs of spaces counted as one."""
    return F.length(F.regexp_replace(text_of(c), f"[{SPACE}]+", " "))


def words(c: Column, shortest: int = 3) -> Column:
    """Lower-case words of letters, digits and underscore with ``shortest`` characters or more."""
    return F.filter(F.split(F.lower(text_of(c)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= shortest)


def stems(c: Column, shortest: int = 5, length: int = 7) -> Column:
    """Distinct word beginnings."""
    parts = F.filter(F.split(F.lower(fold_accents(text_of(c))), "[^a-z0-9]+"), lambda w: F.length(w) >= shortest)
    return F.array_distinct(F.transform(parts, lambda w: F.substring(w, 1, length)))


def match_tokens(c: Column, shortest: int = 3) -> Column:
    return F.filter(F.split(F.lower(fold_accents(text_of(c))), "[^a-z0-9]+"), lambda w: F.length(w) >= shortest)


def keyword_list(c: Column) -> Column:
    """Keywords of a setting: split at , ; and line ends, trimmed, lower case, distinct in order."""
    parts = F.transform(F.split(text_of(c), r"[,;\n\r]"), lambda w: F.lower(strip(w)))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def content_keywords(c: Column) -> Column:
    """Keywords of content checks: three characters or more, case kept, repeats kept."""
    return F.filter(F.transform(F.split(text_of(c), r"[,;\n\r]"), strip), lambda w: F.length(w) >= 3)


def share_contained(tokens: Column, text: Column) -> Column:
    """Share of the tokens that the text contains; 0 without tokens."""
    hits = F.filter(tokens, lambda t: F.contains(text, t))
    return F.when(F.size(tokens) > 0, F.size(hits) / F.size(tokens)).otherwise(F.lit(0.0))


def lexical_affinity(description: Column, text: Column) -> Column:
    """Share of a description's distinct words of four letters or more that occur in the text."""
    return share_contained(F.array_distinct(match_tokens(description, 4)), F.lower(fold_accents(text_of(text))))


def point_id(*parts: Column) -> Column:
    """A stable UUID-shaped id (version 5 marks) from the SHA-1 of the parts."""
    h = F.sha1(F.concat_ws("|", *[text_of(p) for p in parts]))
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", piece(1, 8), piece(9, 4), F.concat(F.lit("5"), piece(14, 3)), F.concat(F.lit("8"), piece(18, 3)), piece(21, 12))


def placeholders(c: Column) -> Column:
    """Distinct {{names}} in order."""
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(r"\{\{\s*([^{}\s]+)\s*\}\}"), 1))


def next_identifier(c: Column) -> Column:
    """The last block of digits plus one, its width kept; a text without digits stays.  Up to 37 digits."""
    s = text_of(c)
    digits = F.regexp_extract(s, r"^(.*?)(\d+)(\D*)$", 2)
    more = (F.expr("CAST(0 AS DECIMAL(38,0))") + F.try_to_number(digits, F.lit("9" * 37)).cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string")
    padded = F.when(F.length(more) < F.length(digits), F.lpad(more, F.length(digits), F.lit("0"))).otherwise(more)
    return F.when(digits == "", s).otherwise(F.concat(F.regexp_extract(s, r"^(.*?)(\d+)(\D*)$", 1), padded, F.regexp_extract(s, r"^(.*?)(\d+)(\D*)$", 3)))


def advance_if_accepted(current: Column, accepted: Column) -> Column:
    cur = text_of(current)
    return F.when((cur != "") & (text_of(accepted) == cur), next_identifier(cur)).otherwise(cur)


def column_number(letters: Column) -> Column:
    """A spreadsheet column's number: A is 1, AA 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("long"), lambda n, ch: F.when(ch == "", n).otherwise(n * 26 + F.ascii(ch) - 64))


def column_letters(number: Column, longest: int = 3) -> Column:
    """The inverse of ``column_number`` for up to ``longest`` letters."""
    out, rest = F.lit(""), number.cast("long")
    for _ in range(longest):
        digit = F.pmod(rest - 1, F.lit(26))
        out = F.when(rest > 0, F.concat(F.char(digit + 65), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return out


def cell_reference(c: Column) -> Column:
    """(column, row) of a reference such as AB12."""
    return F.struct(F.regexp_extract(c, "^([A-Za-z]+)", 1).alias("column"), F.try_to_number(F.regexp_extract(c, "([0-9]+)$", 1), F.lit("9999999")).cast("int").alias("row"))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_xml(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_name(c: Column, longest: int = 80) -> Column:
    """A file name of letters, digits, dot, dash and underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(fold_accents(text_of(c)), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, longest)


def coerce_option(c: Column, options: Sequence[str]) -> Column:
    """The value, or the option that equals it once its lost leading zeros are put back."""
    v = strip(text_of(c))
    out = v
    for o in reversed(options):
        out = F.when(F.lpad(v, len(o), "0") == o, F.lit(o)).otherwise(out) if o.isdigit() else out
    return F.when(v.isin(*options) | (v == ""), v).otherwise(out) if options else v


def fixed_chunks(c: Column, size: int = 800, overlap: int = 100) -> Column:
    """Windows of a squeezed text: array of (start, text), each ``size`` long, ``overlap`` shared with the next."""
    step = size - overlap

    def cut(s: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.length(s) - overlap) / F.lit(float(step))).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.substr(s, i * step + 1, F.lit(size)).alias("text")))
        return F.when(F.length(s) == 0, F.array().cast("array<struct<start:int,text:string>>")).otherwise(windows)

    return bound(squeeze(text_of(c)), cut)


def document_year(name: Column, text: Column) -> Column:
    """A year in the name, else that of the text's first full date; null if neither."""
    in_name = F.regexp_extract(text_of(name), r"(?<!\d)(20\d{2})(?!\d)", 1)
    in_text = F.regexp_extract(text_of(text), r"(?<!\d)\d{1,2}[/.-]\d{1,2}[/.-](20\d{2})(?!\d)", 1)
    return F.when(in_name != "", in_name).when(in_text != "", in_text).cast("int")


def lines(c: Column) -> Column:
    return F.split(text_of(c), r"\r?\n")


def page_number(text: Column, value: Column) -> Column:
    """The page (from 1, form feeds between pages) of a value's first occurrence; null if it doesn't occur."""
    at = F.position(value, text)
    return F.when(at > 0, F.size(F.split(F.left(text, at - 1), "\f")))
