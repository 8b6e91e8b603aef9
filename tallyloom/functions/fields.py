"""What kind of value a field holds, told from its label and description by rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rule, lookup
from .text import WORD_END, WORD_START, fold_accents, match_tokens, squeeze, text_of

#: Vocabulary of the categories that a label can name, as regular expressions on lower case.
CATEGORIES = {
    "massimale": (WORD_START + "massimal",), "scoperto": (WORD_START + "scopert",), "franchigia": (WORD_START + "franchig",), "premio": (WORD_START + "premi",),
    "imposta": (WORD_START + "impost",), "tasso": (WORD_START + "tasso" + WORD_END, "%", r"per\s+cent"), "parametro": (WORD_START + "parametro" + WORD_END, "regolazion"), "preventivo": (WORD_START + "preventiv",),
}
#: Vocabularies of structural and of periodic economic fields.
STRUCTURAL = "massimal|franchig|scopert|attivit|prodott|qualific|garanz"
ECONOMIC = "premio|tasso|imposta|importo|parametro|preventiv"
PREMIUM = rf"premio[_\s-]?(?:totale|imponibile|lordo|annuo)|{WORD_START}(?:imposta|imposte|tasse){WORD_END}"
#: Names of documents about another coverage, and of periodic documents.
OTHER_COVERAGE = r"infortun|tutela[-\s_]*legale|certificat"
PERIODIC = r"(?:^|[\s_\-.,;:()])(?:quietanza|quiestina|regolazion(?:e|i)?)(?![\p{L}\p{N}])"
#: The value that a declared type, or else a label, asks for.
KINDS = (
    Rule(r"iva|codice\s+fiscale|fiscale|c\.\s?f\.", "fiscal", True), Rule(r"(?:^|[^a-z])data(?:$|[^a-z])|decorrenza|scadenza|nascita", "date", True),
    Rule(r"tasso|aliquota|percentual|%", "percent", True), Rule(r"massimal|franchig|scopert|premio|impost|importo|fatturat|preventiv", "number", True),
    Rule(r"^(?:si|sì|yes)\s*/\s*no|presen(?:te|za)\?", "boolean", True),
)


def blob(label: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", text_of(label), text_of(description)))


def is_structural(label: Column, description: Column) -> Column:
    return blob(label, description).rlike(STRUCTURAL)


def is_periodic_economic(label: Column, description: Column) -> Column:
    return ~is_structural(label, description) & blob(label, description).rlike(ECONOMIC)


def field_group(label: Column, description: Column) -> Column:
    """structural, economic or other."""
    return F.when(is_structural(label, description), "structural").when(is_periodic_economic(label, description), "economic").otherwise("other")


def is_premium(label: Column, description: Column) -> Column:
    return blob(label, description).rlike(PREMIUM)


def is_other_coverage(name: Column) -> Column:
    return F.lower(fold_accents(text_of(name))).rlike(OTHER_COVERAGE)


def premium_from_other_coverage(label: Column, description: Column, name: Column) -> Column:
    return is_premium(label, description) & is_other_coverage(name)


def is_periodic_document(name: Column) -> Column:
    """Receipts and adjustments by a whole word; a policy never is one."""
    n = F.lower(text_of(name))
    return ~n.rlike(WORD_START + "polizz") & n.rlike(PERIODIC)


def field_kind(declared: Column, label: Column) -> Column:
    """The declared type, else what the label asks for, else text."""
    d = F.lower(text_of(declared))
    known = F.when(d.isin("number", "importo", "amount"), "number").when(d.isin("date", "data"), "date").when(d.isin("percent", "percentuale"), "percent").when(d.isin("fiscal", "boolean", "enum"), d)
    return F.coalesce(known, lookup(F.lower(fold_accents(text_of(label))), KINDS, "text"))


def without_examples(description: Column) -> Column:
    """A description without its example clauses only."""
    d = F.regexp_replace(text_of(description), r"(?i)\s*\(\s*es\.[^)]*\)", "")
    d = F.regexp_replace(d, "(?i)[,;:]?\\s*(?<![A-Za-z0-9_])es\\.\\s*['\"«][^'\"»\\n]*['\"»]", "")
    d = F.regexp_replace(d, r"(?i)[,;:]?\s*(?<![A-Za-z0-9_])es\.\s[^\n]*?(?=[.;](?:\s|$)|$)", "")
    return squeeze(d)


def coverage_terms(label: Column, description: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct two- and three-word terms of a field's words of four letters or more."""
    words = F.filter(match_tokens(F.concat_ws(" ", label, description), 4), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    grams = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(grams(2), grams(3)))
