"""Ordered rule tables: vocabularies are data, compiled to one expression or joined as a small table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A value for texts that equal a pattern, or match it as a regular expression; the first rule that fits counts."""

    pattern: str
    value: object
    is_regex: bool = False


def lookup(c: Column, rules: Sequence[Rule], default: object = None) -> Column:
    """The first fitting rule's value."""
    out = None
    for r in rules:
        test = c.rlike(r.pattern) if r.is_regex else c == r.pattern
        out = F.when(test, F.lit(r.value)) if out is None else out.when(test, F.lit(r.value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def is_known(c: Column, rules: Sequence[Rule]) -> Column:
    """True if a rule fits."""
    return lookup(c, [Rule(r.pattern, True, r.is_regex) for r in rules], False)


def categories(c: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Names of the categories one of whose (regular-expression) terms a text holds, in the vocabulary's order."""
    return F.array_compact(F.array(*[F.when(c.rlike("|".join(f"(?:{t})" for t in terms)), name) for name, terms in vocabulary.items()]))


def first_contained(text: Column, words: Sequence[str]) -> Column:
    """The first word of a list that a text contains, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), w) for w in words]) if words else F.lit(None).cast("string")


def label_of(code: Column, labels: Mapping[str, str]) -> Column:
    """A code's label, '' if it has none."""
    return lookup(code, [Rule(k, v) for k, v in labels.items()], "")
