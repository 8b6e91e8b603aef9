"""Declarative comparison: keys and conditions as data, compiled to Column predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TRANSFORMS, normalise_key

MODES = ("contains", "equals", "not_equals", "not_contains")


@dataclass(frozen=True)
class MatchKey:
    """One way for rows to match: a column of each side under a transform."""

    label: str
    column_a: str
    column_b: str
    transform: str = "default"
    enabled: bool = True


@dataclass(frozen=True)
class Condition:
    """One comparison between rows; ``connector`` joins it to the conditions before it."""

    column_a: str
    column_b: str
    mode: str = "contains"
    transform: str = "default"
    connector: str = "AND"


@dataclass(frozen=True)
class CompareConfig:
    """A saved comparison; unknown settings are ignored and missing ones get their defaults."""

    keys: tuple[MatchKey, ...] = ()
    match: tuple[Condition, ...] = ()
    filters: tuple[Condition, ...] = ()
    fuzzy: bool = False
    gram: int = 4
    broad_gram: int = 6
    ignore_words: str = ""
    max_per_row: int = 20
    extra: dict[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def from_dict(cls, saved: dict[str, Any]) -> CompareConfig:
        names = {f.name for f in fields(cls)} - {"extra"}
        known = {k: v for k, v in saved.items() if k in names and v is not None}
        for name, kind in (("keys", MatchKey), ("match", Condition), ("filters", Condition)):
            allowed = {f.name for f in fields(kind)}
            known[name] = tuple(kind(**{k: v for k, v in item.items() if k in allowed and v is not None}) for item in known.get(name, ()))
        return cls(**known, extra={k: v for k, v in saved.items() if k not in names})

    def to_dict(self) -> dict[str, Any]:
        out = asdict(self)
        out |= out.pop("extra")
        return out


def enabled_keys(keys: Sequence[MatchKey]) -> list[MatchKey]:
    """Keys in use: switched on, with a column on both sides and a known transform."""
    return [k for k in keys if k.enabled and k.column_a and k.column_b and k.transform in TRANSFORMS]


def compare_values(a: Column, b: Column, mode: str) -> Column:
    """False where either side is empty, also for the negative modes."""
    test = {
        "contains": lambda: F.contains(b, a),
        "equals": lambda: a == b,
        "not_equals": lambda: a != b,
        "not_contains": lambda: ~F.contains(b, a),
    }[mode]()
    return (a != "") & (b != "") & test


def search_values(a: Column, b: Column, mode: str) -> Column:
    """For searches only ``equals`` and ``contains`` exist; every other mode means contains (A's value inside B's)."""
    return (a != "") & (b != "") & ((a == b) if mode == "equals" else F.contains(b, a))


def fold(conditions: Sequence[Condition], test: Callable[[Condition], Column]) -> Column:
    """Conditions from left to right without precedence: A OR B AND C is (A OR B) AND C; none is false."""
    out: Column | None = None
    for c in conditions:
        now = test(c)
        out = now if out is None else (out | now) if c.connector.upper() == "OR" else (out & now)
    return F.lit(False) if out is None else out


def predicate(conditions: Sequence[Condition], a: Callable[[str], Column], b: Callable[[str], Column], compare: Callable[[Column, Column, str], Column] = compare_values) -> Column:
    return fold(conditions, lambda c: compare(normalise_key(a(c.column_a), c.transform), normalise_key(b(c.column_b), c.transform), c.mode))


def required_equalities(conditions: Sequence[Condition]) -> list[Condition]:
    """Equalities that every matching pair satisfies: those after the last OR, as the fold has no precedence."""
    last_or = max((i for i, c in enumerate(conditions) if i and c.connector.upper() == "OR"), default=0)
    return [c for i, c in enumerate(conditions) if c.mode == "equals" and (i > last_or or last_or == 0)]


def all_negative(conditions: Sequence[Condition]) -> bool:
    """A lint: match conditions that are all negative pair almost everything."""
    return bool(conditions) and all(c.mode.startswith("not_") for c in conditions)
