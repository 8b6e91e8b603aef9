"""Which of several candidate values wins: ordered folds that stay in the JVM, and guards over the winners.

The rules are not commutative, so candidates are folded in their order with ``aggregate`` over a sorted array instead
of being reduced to a maximum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import loose_amount, parse_pure
from ..functions.dates import newer_wins, normalise_date, text_day
from ..functions.identifiers import is_placeholder

CANDIDATE = ("value", "eff_date", "affinity", "lex", "appendix_ord", "doc_pos", "file", "page")
PROMOTE, VETO, COLLAPSE = 0.15, 0.10, 0.2
#: Changes of an amount beyond these factors decide by themselves in a rolling state.
FAR_DOWN, FAR_UP = 0.05, 20.0


def more_recent(old: Column, new: Column) -> Column:
    """True if the new candidate wins: by date, else lexical score, else appendix number, else place among documents."""
    a, b = text_day(old["eff_date"]), text_day(new["eff_date"])
    both = old["lex"].isNotNull() & new["lex"].isNotNull() & (old["lex"] != new["lex"])
    by_appendix = F.coalesce(new["appendix_ord"], F.lit(-1)) > F.coalesce(old["appendix_ord"], F.lit(-1))
    late = F.lit(2**31 - 1)
    return (
        F.when(~a.eqNullSafe(b), newer_wins(old["eff_date"], new["eff_date"]))
        .when(both, new["lex"] > old["lex"])
        .when(~old["appendix_ord"].eqNullSafe(new["appendix_ord"]), by_appendix)
        .otherwise(F.coalesce(new["doc_pos"], late) < F.coalesce(old["doc_pos"], late))
    )


def semantic(old: Column, new: Column, promote: float = PROMOTE, veto: float = VETO) -> Column:
    """True if the new candidate wins: a fall of an amount by over 80 % needs far more affinity; a clear difference of
    affinity decides; else the more recent one."""
    was, now = loose_amount(old["value"]), loose_amount(new["value"])
    gain = new["affinity"] - old["affinity"]
    falls = F.coalesce((was > 0) & (now < was * COLLAPSE), F.lit(False))
    clear = F.coalesce(gain > promote, F.lit(False))
    return F.when(falls & ~clear, F.lit(False)).when(clear, F.lit(True)).when(F.coalesce(-gain > veto, F.lit(False)), F.lit(False)).otherwise(more_recent(old, new))


def fold(candidates: DataFrame, keys: Sequence[str], wins: Callable[[Column, Column], Column], order: str = "seq", columns: Sequence[str] = CANDIDATE) -> DataFrame:
    """One row per key: the candidate left after folding them in ``order``; placeholders never take part.

    A key's candidates are collected: they are the proposals for one field of one entity.
    """
    rows = candidates.filter(~is_placeholder(F.col("value")))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("c"))
    kept = F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.get("c", F.lit(0)), lambda old, new: F.when(wins(old, new), new).otherwise(old))
    return listed.select(*keys, kept.alias("w")).select(*keys, *[F.col(f"w.{c}").alias(c) for c in (order, *columns)])


def recency_order(ts: str = "ts", appendix: str = "appendix_ord", position: str = "doc_pos") -> list[Column]:
    """Newest first, undated last; later appendix first; original place."""
    return [F.desc_nulls_last(ts), F.desc_nulls_last(appendix), F.asc(position)]


def rolling_wins(old: Column, new: Column, is_date: Column) -> Column:
    """Rolling rule: amounts 20 times larger win, twentieths lose, else a dated value yields to no older or undated one."""
    a, b = parse_pure(old["value"]), parse_pure(new["value"])
    amounts = F.coalesce(~is_date & (a > 0) & (b > 0), F.lit(False))
    return F.when(amounts & (b <= a * FAR_DOWN), F.lit(False)).when(amounts & (b >= a * FAR_UP), F.lit(True)).otherwise(newer_wins(old["eff_date"], new["eff_date"]))


def rolling_state(updates: DataFrame, keys: Sequence[str], order: str = "seq", is_date: Column | None = None) -> DataFrame:
    """The state after all updates (value, valid_on, doc_date, source) in order; empty values change nothing."""
    dated = F.lit(False) if is_date is None else is_date
    valid = normalise_date(F.coalesce("valid_on", F.lit("")))
    rows = updates.filter("trim(coalesce(value, '')) <> ''").select(*keys, order, "value", F.coalesce(valid, F.when(dated, F.col("value")), F.col("doc_date")).alias("eff_date"), "source", dated.alias("_d"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "value", "eff_date", "source", "_d"))).alias("c"))

    def step(old: Column, new: Column) -> Column:
        merged = F.struct(new[order].alias(order), new["value"].alias("value"), new["eff_date"].alias("eff_date"), F.coalesce(new["source"], old["source"]).alias("source"), new["_d"].alias("_d"))
        return F.when(rolling_wins(old, new, new["_d"]), merged).otherwise(old)

    kept = F.aggregate(F.slice("c", F.lit(2), F.size("c")), F.get("c", F.lit(0)), step)
    return listed.select(*keys, kept.alias("w")).select(*keys, "w.value", "w.eff_date", "w.source", F.col(f"w.{order}").alias(order))


def best_hint(hints: DataFrame, kinds: Sequence[str] = ("entity_id", "kind"), least: float = 0.5) -> DataFrame:
    """The best hint of each kind: confident enough, then pattern priority, confidence, date, place, page and line."""
    ranked = hints.filter(F.col("confidence") >= least).withColumn("_ts", text_day(F.col("eff_date")))
    order = [F.asc("priority"), F.desc("confidence"), F.desc_nulls_last("_ts"), F.asc("doc_pos"), F.asc("page"), F.asc("line")]
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*kinds).orderBy(*order))).filter("_r = 1").drop("_r", "_ts")


def spill_guard(values: DataFrame, family: Column, least: float = 100_000.0) -> DataFrame:
    """Adds ``cleared``: a family of 4 or more fields of which 3 or more have one and the same large amount has read one
    figure into all of them."""
    amount = F.when(family, parse_pure(F.col("value")))
    w = Window.partitionBy("entity_id")
    stats = values.withColumn("_a", amount).withColumn("_f", F.count_if(family).over(w)).withColumn("_n", F.count("_a").over(w)).withColumn("_lo", F.min("_a").over(w)).withColumn("_hi", F.max("_a").over(w))
    bad = family & (F.col("_f") >= 4) & (F.col("_n") >= 3) & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") >= least) & F.col("_a").isNotNull()
    return stats.withColumn("cleared", F.coalesce(bad, F.lit(False))).drop("_a", "_f", "_n", "_lo", "_hi")


def merge_guard(values: DataFrame, nature: str = "nature", keep: Sequence[str] = ("annual", "claim"), least: float = 50.0) -> DataFrame:
    """Adds ``cleared`` after merging: amounts of 50 or less go; one amount on 3 or more fields of 2 or more natures
    stays only on the two natures that may share it."""
    cents = F.round(parse_pure(F.col("value")) * 100).cast("long")
    w = Window.partitionBy("entity_id", "_c")
    stats = values.withColumn("_c", cents).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.size(F.collect_set(nature).over(w)))
    small = F.col("_c") <= int(least * 100)
    shared = (F.col("_n") >= 3) & (F.col("_k") >= 2) & ~F.col(nature).isin(*keep)
    return stats.withColumn("cleared", F.coalesce(F.col("_c").isNotNull() & (small | shared), F.lit(False))).drop("_c", "_n", "_k")


def class_guard(values: DataFrame, weak: Column, strong: Column) -> DataFrame:
    """Rows without those of the weak class whose amount the same entity also has in the strong class."""
    rows = values.withColumn("_c", F.round(parse_pure(F.col("value")) * 100).cast("long")).withColumn("_weak", weak)
    firm = rows.filter(strong & F.col("_c").isNotNull()).select("entity_id", "_c").distinct().withColumn("_weak", F.lit(True))
    return rows.join(firm, ["entity_id", "_c", "_weak"], "left_anti").select(*values.columns)


def cross_field(wide: DataFrame) -> DataFrame:
    """Adds ``violations`` to rows (start, end, annual, claim, sub_limit, base, tax, total): an array of names.

    ``total_note`` is a note only: base and tax do not add up to the total.
    """
    a, b = text_day(F.col("start")), text_day(F.col("end"))
    n = {c: parse_pure(F.col(c)) for c in ("annual", "claim", "sub_limit", "base", "tax", "total")}
    checks = {
        "start_before_end": a >= b, "over_400_days": F.datediff(b, a) > 400, "annual_below_claim": n["annual"] < n["claim"],
        "sub_limit_over_annual": n["sub_limit"] > n["annual"], "total_note": F.abs(n["base"] + n["tax"] - n["total"]) > 0.01,
    }
    return wide.withColumn("violations", F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()])))


def consensus(deltas: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The most frequent value of each key, the first seen on a tie; and whether passes disagreed."""
    counts = deltas.groupBy(*keys, "value").agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("_first")).alias("f"), "value")).alias("m"), F.count("*").alias("_kinds"))
    return best.select(*keys, F.col("m.value").alias("value"), F.col("m.votes").alias("votes"), (F.col("_kinds") > 1).alias("disputed"))


def occurrences(values: DataFrame, texts: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``seen``: in how many documents of its entity each value occurs (texts: entity_id, doc_id, text)."""
    hits = values.join(texts, "entity_id").filter(F.contains(F.col("text"), F.col(value))).groupBy("entity_id", value).agg(F.count_distinct("doc_id").alias("seen"))
    return values.join(hits, ["entity_id", value], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
