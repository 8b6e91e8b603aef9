"""Gross amounts from net ones: rates by label, exact rounding, group totals and the checks around them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import MONEY, RATE, apply_rate, parse_amount, to_money
from ..functions.rules import Rule, is_known, lookup
from ..functions.text import normalise_label, text_of


@dataclass(frozen=True)
class PremiumRules:
    """Which movements count, the rates by normalised label, and the rate of labels without a rule."""

    movement: str
    rates: tuple[Rule, ...]
    default_rate: float
    rounding: str = "half_up"


#: The rates of the usual report, in the order in which they are tried.
USUAL_RULES = PremiumRules(
    movement="inclusione applicazione",
    rates=(
        Rule("rca", 0.265), Rule("assistenza in viaggio", 0.10), Rule("tutela legale base", 0.125), Rule("^infortun", 0.025, True),
        Rule("cristalli", 0.135), Rule("furto totale o parziale", 0.135), Rule("incendio", 0.135), Rule("calamita naturali", 0.135),
        Rule("guasti integrale", 0.135), Rule("atti vandalici ed eventi sociopolitici", 0.135), Rule("assistenza in viaggio ibrido elettrico", 0.135),
        Rule("^a4t garanzie aggiuntive(?![A-Za-z0-9_])", 0.135, True), Rule("^garanzie accessorie formula (uno|due)(?![A-Za-z0-9_])", 0.135, True),
    ),
    default_rate=0.135,
)


def gross_rows(rows: DataFrame, rules: PremiumRules) -> DataFrame:
    """Adds counted, rate, known, net, gross and tie to rows (row_id, policy_no, movement, guarantee, net_premium).

    Rows of other movements and unreadable amounts have no gross; ``tie`` marks amounts that the other rounding changes.
    """
    label = normalise_label(F.col("guarantee"))
    other = "half_even" if rules.rounding == "half_up" else "half_up"
    counted = normalise_label(F.col("movement")) == normalise_label(F.lit(rules.movement))
    out = rows.withColumn("counted", counted).withColumn("rate", lookup(label, rules.rates, rules.default_rate).cast(RATE)).withColumn("known", is_known(label, rules.rates))
    out = out.withColumn("net", F.when(F.col("counted"), to_money(parse_amount(F.col("net_premium")))))
    out = out.withColumn("gross", apply_rate(F.col("net"), F.col("rate"), rules.rounding))
    return out.withColumn("tie", F.col("gross") != apply_rate(F.col("net"), F.col("rate"), other))


def with_totals(gross: DataFrame, group: str = "policy_no", order: str = "row_id", amount: str = "gross", total: str = "total") -> DataFrame:
    """The sum of a group's rounded amounts on its last calculable row, null elsewhere.

    One shuffle: sum and last row come from the same window partition.
    """
    key = F.trim(text_of(F.col(group)))
    whole = Window.partitionBy(key)
    last = F.max(F.when(F.col(amount).isNotNull(), F.col(order))).over(whole)
    return gross.withColumn(total, F.when(F.col(order) == last, F.sum(amount).over(whole).cast(MONEY)))


def compute(rows: DataFrame, rules: PremiumRules = USUAL_RULES) -> DataFrame:
    """The two report columns ``gross`` and ``total`` with what led to them."""
    return with_totals(gross_rows(rows, rules))


def policy_totals(computed: DataFrame) -> DataFrame:
    """(policy, rows, last_row, total) of every group."""
    return computed.filter("gross IS NOT NULL").groupBy(F.trim(text_of(F.col("policy_no"))).alias("policy")).agg(F.count("*").alias("rows"), F.max("row_id").alias("last_row"), F.sum("gross").cast(MONEY).alias("total"))


def unknown_labels(computed: DataFrame, examples: int = 8) -> DataFrame:
    """Labels without a rule: how many counted rows, and the first rows as examples."""
    label = F.trim(text_of(F.col("guarantee")))
    unknown = computed.filter("counted AND NOT known").select(F.when(label == "", "(empty)").otherwise(label).alias("label"), "row_id")
    ranked = unknown.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("row_id")))
    return ranked.groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("row_id")))).alias("examples"))


def missing_amounts(computed: DataFrame) -> DataFrame:
    return computed.filter("counted AND net IS NULL").select("row_id", F.col("net_premium").alias("raw"))


def tie_breaks(computed: DataFrame, rules: PremiumRules = USUAL_RULES) -> DataFrame:
    """Rows on a half cent, with the amount that the other rounding would give."""
    other = apply_rate(F.col("net"), F.col("rate"), "half_even" if rules.rounding == "half_up" else "half_up")
    # a filter on ``tie`` would be pushed below the amounts and parse them a second time; a generator is not
    return computed.select("row_id", "guarantee", "net_premium", "gross", F.explode(F.when(F.col("tie"), F.array(other))).alias("other"))


def label_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def grand_total(computed: DataFrame) -> DataFrame:
    return computed.agg(F.sum("total").cast("decimal(28,2)").alias("grand_total"))


def integrity(computed: DataFrame) -> DataFrame:
    """Four checks as rows (name, ok, failures), in one pass by group:

    counted rows with an amount have a gross and others none; a total stands on one row of each group only; on its last
    calculable row; and equals the sum of the group's amounts.
    """
    key = F.trim(text_of(F.col("policy_no")))
    groups = computed.groupBy(key.alias("g")).agg(
        F.count_if((F.col("counted") & F.col("net").isNotNull()) != F.col("gross").isNotNull()).alias("filled"),
        F.count("total").alias("totals"), F.count("gross").alias("n"), F.max(F.when(F.col("gross").isNotNull(), F.col("row_id"))).alias("last"),
        F.max(F.when(F.col("total").isNotNull(), F.col("row_id"))).alias("at"), F.sum("gross").alias("sum"), F.max("total").alias("total"),
    )
    bad = groups.agg(
        F.coalesce(F.sum("filled"), F.lit(0)).alias("gross_where_due"), F.count_if(F.col("totals") != (F.col("n") > 0).cast("long")).alias("one_total"),
        F.count_if(~F.col("at").eqNullSafe(F.col("last"))).alias("total_on_last_row"), F.count_if(~F.col("sum").eqNullSafe(F.col("total"))).alias("total_is_sum"),
    )
    return bad.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("failures")) for c in bad.columns])).alias("x")).select("x.name", (F.col("x.failures") == 0).alias("ok"), "x.failures")


class IntegrityError(ValueError):
    """The report's own checks failed, or labels need a decision first."""


def process(rows: DataFrame, rules: PremiumRules = USUAL_RULES, allow_unknown: bool = False) -> DataFrame:
    """``compute``, blocked by labels without a rule unless allowed, and by failed checks."""
    out = compute(rows, rules)
    if not allow_unknown and (first := unknown_labels(out).limit(8).collect()):
        raise IntegrityError(f"labels without a rate: {[r['label'] for r in first]}")
    if failed := integrity(out).filter("NOT ok").collect():
        raise IntegrityError(f"failed checks: {[r['name'] for r in failed]}")
    return out


def by_rules(c: Column, rules: Sequence[Rule], default: float) -> Column:
    return lookup(normalise_label(c), rules, default).cast(RATE)
