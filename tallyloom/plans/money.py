"""Amounts: gross rows, totals, rollups and checks, over line items whose part type sets the rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, formula, identifiers, text
from ..functions.rules import Rule
from ..operators import premium, records
from ..sources.tables import table

RULES = premium.PremiumRules(
    movement="r",
    rates=(Rule("^economy", 0.265, True), Rule("^small", 0.10, True), Rule("^medium", 0.125, True), Rule("^promo", 0.025, True), Rule("^standard", 0.135, True)),
    default_rate=0.135,
)
_RATE = "CASE WHEN lower(p_type) LIKE 'economy%' THEN 0.265 WHEN lower(p_type) LIKE 'small%' THEN 0.100 WHEN lower(p_type) LIKE 'medium%' THEN 0.125 WHEN lower(p_type) LIKE 'promo%' THEN 0.025 ELSE 0.135 END"
_KNOWN = "regexp_matches(lower(p_type), '^(economy|small|medium|promo|standard)')"
_BASE = f"""WITH b AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS row_id, l_orderkey, l_returnflag, p_type, CAST({_RATE} AS DECIMAL(6,3)) AS rate, {_KNOWN} AS known,
         CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice::DECIMAL(28,8), 2) AS DECIMAL(18,2)) END AS net
  FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT *, CAST(round(net * (1.000 + rate), 2) AS DECIMAL(18,2)) AS gross, CAST(round_even(net * (1.000 + rate), 2) AS DECIMAL(18,2)) AS even FROM b)
"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("row_id"), F.col("l_orderkey").cast("string").alias("policy_no"), F.col("l_returnflag").alias("movement"), F.col("p_type").alias("guarantee"), F.col("l_extendedprice").cast("decimal(18,4)").cast("string").alias("net_premium"))


def _doubles(*names: str) -> list:
    """Exact decimals leave a query as doubles, which every client reads alike."""
    return [F.col(c).cast("double").alias(c) for c in names]


def gross_amount_rows(spark, d):
    return premium.gross_rows(lines(spark, d), RULES).filter("counted").select("row_id", *_doubles("rate", "net", "gross"))


def premium_gross(spark, d):
    return premium.compute(lines(spark, d), RULES).filter("counted").select("row_id", "policy_no", *_doubles("net", "gross", "total"))


def rounding_tie_report(spark, d):
    return premium.tie_breaks(premium.gross_rows(lines(spark, d), RULES), RULES).select("row_id", *_doubles("gross", "other"))


def policy_totals(spark, d):
    return premium.policy_totals(premium.compute(lines(spark, d), RULES)).select("policy", "rows", "last_row", *_doubles("total"))


def rollup_by_label(spark, d):
    return premium.label_counts(lines(spark, d), "guarantee")


def unknown_label_report(spark, d):
    return premium.unknown_labels(premium.compute(lines(spark, d), RULES))


def integrity_checks(spark, d):
    return premium.integrity(premium.compute(lines(spark, d), RULES))


def integrity_of_spoilt_rows(spark, d):
    """The four checks on a report with missing amounts and wrong totals."""
    computed = premium.compute(lines(spark, d), RULES)
    spoilt = computed.withColumn("gross", F.when(F.col("row_id") % 97 > 0, F.col("gross"))).withColumn("total", F.when(F.col("row_id") % 5 == 0, F.col("total") + 1).when(F.col("row_id") % 31 > 0, F.col("total")))
    return premium.integrity(spoilt)


def grand_total(spark, d):
    return premium.grand_total(premium.compute(lines(spark, d), RULES)).select(*_doubles("grand_total"))


def formula_price(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return parts.select("p_partkey", F.round(formula.compile_formula("max(price, 15) * 1,05 + size % 7", {"price": F.col("p_retailprice").cast("string"), "size": F.col("p_size").cast("string")}), 6).alias("price"))


def checksum_valid(spark, d):
    keys = table(spark, d, "customer").select("c_custkey")
    code = F.lpad((F.col("c_custkey") * 7919 + 12345678901).cast("string"), 11, "0")
    return keys.select("c_custkey", code.alias("code"), identifiers.valid_vat(code).alias("valid"))


def expiry_bucket(spark, d):
    now = F.lit("1997-06-15").cast("date")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return orders.select("o_orderkey", dates.expiry_bucket(F.col("o_orderdate").cast("date"), now).alias("bucket")).filter("bucket IS NOT NULL")


def expiry_groups(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("end"))
    return records.by_expiry(orders, "end", F.lit("1997-06-15").cast("date"))


def renew_dates(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("end"))
    return orders.select("o_orderkey", dates.add_years(F.col("end"), 1).alias("renewed"), dates.first_of_month(F.col("end")).alias("month"), dates.track_text(F.col("end"), 1).alias("next_day"))


def next_identifier(spark, d):
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    return names.select("c_custkey", text.next_identifier(F.col("c_name")).alias("next"))


def parse_amounts(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    shown = amounts.format_italian(F.col("p_retailprice").cast("decimal(18,2)"))
    return parts.select("p_partkey", shown.alias("shown"), F.round(amounts.parse_amount(F.concat(F.lit("€ "), shown)), 2).alias("amount"), F.round(amounts.parse_grouped(shown), 2).alias("grouped"), F.round(amounts.parse_pure(shown), 2).alias("pure"))


def record_errors(spark, d):
    rules = [
        records.FieldRule("c_name", "name", required=True, max_length=17),
        records.FieldRule("c_acctbal", "balance", type="number", required=True),
        records.FieldRule("c_mktsegment", "segment", type="select", options=("BUILDING", "MACHINERY", "AUTOMOBILE")),
    ]
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("c_acctbal"), "c_mktsegment")
    return rows.select("c_custkey", F.array_join(F.transform(records.errors(rules), lambda e: F.concat_ws(":", e["field"], e["error"])), ";").alias("errors")).filter("errors <> ''")


QUERIES = {f.__name__: f for f in (gross_amount_rows, premium_gross, rounding_tie_report, policy_totals, rollup_by_label, unknown_label_report, integrity_checks, integrity_of_spoilt_rows, grand_total, formula_price, checksum_valid, expiry_bucket, expiry_groups, renew_dates, next_identifier, parse_amounts, record_errors)}
_TOTAL = "max(CASE WHEN gross IS NOT NULL THEN row_id END) OVER (PARTITION BY l_orderkey)"
ORACLES = {
    "gross_amount_rows": _BASE + "SELECT row_id, rate::DOUBLE AS rate, net::DOUBLE AS net, gross::DOUBLE AS gross FROM g WHERE l_returnflag = 'R'",
    "premium_gross": _BASE + f"SELECT row_id, l_orderkey::VARCHAR AS policy_no, net::DOUBLE AS net, gross::DOUBLE AS gross, CASE WHEN row_id = {_TOTAL} THEN sum(gross) OVER (PARTITION BY l_orderkey) END::DOUBLE AS total FROM g WHERE l_returnflag = 'R'",
    "rounding_tie_report": _BASE + "SELECT row_id, gross::DOUBLE AS gross, even::DOUBLE AS other FROM g WHERE gross <> even",
    "policy_totals": _BASE + "SELECT l_orderkey::VARCHAR AS policy, count(*) AS rows, max(row_id) AS last_row, sum(gross)::DOUBLE AS total FROM g WHERE gross IS NOT NULL GROUP BY l_orderkey",
    "rollup_by_label": "SELECT p_type AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "unknown_label_report": _BASE + "SELECT p_type AS label, count(*) AS n, list_sort(list(row_id))[1:8] AS examples FROM g WHERE l_returnflag = 'R' AND NOT known GROUP BY 1",
    "integrity_checks": "SELECT unnest(['gross_where_due', 'one_total', 'total_on_last_row', 'total_is_sum']) AS name, true AS ok, 0::BIGINT AS failures",
    "integrity_of_spoilt_rows": _BASE + f""", t AS (SELECT *, CASE WHEN row_id = {_TOTAL} THEN sum(gross) OVER (PARTITION BY l_orderkey) END AS total FROM g),
      s AS (SELECT row_id, l_orderkey, net, CASE WHEN row_id % 97 > 0 THEN gross END AS gross, CASE WHEN row_id % 5 = 0 THEN total + 1 WHEN row_id % 31 > 0 THEN total END AS total FROM t),
      k AS (SELECT count(*) FILTER ((net IS NOT NULL) <> (gross IS NOT NULL)) AS a, count(total) <> (count(gross) > 0)::INT AS b, max(row_id) FILTER (total IS NOT NULL) IS DISTINCT FROM max(row_id) FILTER (gross IS NOT NULL) AS c, sum(gross) IS DISTINCT FROM max(total) AS d FROM s GROUP BY l_orderkey),
      n AS (SELECT sum(a)::BIGINT AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c, count(*) FILTER (d) AS d FROM k)
      SELECT unnest(['gross_where_due', 'one_total', 'total_on_last_row', 'total_is_sum']) AS name, unnest([a, b, c, d]) AS failures, unnest([a, b, c, d]) = 0 AS ok FROM n""",
    "grand_total": _BASE + "SELECT sum(gross)::DOUBLE AS grand_total FROM g",
    "formula_price": "SELECT p_partkey, round(greatest(p_retailprice, 15.0) * 1.05::DOUBLE + p_size % 7, 6)::DOUBLE AS price FROM part",
    "checksum_valid": """WITH c AS (SELECT c_custkey, lpad((c_custkey * 7919 + 12345678901)::VARCHAR, 11, '0') AS code FROM customer),
      s AS (SELECT *, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN code[i]::INT WHEN code[i]::INT > 4 THEN code[i]::INT * 2 - 9 ELSE code[i]::INT * 2 END)) AS t FROM c)
      SELECT c_custkey, code, (10 - t % 10) % 10 = code[11]::INT AND len(list_distinct(string_split(code[1:10], ''))) > 1 AS valid FROM s""",
    "expiry_bucket": "WITH m AS (SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate)) - (1997 * 12 + 6) AS k FROM orders) SELECT o_orderkey, CASE k WHEN -1 THEN 'past' WHEN 0 THEN 'current' ELSE 'next' END AS bucket FROM m WHERE k BETWEEN -1 AND 1",
    "expiry_groups": """WITH m AS (SELECT o_orderkey, o_orderdate::DATE AS d, (year(o_orderdate) * 12 + month(o_orderdate)) - (1997 * 12 + 6) AS k FROM orders)
      SELECT CASE k WHEN -1 THEN 'past' WHEN 0 THEN 'current' ELSE 'next' END AS bucket, row_number() OVER (PARTITION BY k ORDER BY d, o_orderkey) AS place, o_orderkey AS id FROM m WHERE k BETWEEN -1 AND 1""",
    "renew_dates": "SELECT o_orderkey, strftime((o_orderdate::DATE + INTERVAL 1 YEAR)::DATE, '%d/%m/%Y') AS renewed, strftime(date_trunc('month', o_orderdate)::DATE, '%d/%m/%Y') AS month, strftime((o_orderdate::DATE + INTERVAL 1 DAY)::DATE, '%d/%m/%Y') AS next_day FROM orders",
    "next_identifier": r"SELECT c_custkey, regexp_extract(c_name, '^(.*?)(\d+)$', 1) || lpad((regexp_extract(c_name, '(\d+)$', 1)::HUGEINT + 1)::VARCHAR, greatest(len(regexp_extract(c_name, '(\d+)$', 1)), len((regexp_extract(c_name, '(\d+)$', 1)::HUGEINT + 1)::VARCHAR))::INT, '0') AS next FROM customer",
    "parse_amounts": "SELECT p_partkey, translate(format('{:,.2f}', p_retailprice::DECIMAL(18,2)::DOUBLE), ',.', '.,') AS shown, p_retailprice::DECIMAL(18,2)::DOUBLE AS amount, p_retailprice::DECIMAL(18,2)::DOUBLE AS grouped, p_retailprice::DECIMAL(18,2)::DOUBLE AS pure FROM part",
    "record_errors": """SELECT * FROM (SELECT c_custkey, concat_ws(';', CASE WHEN trim(c_name) = '' THEN 'c_name:required' WHEN len(c_name) > 17 THEN 'c_name:too long' END,
      CASE WHEN c_acctbal < 0 OR c_acctbal IS NULL THEN 'c_acctbal:required' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'c_mktsegment:not an option' END) AS errors FROM customer) WHERE errors <> ''""",
}
