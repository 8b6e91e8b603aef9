"""Matching of records: customers of two overlapping lists, suppliers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..functions.conditions import Condition, MatchKey
from ..operators import evidence, jobs, matching, resolve, scoring, search
from ..sources.tables import table

KEYS = (MatchKey("code", "code", "code"), MatchKey("tail", "phone", "phone", "last6"), MatchKey("seg", "seg", "seg", "letters_only"))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A: all customers; B: all customers under changed codes, so that some match by the first key and some by another."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    a = c.select(F.col("c_custkey").alias("row_id"), F.concat(F.lit("00"), (F.col("c_custkey") * 3).cast("string")).alias("code"), F.concat(F.lit("tel "), F.lpad((F.col("c_custkey") * 17).cast("string"), 8, "0")).alias("phone"), F.lit("").alias("seg"))
    b = c.select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") * 2).cast("string")).otherwise("").alias("code"), F.concat(F.lit("+39."), F.lpad((F.col("c_custkey") * 17 * F.when(F.col("c_custkey") % 5 == 0, 2).otherwise(1)).cast("string"), 8, "0")).alias("phone"), F.lit("x").alias("seg"))
    return a, b


def waterfall_match(spark, d):
    return matching.waterfall_match(*sides(spark, d), KEYS)


def only_left(spark, d):
    return matching.only_left(*sides(spark, d), KEYS).select("row_id")


def only_right(spark, d):
    return matching.only_right(*sides(spark, d), KEYS).select("row_id")


def _codes(spark, d):
    code = lambda c, by: F.concat(F.lit("id-"), (F.col(c) * by % 1_000_003).cast("string"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), code("c_custkey", 7919).alias("code"))
    return a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), code("s_suppkey", 104_729).alias("code"))


def ngram_candidates(spark, d):
    return matching.gram_candidates(*_codes(spark, d), ["code"], ["code"], 4, ["ID"])


def ngram_greedy_pairs(spark, d):
    return matching.fuzzy_pairs(*_codes(spark, d), ["code"], ["code"], 4, ["ID"])


def broad_greedy_pairs(spark, d):
    side = lambda rows, k, by, more: rows.select(F.col(k).alias("row_id"), (F.col(k) * by % 1_000_003).cast("string").alias("code"), (F.col(k) * more).cast("string").alias("other"))
    return matching.broad_fuzzy_pairs(side(table(spark, d, "supplier"), "s_suppkey", 7919, 37), side(table(spark, d, "customer"), "c_custkey", 104_729, 53), 3)


MATCH = (Condition("s_nation", "c_nation", "equals"), Condition("s_tail", "c_tail", "contains", "digits_only", "AND"))
EITHER = (Condition("s_tail", "c_tail", "equals", "digits_only"), Condition("s_tail", "c_tail", "contains", "digits_only", "OR"), Condition("s_nation", "c_nation", "not_equals", "default", "AND"))


def _theta(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").cast("string").alias("s_nation"), (F.col("s_suppkey") % 100).cast("string").alias("s_tail"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("string").alias("c_nation"), F.col("c_custkey").cast("string").alias("c_tail"))
    return a, b


def theta_verdict(spark, d):
    return matching.verdict_by_row(*_theta(spark, d), MATCH)


def inclusion_matches(spark, d):
    return matching.inclusion_search(*_theta(spark, d), MATCH)


def set_equality_orders(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 7).alias("item"))
    return matching.set_equality(items, "l_orderkey", "item")


def range_match_amounts(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("value"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") * 20).alias("value"))
    return matching.range_match(a, b, tolerance=0.001)


def nearest_match(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    side = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias("row_id"), "user_id", "value")
    return matching.nearest_match(side("click"), side("view"), ["user_id"], "value", 3.0).select("a_row", "b_row", F.round("distance", 9).alias("distance"))


def status_counts(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return jobs.status_counts(c, o, "c_custkey", "o_custkey", "o_orderstatus", ["O", "F", "P"])


def latest_orders(spark, d):
    return jobs.latest(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day")), ["day", "o_orderkey"], 200, 50)


def consensus_mode(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return resolve.consensus(e, ["user_id"])


def recency_winner(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.col("value").cast("decimal(18,4)").cast("string").alias("value"), F.date_format("ts", "dd/MM/yyyy").alias("eff_date"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("affinity", "double"), ("lex", "double"), ("appendix_ord", "int"), ("file", "string"), ("page", "int"))]
    rows = e.select("*", (-F.col("seq")).cast("int").alias("doc_pos"), *none)
    return resolve.fold(rows, ["user_id", "event_type"], resolve.more_recent).select("user_id", "event_type", "seq", "value", "eff_date")


def fold_candidates(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.round(F.col("value") * 1000).cast("long").cast("string").alias("value"), F.date_format("ts", "dd/MM/yyyy").alias("eff_date"), (F.col("event_id") * 7919 % 101 / F.lit(101.0)).alias("affinity"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("lex", "double"), ("appendix_ord", "int"), ("file", "string"), ("page", "int"))]
    return resolve.fold(e.select("*", F.lit(0).alias("doc_pos"), *none), ["user_id", "event_type"], resolve.semantic).select("user_id", "event_type", "seq", "value", "eff_date")


def recency_branches(spark, d):
    """All branches of the rule: dates that repeat or are missing, lexical scores, appendix numbers and places."""
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        "user_id", "event_type", k.alias("seq"), k.cast("string").alias("value"), F.when(k % 3 > 0, F.concat(F.lit("0"), (1 + k % 2).cast("string"), F.lit("/05/2020"))).alias("eff_date"), F.lit(None).cast("double").alias("affinity"),
        F.when(k % 4 > 0, (k * 31 % 3).cast("double")).alias("lex"), F.when(k % 5 > 1, (k * 17 % 4).cast("int")).alias("appendix_ord"), F.when(k % 7 > 0, (k * 13 % 50).cast("int")).alias("doc_pos"), F.lit("f").alias("file"), F.lit(1).alias("page"),
    )
    return resolve.fold(e, ["user_id", "event_type"], resolve.more_recent).select("user_id", "event_type", "seq", "eff_date", "lex", "appendix_ord", "doc_pos")


def either_verdict(spark, d):
    """OR and AND without precedence: the fold reads conditions from the left."""
    a, b = _theta(spark, d)
    return matching.verdict_by_row(a, b.filter("row_id % 20 = 0"), EITHER)


def values_in_doubt(spark, d):
    """Guards over amounts of one entity (an order): one figure in all fields, shared between natures, in two classes."""
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("field_id"), F.concat(F.when(F.col("l_orderkey") % 4 == 0, "250000").otherwise((F.col("l_quantity").cast("int") * 10 % 130).cast("string")), F.lit(",00")).alias("value"),
        F.get(F.array(*map(F.lit, ("annual", "claim", "premium", "excess"))), (F.col("l_linenumber") % 4).cast("int")).alias("nature"),
    )
    spilt = resolve.spill_guard(items, F.col("nature") != "claim").withColumnRenamed("cleared", "spilt")
    merged = resolve.merge_guard(spilt).withColumnRenamed("cleared", "shared")
    kept = resolve.class_guard(items, F.col("nature") == "premium", F.col("nature") == "annual").select("entity_id", "field_id", F.lit(True).alias("kept"))
    return merged.join(kept, ["entity_id", "field_id"], "left").select("entity_id", "field_id", "spilt", "shared", F.coalesce("kept", F.lit(False)).alias("kept"))


def cross_field_checks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    k, money = F.col("o_orderkey"), lambda c: F.concat(c.cast("int").cast("string"), F.lit(",00"))
    wide = o.select(
        k, F.date_format("day", "dd/MM/yyyy").alias("start"), F.date_format(F.date_add("day", (k % 450 - 20).cast("int")), "dd/MM/yyyy").alias("end"), money(k % 1000 + 1).alias("annual"), money(k * 7 % 1000 + 1).alias("claim"),
        money(k * 3 % 1000 + 1).alias("sub_limit"), money(k % 100 + 1).alias("base"), money(k % 7 + 1).alias("tax"), money(k % 100 + k % 9 + 2).alias("total"),
    )
    return resolve.cross_field(wide).select("o_orderkey", F.array_join("violations", "|").alias("violations"))


def best_hints(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"), F.col("event_id"), (F.col("event_id") * 31 % 5).cast("int").alias("priority"), (F.col("event_id") * 7 % 10 / 10.0).alias("confidence"),
        F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "dd/MM/yyyy")).alias("eff_date"), (F.col("event_id") % 11).alias("doc_pos"), (F.col("event_id") % 4).alias("page"), F.col("event_id").alias("line"),
    )
    return resolve.best_hint(e).select("entity_id", "kind", "event_id")


def value_occurrences(spark, d):
    """In how many documents of a source each word occurs, and the newest one that has it."""
    docs = table(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "text", F.col("doc_id").cast("string").alias("file"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50).alias("ts"))
    values = docs.select("entity_id").distinct().select("entity_id", F.explode(F.array(*map(F.lit, ("license", "und", "nowhere at all")))).alias("value")).withColumn("field_id", F.col("value"))
    seen = resolve.occurrences(values, docs)
    found = evidence.value_source(values, docs).select("entity_id", "field_id", "file", "page")
    return seen.join(found, ["entity_id", "field_id"], "left").select("entity_id", "value", "seen", "file", "page")


def job_actions(spark, d):
    """Orders as jobs: retried, cancelled, let through and deleted; a wrong state means no change."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, jobs.STATES)), (F.col("o_orderkey") * 7 % 6).cast("int")).alias("status"), (F.col("o_orderkey") % 9).alias("cursor"), F.col("o_orderstatus").alias("error"),
    )
    some = lambda n, r: o.filter(F.col("id") % n == r).select("id")
    out = jobs.override_mismatch(jobs.cancel(jobs.retry(o, some(5, 0)), some(3, 0)), some(2, 0))
    return jobs.delete_jobs(out, o.select(F.col("id").alias("job_id")), some(11, 0))[0]


def job_lists(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, jobs.STATES)), (F.col("o_orderkey") * 7 % 6).cast("int")).alias("status"), F.col("o_orderdate").cast("date").alias("created_at"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 9).alias("batch_id"),
    )
    batches = jobs.active_batches(o).select(F.lit("batch").alias("list"), F.col("batch_id").alias("id"))
    lists = {"next": jobs.next_job(o), "active": jobs.active_job(o), "errors": jobs.in_states(o, "error", "mismatch")}
    for name, rows in lists.items():
        batches = batches.unionByName(rows.select(F.lit(name).alias("list"), "id"))
    return batches


def job_stats(spark, d):
    o = table(spark, d, "orders")
    work = o.select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("error").alias("status"))
    return jobs.data_stats(work, o.select((F.col("o_orderkey") * 1000).alias("bytes")), table(spark, d, "part").select(F.col("p_size").alias("num_pages")))


def reliabilities(spark, d):
    k = F.col("c_custkey")
    vat = F.lpad((k * 7919 + 12_345_678_901).cast("string"), 11, "0")
    value = F.when(k % 5 == 0, "n/d").when(k % 2 == 0, vat).otherwise(F.col("c_name"))
    rows = table(spark, d, "customer").select(k, F.col("c_nationkey").alias("entity_id"), k.alias("field_id"), F.when(k % 3 > 0, "text").otherwise("date").alias("kind"), scoring.reliability(value, k % 3 == 0, k % 7 == 0, k % 4 == 0, (k % 5).cast("long"), F.when(k % 6 > 2, 0.5)).alias("r"))
    rows = rows.select("c_custkey", "entity_id", "field_id", "kind", F.col("r.score").alias("score"), F.array_join("r.checks", "|").alias("checks"))
    doubtful = scoring.doubtful(rows, most=5).select("c_custkey", F.lit(True).alias("again"))
    return rows.join(doubtful, "c_custkey", "left").select("c_custkey", "score", "checks", F.coalesce("again", F.lit(False)).alias("again"))


def prechecks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    mode = F.get(words("keywords", "semantic", "llm", "off"), (k % 4).cast("int"))
    found = scoring.keyword_verdict(F.col("text"), F.when(k % 3 == 0, words("license", "and", "zzz")).otherwise(words()))
    out = docs.select("doc_id", scoring.precheck(mode, k % 10 > 0, found, scoring.keyword_verdict(F.col("text"), words("mozilla")), F.when(k % 7 > 0, k % 100 / 100.0), scoring.model_score(F.lit("Letter of the Public License"), words("public", "letter"))).alias("p"))
    return out.select("doc_id", "p.verdict", "p.mode", F.round("p.score", 9).alias("score"))


def evidence_checks(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    k, shown = F.col("p_partkey"), amounts.format_italian(F.col("price"))
    said = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("Premio annuo: "), shown, F.lit(" euro"))).when(k % 4 == 2, F.lit("Massimale 77,00")).otherwise(F.concat(F.lit("Franchigia "), shown))
    return p.select(
        "p_partkey", evidence.supports_amount(shown, said).alias("loose"), evidence.supports_amount(shown, said, strict=True).alias("strict"), evidence.leading_label(said).alias("label"), evidence.line_holds(said, shown, F.lit("number")).alias("holds"),
        evidence.contradiction(said, F.lit("Premio imponibile")).alias("against"), evidence.label_near(said, shown, F.lit("premio annuale")).alias("near"),
    )


def rolling_state_batch(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("valid_on"), F.lit(None).cast("string").alias("doc_date"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source"))
    return resolve.rolling_state(e, ["user_id", "event_type"])


def round_robin(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return search.round_robin(e, "event_type", "event_id").select("event_id", "event_type", "turn")


def pivot_fields(spark, d):
    e = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase", "signup", "error"]).agg(F.min("event_id"))
    return e


def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    from ..operators.scoring import repair_json

    return e.select("event_id", F.from_json(repair_json(F.concat(F.lit("x "), F.col("props"), F.lit(" y"))), "k int")["k"].alias("k"))


def distinct_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.median("value"), 6).alias("median_value"))


QUERIES = {f.__name__: f for f in (waterfall_match, only_left, only_right, ngram_candidates, ngram_greedy_pairs, broad_greedy_pairs, theta_verdict, inclusion_matches, set_equality_orders, range_match_amounts, nearest_match, status_counts, latest_orders, consensus_mode, recency_winner, recency_branches, fold_candidates, rolling_state_batch, either_verdict, values_in_doubt, cross_field_checks, best_hints, value_occurrences, job_actions, job_lists, job_stats, reliabilities, prechecks, evidence_checks, round_robin, pivot_fields, json_props, distinct_users)}

_SIDES = """WITH a AS (SELECT c_custkey AS row_id, regexp_replace('00' || (c_custkey * 3)::VARCHAR, '^0+([^0])', '\\1') AS k0, right(regexp_replace('TEL' || lpad((c_custkey * 17)::VARCHAR, 8, '0'), '[^0-9]', '', 'g'), 6) AS k1 FROM customer),
b AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey * 2)::VARCHAR ELSE '' END AS k0, right('39' || lpad((c_custkey * 17 * CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END)::VARCHAR, 8, '0'), 6) AS k1 FROM customer),
h AS (SELECT a.row_id AS a_row, 0 AS key, k0 AS v FROM a WHERE k0 <> '' AND k0 IN (SELECT k0 FROM b) UNION ALL SELECT a.row_id, 1, k1 FROM a WHERE k1 IN (SELECT k1 FROM b) AND NOT (k0 <> '' AND k0 IN (SELECT k0 FROM b))),
m AS (SELECT a_row, b.row_id AS b_row, key FROM h JOIN b ON (key = 0 AND b.k0 = v) OR (key = 1 AND b.k1 = v))
""".replace("\\\\1", "\\1")
_GRAMS = """WITH a AS (SELECT c_custkey AS a_row, (c_custkey * 7919 % 1000003)::VARCHAR AS s FROM customer), b AS (SELECT s_suppkey AS b_row, (s_suppkey * 104729 % 1000003)::VARCHAR AS s FROM supplier),
ga AS (SELECT a_row, g, min(i) AS i FROM (SELECT a_row, unnest(range(1, greatest(len(s) - 2, 1))) AS i, substr(s, unnest(range(1, greatest(len(s) - 2, 1))), 4) AS g FROM a) GROUP BY 1, 2),
gp AS (SELECT a_row, g, row_number() OVER (PARTITION BY a_row ORDER BY i) - 1 AS place FROM ga),
gb AS (SELECT DISTINCT b_row, substr(s, unnest(range(1, greatest(len(s) - 2, 1))), 4) AS g FROM b)
SELECT a_row, b_row, min(place)::INT AS place FROM gp JOIN gb USING (g) GROUP BY 1, 2"""
_THETA = """WITH a AS (SELECT s_suppkey AS row_id, CASE WHEN s_nationkey::VARCHAR = '0' THEN '0' ELSE ltrim(s_nationkey::VARCHAR, '0') END AS n, (s_suppkey % 100)::VARCHAR AS t FROM supplier),
b AS (SELECT c_custkey AS row_id, c_nationkey::VARCHAR AS n, c_custkey::VARCHAR AS t FROM customer),
p AS (SELECT a.row_id AS a_row, b.row_id AS b_row FROM a JOIN b ON a.n = b.n AND contains(b.t, a.t))
"""
#: Rows of A in order, each with its candidates in order, fold into what the rows before took.
_GREEDY = """l AS (SELECT {'a': a_row, 'c': list(b_row ORDER BY place, b_row), 'got': []::BIGINT[], 'took': []::BIGINT[]} AS e FROM c GROUP BY a_row),
  r AS (SELECT list_reduce(list_prepend({'a': -1::BIGINT, 'c': []::BIGINT[], 'got': []::BIGINT[], 'took': []::BIGINT[]}, list(e ORDER BY e.a)), lambda x, y: CASE WHEN len(list_filter(y.c, lambda b: NOT list_contains(x.took, b))) > 0
    THEN {'a': y.a, 'c': []::BIGINT[], 'got': list_append(x.got, y.a), 'took': list_append(x.took, list_filter(y.c, lambda b: NOT list_contains(x.took, b))[1])} ELSE x END) AS s FROM l)
SELECT unnest(s.got) AS a_row, unnest(s.took) AS b_row FROM r"""
_BROAD = """WITH n AS (SELECT 0 AS side, s_suppkey AS row, 1 AS part, (s_suppkey * 7919 % 1000003)::VARCHAR AS s FROM supplier UNION ALL SELECT 0, s_suppkey, 2, (s_suppkey * 37)::VARCHAR FROM supplier
  UNION ALL SELECT 1, c_custkey, 1, (c_custkey * 104729 % 1000003)::VARCHAR FROM customer UNION ALL SELECT 1, c_custkey, 2, (c_custkey * 53)::VARCHAR FROM customer),
g AS (SELECT side, row, g, min(part * 1000 + i) AS i FROM (SELECT side, row, part, unnest(range(1, greatest(len(s) - 1, 1))) AS i, substr(s, unnest(range(1, greatest(len(s) - 1, 1))), 3) AS g FROM n) GROUP BY 1, 2, 3),
p AS (SELECT side, row, g, row_number() OVER (PARTITION BY side, row ORDER BY i) AS place FROM g), c AS (SELECT a.row AS a_row, b.row AS b_row, min(a.place) AS place FROM p a JOIN p b USING (g) WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2), """
#: The rule of recency between the candidate kept so far, x, and the next, y.
_RECENT = """CASE WHEN x.day IS DISTINCT FROM y.day THEN NOT (x.day IS NOT NULL AND (y.day IS NULL OR y.day < x.day)) WHEN x.lex IS NOT NULL AND y.lex IS NOT NULL AND x.lex <> y.lex THEN y.lex > x.lex
  WHEN x.app IS DISTINCT FROM y.app THEN coalesce(y.app, -1) > coalesce(x.app, -1) ELSE coalesce(y.pos, 2147483647) < coalesce(x.pos, 2147483647) END"""
_JOBS = "WITH j AS (SELECT o_orderkey AS id, ['queued', 'running', 'done', 'error', 'canceled', 'mismatch'][(o_orderkey * 7 % 6 + 1)::INT] AS status, o_orderkey % 9 AS cursor, o_orderstatus AS error, o_orderdate::DATE AS created_at, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 9 END AS batch_id FROM orders)"
_FOLDED = "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))"
_SHOWN = "translate(format('{:,.2f}', p_retailprice::DECIMAL(18,2)::DOUBLE), ',.', '.,')"
ORACLES = {
    "recency_branches": f"""WITH e AS (SELECT user_id, event_type, list({{'seq': event_id, 'day': CASE WHEN event_id % 3 > 0 THEN make_date(2020, 5, (1 + event_id % 2)::INT) END, 'lex': CASE WHEN event_id % 4 > 0 THEN (event_id * 31 % 3)::DOUBLE END,
        'app': CASE WHEN event_id % 5 > 1 THEN (event_id * 17 % 4)::INT END, 'pos': CASE WHEN event_id % 7 > 0 THEN (event_id * 13 % 50)::INT END}} ORDER BY event_id) AS c FROM events GROUP BY 1, 2),
      w AS (SELECT user_id, event_type, list_reduce(c, lambda x, y: CASE WHEN {_RECENT} THEN y ELSE x END) AS w FROM e)
      SELECT user_id, event_type, w.seq AS seq, strftime(w.day, '%d/%m/%Y') AS eff_date, w.lex AS lex, w.app AS appendix_ord, w.pos AS doc_pos FROM w""",
    "fold_candidates": f"""WITH e AS (SELECT user_id, event_type, list({{'seq': event_id, 'value': round(value * 1000)::BIGINT, 'day': ts::DATE, 'gain': (event_id * 7919 % 101)::DOUBLE / 101::DOUBLE, 'lex': NULL::DOUBLE, 'app': NULL::INT, 'pos': 0}} ORDER BY event_id) AS c FROM events GROUP BY 1, 2),
      w AS (SELECT user_id, event_type, list_reduce(c, lambda x, y: CASE WHEN CASE WHEN x.value > 0 AND y.value < x.value * 0.2::DOUBLE AND NOT y.gain - x.gain > 0.15::DOUBLE THEN false WHEN y.gain - x.gain > 0.15::DOUBLE THEN true
        WHEN -(y.gain - x.gain) > 0.10::DOUBLE THEN false ELSE {_RECENT} END THEN y ELSE x END) AS w FROM e)
      SELECT user_id, event_type, w.seq AS seq, w.value::VARCHAR AS value, strftime(w.day, '%d/%m/%Y') AS eff_date FROM w""",
    "rolling_state_batch": """WITH e AS (SELECT user_id, event_type, list({'seq': event_id, 'value': round(value * 100)::BIGINT, 'day': ts::DATE} ORDER BY event_id) AS c FROM events GROUP BY 1, 2),
      w AS (SELECT user_id, event_type, list_reduce(c, lambda x, y: CASE WHEN CASE WHEN x.value > 0 AND y.value > 0 AND y.value <= x.value * 0.05::DOUBLE THEN false WHEN x.value > 0 AND y.value > 0 AND y.value >= x.value * 20 THEN true ELSE y.day >= x.day END THEN y ELSE x END) AS w FROM e)
      SELECT user_id, event_type, w.value::VARCHAR AS value, strftime(w.day, '%d/%m/%Y') AS eff_date, 'e' || w.seq AS source, w.seq AS seq FROM w""",
    "either_verdict": """WITH a AS (SELECT s_suppkey AS row_id, CASE WHEN s_nationkey::VARCHAR = '0' THEN '0' ELSE ltrim(s_nationkey::VARCHAR, '0') END AS n, (s_suppkey % 100)::VARCHAR AS t FROM supplier),
      b AS (SELECT c_custkey AS row_id, c_nationkey::VARCHAR AS n, c_custkey::VARCHAR AS t FROM customer WHERE c_custkey % 20 = 0), p AS (SELECT a.row_id AS a_row, b.row_id AS b_row FROM a JOIN b ON (a.t = b.t OR contains(b.t, a.t)) AND a.n <> b.n)
      SELECT a.row_id, count(b_row) AS match_count, coalesce(list_sort(list(b_row) FILTER (b_row IS NOT NULL))[1:20], []) AS matches FROM a LEFT JOIN p ON a.row_id = p.a_row GROUP BY 1""",
    "values_in_doubt": """WITH i AS (SELECT l_orderkey AS entity_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS field_id, CASE WHEN l_orderkey % 4 = 0 THEN 250000 ELSE l_quantity::INT * 10 % 130 END AS v, ['annual', 'claim', 'premium', 'excess'][(l_linenumber % 4 + 1)::INT] AS nature FROM lineitem),
      f AS (SELECT entity_id, count(*) AS n, min(v) AS lo, max(v) AS hi FROM i WHERE nature <> 'claim' GROUP BY 1), s AS (SELECT entity_id, v, count(*) AS n, count(DISTINCT nature) AS k FROM i GROUP BY 1, 2)
      SELECT i.entity_id, field_id, coalesce(nature <> 'claim' AND f.n >= 4 AND lo = hi AND lo >= 100000, false) AS spilt, i.v <= 50 OR (s.n >= 3 AND k >= 2 AND nature NOT IN ('annual', 'claim')) AS shared,
        NOT (nature = 'premium' AND EXISTS (SELECT 1 FROM i b WHERE b.entity_id = i.entity_id AND b.v = i.v AND b.nature = 'annual')) AS kept FROM i LEFT JOIN f USING (entity_id) JOIN s ON s.entity_id = i.entity_id AND s.v = i.v""",
    "cross_field_checks": """WITH o AS (SELECT o_orderkey AS k FROM orders)
      SELECT k AS o_orderkey, coalesce(concat_ws('|', CASE WHEN k % 450 - 20 <= 0 THEN 'start_before_end' END, CASE WHEN k % 450 - 20 > 400 THEN 'over_400_days' END, CASE WHEN k % 1000 < k * 7 % 1000 THEN 'annual_below_claim' END,
        CASE WHEN k * 3 % 1000 > k % 1000 THEN 'sub_limit_over_annual' END, CASE WHEN k % 7 <> k % 9 THEN 'total_note' END), '') AS violations FROM o""",
    "best_hints": """SELECT user_id AS entity_id, event_type AS kind, event_id FROM events WHERE event_id * 7 % 10 >= 5
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id * 31 % 5, event_id * 7 % 10 DESC, CASE WHEN event_id % 3 > 0 THEN ts::DATE END DESC NULLS LAST, event_id % 11, event_id % 4, event_id) = 1""",
    "value_occurrences": """WITH v AS (SELECT entity_id, unnest(['license', 'und', 'nowhere at all']) AS value FROM (SELECT DISTINCT source AS entity_id FROM documents)),
      h AS (SELECT entity_id, value, doc_id, text, row_number() OVER (PARTITION BY entity_id, value ORDER BY CASE WHEN doc_id % 3 > 0 THEN doc_id % 50 END DESC NULLS LAST, doc_id::VARCHAR) AS r, count(*) OVER (PARTITION BY entity_id, value) AS n FROM v JOIN documents ON source = entity_id AND contains(text, value))
      SELECT v.entity_id, v.value, coalesce(n, 0) AS seen, doc_id::VARCHAR AS file, CASE WHEN doc_id IS NOT NULL THEN len(string_split(left(text, strpos(text, v.value) - 1), chr(12)))::INT END AS page FROM v LEFT JOIN h ON h.entity_id = v.entity_id AND h.value = v.value AND r = 1""",
    "job_actions": _JOBS + """, r AS (SELECT id, status, cursor, error, id % 5 = 0 AND status IN ('error', 'canceled', 'done', 'mismatch') AS go FROM j), a AS (SELECT id, CASE WHEN go THEN 'queued' ELSE status END AS status, CASE WHEN go THEN 0 ELSE cursor END AS cursor, CASE WHEN NOT go THEN error END AS error FROM r),
      b AS (SELECT id, CASE WHEN id % 3 = 0 AND status IN ('queued', 'running') THEN 'canceled' ELSE status END AS status, cursor, error FROM a), c AS (SELECT id, CASE WHEN id % 2 = 0 AND status = 'mismatch' THEN 'queued' ELSE status END AS status, cursor, error FROM b)
      SELECT * FROM c WHERE NOT (id % 11 = 0 AND status <> 'running')""",
    "job_lists": _JOBS + """ SELECT 'batch' AS list, batch_id AS id FROM (SELECT DISTINCT batch_id FROM j WHERE status IN ('queued', 'running') AND batch_id IS NOT NULL)
      UNION ALL SELECT 'next', id FROM (SELECT id FROM j WHERE status IN ('running', 'queued') ORDER BY status <> 'running', created_at, id LIMIT 1)
      UNION ALL SELECT 'active', id FROM (SELECT id FROM j ORDER BY status NOT IN ('running', 'queued'), created_at DESC, id DESC LIMIT 1) UNION ALL SELECT 'errors', id FROM j WHERE status IN ('error', 'mismatch')""",
    "job_stats": "SELECT count(*) AS jobs, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) AS files, round(sum(o_orderkey * 1000) / 1048576::DOUBLE, 1) AS megabytes, (SELECT count(*) FROM part) AS cached, (SELECT sum(p_size)::BIGINT FROM part) AS pages FROM orders",
    "reliabilities": """WITH c AS (SELECT c_custkey AS k, c_nationkey AS e, lpad((c_custkey * 7919 + 12345678901)::VARCHAR, 11, '0') AS code FROM customer),
      s AS (SELECT *, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN code[i]::INT WHEN code[i]::INT > 4 THEN code[i]::INT * 2 - 9 ELSE code[i]::INT * 2 END)) AS t FROM c),
      p AS (SELECT k, e, k % 5 = 0 AS none, k % 3 = 0 AS a, k % 7 = 0 OR (k % 2 = 0 AND k % 5 > 0 AND (10 - t % 10) % 10 = code[11]::INT AND len(list_distinct(string_split(code[1:10], ''))) > 1) AS b, k % 4 = 0 AS c, k % 5 >= 2 AS d, k % 6 > 2 AS f FROM s),
      q AS (SELECT *, CASE WHEN none THEN 0.0 ELSE least(1.0, a::INT * 0.3 + b::INT * 0.4 + c::INT * 0.2 + d::INT * 0.2 + f::INT * 0.2) END::DOUBLE AS score FROM p)
      SELECT k AS c_custkey, score, CASE WHEN none THEN '' ELSE concat_ws('|', CASE WHEN a THEN 'evidence' END, CASE WHEN b THEN 'checksum' END, CASE WHEN c THEN 'recency' END, CASE WHEN d THEN 'documents' END, CASE WHEN f THEN 'affinity' END) END AS checks,
        k % 3 > 0 AND score < 0.5 AND row_number() OVER (PARTITION BY e, k % 3 > 0 AND score < 0.5 ORDER BY score, k) <= 5 AS again FROM q""",
    "prechecks": f"""WITH d AS (SELECT doc_id AS k, {_FOLDED} AS t FROM documents), m AS (SELECT *, ['keywords', 'semantic', 'llm', 'off'][(k % 4 + 1)::INT] AS asked, k % 3 = 0 AS words, (contains(t, 'license')::INT + contains(t, 'and')::INT) / 3::DOUBLE AS ratio FROM d),
      f AS (SELECT *, CASE WHEN asked = 'off' AND words THEN 'keywords' WHEN asked = 'keywords' AND NOT words THEN 'semantic' ELSE asked END AS mode FROM m),
      s AS (SELECT *, CASE mode WHEN 'keywords' THEN ratio WHEN 'semantic' THEN CASE WHEN k % 7 > 0 THEN k % 100 / 100::DOUBLE END WHEN 'llm' THEN 0.5::DOUBLE END AS score FROM f)
      SELECT k AS doc_id, CASE WHEN contains(t, 'mozilla') THEN 'mismatch' WHEN mode = 'off' OR k % 10 = 0 OR score IS NULL THEN 'skipped' WHEN score >= CASE mode WHEN 'keywords' THEN 0.01 WHEN 'semantic' THEN 0.45 ELSE 0.34 END THEN 'ok' ELSE 'mismatch' END AS verdict, mode, round(score, 9) AS score FROM s""",
    "evidence_checks": f"""WITH p AS (SELECT p_partkey AS k, p_retailprice::DECIMAL(18,2)::DOUBLE AS v, {_SHOWN} AS shown FROM part)
      SELECT k AS p_partkey, v < 1000 OR k % 4 <> 2 AS loose, CASE WHEN k % 4 = 0 THEN false ELSE v < 1000 OR k % 4 <> 2 END AS strict, ['', 'Premio annuo', 'Massimale', 'Franchigia'][(k % 4 + 1)::INT] AS label, k % 4 IN (1, 3) AS holds,
        CASE WHEN k % 4 IN (2, 3) THEN 'structural' END AS against, k % 4 = 1 AS near FROM p""",
    "waterfall_match": _SIDES + "SELECT a_row, b_row, key FROM m",
    "only_left": _SIDES + "SELECT row_id FROM a WHERE row_id NOT IN (SELECT a_row FROM h)",
    "only_right": _SIDES + "SELECT row_id FROM b WHERE row_id NOT IN (SELECT b_row FROM m)",
    "ngram_candidates": _GRAMS,
    "ngram_greedy_pairs": _GRAMS.replace("\nSELECT a_row", ",\nc AS (SELECT a_row") + "), " + _GREEDY,
    "broad_greedy_pairs": _BROAD + _GREEDY,
    "theta_verdict": _THETA + "SELECT a.row_id, count(b_row) AS match_count, coalesce(list_sort(list(b_row) FILTER (b_row IS NOT NULL))[1:20], []) AS matches FROM a LEFT JOIN p ON a.row_id = p.a_row GROUP BY 1",
    "inclusion_matches": _THETA + "SELECT a.row_id, coalesce(list_sort(list(b_row) FILTER (b_row IS NOT NULL)), []) AS matches FROM a LEFT JOIN p ON a.row_id = p.a_row GROUP BY 1",
    "set_equality_orders": "WITH s AS (SELECT l_orderkey AS owner, list_sort(list_distinct(list(l_suppkey % 7))) AS items FROM lineitem GROUP BY 1) SELECT owner, twin FROM (SELECT owner, CASE WHEN owner = nth_value(owner, 1) OVER w THEN nth_value(owner, 2) OVER w ELSE nth_value(owner, 1) OVER w END AS twin FROM s WINDOW w AS (PARTITION BY items ORDER BY owner ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE twin IS NOT NULL",
    "range_match_amounts": "SELECT o_orderkey AS a_row, c_custkey AS b_row FROM orders JOIN customer ON abs(c_acctbal * 20 - o_totalprice) <= abs(o_totalprice) * 0.001",
    "nearest_match": "SELECT a.event_id AS a_row, first(b.event_id ORDER BY abs(b.value - a.value), b.value, b.event_id) AS b_row, round(min(abs(b.value - a.value)), 9) AS distance FROM events a JOIN events b ON a.user_id = b.user_id AND abs(b.value - a.value) <= 3.0 WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1",
    "status_counts": """SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
    "latest_orders": "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY day DESC, o_orderkey DESC LIMIT 200 OFFSET 50",
    "consensus_mode": "WITH c AS (SELECT user_id, event_type AS value, count(*) AS votes, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, first(value ORDER BY votes DESC, f) AS value, max(votes) AS votes, count(*) > 1 AS disputed FROM c GROUP BY 1",
    "recency_winner": "SELECT user_id, event_type, last(event_id ORDER BY ts::DATE, event_id) AS seq, last(value::DECIMAL(18,4)::VARCHAR ORDER BY ts::DATE, event_id) AS value, strftime(max(ts::DATE), '%d/%m/%Y') AS eff_date FROM events GROUP BY 1, 2",
    "round_robin": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS turn FROM events",
    "pivot_fields": "SELECT user_id, min(event_id) FILTER (event_type = 'click') AS click, min(event_id) FILTER (event_type = 'view') AS view, min(event_id) FILTER (event_type = 'purchase') AS purchase, min(event_id) FILTER (event_type = 'signup') AS signup, min(event_id) FILTER (event_type = 'error') AS error FROM events GROUP BY 1",
    "json_props": "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events",
    "distinct_users": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS high, round(median(value), 6) AS median_value FROM events GROUP BY 1",
}
