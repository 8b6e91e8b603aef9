"""How good extracted values are: comparison with expected ones, reliability, pre-checks and rules for reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import loose_amount, parse_pure
from ..functions.dates import normalise_date
from ..functions.identifiers import clean_fiscal_id, is_placeholder
from ..functions.text import bound, letters_and_digits, match_tokens, strip, text_of

STATES = ("exact", "normalized", "mismatch", "missing", "forbidden")
#: Weights of a field's reliability.
WEIGHTS = {"evidence": 0.3, "checksum": 0.4, "recency": 0.2, "documents": 0.2, "affinity": 0.2}
KEYWORD_RATIO, SEMANTIC_LEAST, MODEL_LEAST = 0.01, 0.45, 0.34


def compare_field(expected: Column, actual: Column, mode: Column, forbidden: Column) -> Column:
    """exact, normalized, mismatch, missing or forbidden, by the mode exact, text, date, amount, vat or contains."""
    a, e = strip(text_of(actual)), text_of(expected)
    na, ne = letters_and_digits(a), letters_and_digits(e)
    banned = F.exists(F.coalesce(forbidden, F.array().cast("array<string>")), lambda f: (letters_and_digits(f) != "") & ((letters_and_digits(f) == na) | F.array_contains(match_tokens(a, 1), letters_and_digits(f))))
    same = lambda x, y: F.when(F.coalesce(x == y, F.lit(False)), F.when(a == strip(e), "exact").otherwise("normalized")).otherwise("mismatch")
    amount = lambda c: F.coalesce(parse_pure(c), loose_amount(c))
    vat = clean_fiscal_id(a)
    wanted = F.coalesce(clean_fiscal_id(e), e)
    return (
        F.when(a == "", "missing").when(banned, "forbidden")
        .when(mode == "text", F.when(na == "", "mismatch").otherwise(same(na, ne)))
        .when(mode == "date", same(normalise_date(a), normalise_date(e)))
        .when(mode == "amount", same(amount(a), amount(e)))
        .when(mode == "vat", F.when(vat == wanted, F.when(a == wanted, "exact").otherwise("normalized")).otherwise("mismatch"))
        .when(mode == "contains", F.when((na != "") & (ne != "") & F.contains(na, ne), F.when(na == ne, "exact").otherwise("normalized")).otherwise("mismatch"))
        .otherwise(F.when(a == e, "exact").otherwise("mismatch"))
    )


def score_extraction(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: counts by state, match rates, hallucination rate and keys that were not asked for.

    expected (field_id, value, mode, forbidden), actual (field_id, value).
    """
    got = actual.filter(strip(text_of(F.col("value"))) != "").select("field_id", F.col("value").alias("actual"))
    joined = expected.join(got, "field_id", "left").withColumn("state", compare_field(F.col("value"), F.col("actual"), F.col("mode"), F.col("forbidden")))
    counts = joined.agg(F.count("*").alias("expected"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    extra = got.join(expected, "field_id", "left_anti").agg(F.count("*").alias("extra"))
    matched = F.col("exact") + F.col("normalized")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.join(extra, F.lit(True)).select(
        "expected", *STATES, "extra", rate(F.col("exact"), F.col("expected")).alias("exact_rate"), rate(matched, F.col("expected")).alias("match_rate"),
        rate(F.col("mismatch") + F.col("forbidden"), F.col("expected") - F.col("missing")).alias("hallucination_rate"),
    )


def score_report(scores: DataFrame) -> DataFrame:
    """A score as lines (name, value)."""
    return scores.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in scores.columns])).alias("x")).select("x.*")


def reliability(value: Column, has_page: Column, checksum: Column, dated: Column, seen: Column, affinity: Column) -> Column:
    """struct(score, checks): a weighted sum, at most 1, of what speaks for a value; 0 for a placeholder."""
    parts = {"evidence": has_page, "checksum": checksum | clean_fiscal_id(value).isNotNull(), "recency": dated, "documents": F.coalesce(seen >= 2, F.lit(False)), "affinity": affinity.isNotNull()}
    good = ~is_placeholder(value)

    def weigh(flags: Column) -> Column:
        total, names = F.lit(0.0), []
        for i, name in enumerate(parts):
            said = F.get(flags, F.lit(i))
            total = total + F.when(said, F.lit(WEIGHTS[name])).otherwise(F.lit(0.0))
            names.append(F.when(said, name))
        return F.struct(F.round(F.least(total, F.lit(1.0)), 2).alias("score"), F.array_compact(F.array(*names)).alias("checks"))

    none = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("checks"))
    return F.when(good, bound(F.array(*[F.coalesce(test, F.lit(False)) for test in parts.values()]), weigh)).otherwise(none)


def doubtful(fields: DataFrame, below: float = 0.5, most: int = 8) -> DataFrame:
    """Free-text fields to check again: the least reliable first, ``most`` per entity."""
    rows = fields.filter((F.col("score") < below) & (F.col("kind") == "text"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy("score", "field_id"))).filter(F.col("_r") <= most).drop("_r")


def keyword_verdict(text: Column, keywords: Column) -> Column:
    """struct(matched, missing, ratio): keywords found in a text, both folded."""
    t = letters_and_digits(text, spaced=True)
    has = lambda k: F.contains(t, letters_and_digits(k, spaced=True))
    found = F.filter(keywords, has)
    return F.struct(found.alias("matched"), F.filter(keywords, lambda k: ~has(k)).alias("missing"), F.when(F.size(keywords) > 0, F.size(found) / F.size(keywords)).otherwise(F.lit(0.0)).alias("ratio"))


def precheck(mode: Column, has_profile: Column, keywords: Column, excluded: Column, semantic: Column, model: Column) -> Column:
    """struct(verdict, mode, score): an excluded word always decides; else by keywords, semantic score or model score.

    ``keywords`` and ``excluded`` are ``keyword_verdict`` structs; without keywords the mode keywords becomes semantic,
    with them the mode off becomes keywords.
    """
    any_keywords = (F.size(keywords["matched"]) + F.size(keywords["missing"])) > 0
    effective = F.when((mode == "off") & any_keywords, "keywords").when((mode == "keywords") & ~any_keywords, "semantic").otherwise(mode)
    score = F.when(effective == "keywords", keywords["ratio"]).when(effective == "semantic", semantic).when(effective == "llm", model).cast("double")
    least = F.when(effective == "keywords", KEYWORD_RATIO).when(effective == "semantic", SEMANTIC_LEAST).otherwise(MODEL_LEAST)
    verdict = F.when(F.size(excluded["matched"]) > 0, "mismatch").when((effective == "off") | ~has_profile | score.isNull(), "skipped").when(score >= least, "ok").otherwise("mismatch")
    return F.struct(verdict.alias("verdict"), effective.alias("mode"), score.alias("score"))


def semantic_score(affinities: DataFrame, entity: str = "entity_id", field: str = "field_id") -> DataFrame:
    """Mean over fields of the best affinity; fields with NaN do not count."""
    best = affinities.filter(~F.isnan("affinity")).groupBy(entity, field).agg(F.max("affinity").alias("best"))
    return best.groupBy(entity).agg(F.avg("best").alias("score"))


def model_score(detected: Column, terms: Column) -> Column:
    """Share of the detected type's words among the profile's."""
    words = match_tokens(detected, 3)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.array_contains(terms, w))) / F.size(words)).otherwise(F.lit(0.0))


def review_answer(raw: Column) -> Column:
    """struct(ok, reason) of a tolerant JSON answer; ok is null where it cannot be told, which keeps the value."""
    ok = F.lower(F.regexp_extract(text_of(raw), r'(?i)"?ok"?\s*[:=]\s*"?(true|false|si|sì|yes|no)', 1))
    reason = F.regexp_extract(text_of(raw), r'(?i)"(?:motivo|reason)"\s*:\s*"([^"]*)"', 1)
    return F.struct(F.when(ok.isin("true", "si", "sì", "yes"), F.lit(True)).when(ok.isin("false", "no"), F.lit(False)).alias("ok"), reason.alias("reason"))


def apply_reviews(values: DataFrame, answers: DataFrame, keys: Sequence[str] = ("entity_id", "field_id")) -> DataFrame:
    """Values without those that a review refuses with a reason; anything less keeps the value."""
    refused = answers.withColumn("_a", review_answer(F.col("raw"))).filter("NOT _a.ok AND _a.reason <> ''").select(*keys)
    return values.join(refused.distinct(), list(keys), "left_anti")


def repair_json(raw: Column) -> Column:
    """The widest {...} of a text without comments and trailing commas, for from_json."""
    body = F.regexp_extract(text_of(raw), r"(?s)\{.*\}", 0)
    plain = F.regexp_replace(F.regexp_replace(body, r"(?m)(?<![:\"'])//[^\n\"]*$", ""), r"(?s)/\*.*?\*/", "")
    return F.nullif(F.regexp_replace(plain, r",(\s*[}\]])", "$1"), F.lit(""))


def unique_key_match(keys: DataFrame, known: DataFrame, key: str = "key", cap: int = 2, shortest: int = 8) -> DataFrame:
    """(key, known): exact names, else the only one within ``cap`` edits of a name of ``shortest`` characters or more.

    ``known`` is a dimension (field names); ties give no match.
    """
    exact = keys.join(known, keys[key] == known["known"]).select(keys[key], "known")
    rest = keys.join(exact, key, "left_anti").filter(F.length(key) >= shortest)
    near = rest.join(known, F.abs(F.length(F.col(key)) - F.length("known")) <= cap).filter(F.levenshtein(F.col(key), F.col("known"), cap) >= 0)
    return exact.unionByName(near.groupBy(key).agg(F.count("*").alias("n"), F.min("known").alias("known")).filter("n = 1").select(key, "known"))
