"""Where a value stands in documents, and whether what is cited supports it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_grouped, parse_pure
from ..functions.dates import normalise_date
from ..functions.fields import CATEGORIES
from ..functions.identifiers import clean_fiscal_id, has_digit_run
from ..functions.rules import categories
from ..functions.text import fold_accents, letters_and_digits, lines, match_tokens, page_number, stems, text_of

SPAN = 200


def supports_amount(value: Column, evidence: Column, strict: bool = False) -> Column:
    """Amounts of four digits or more need a block of their digits in the evidence; strict: any amount needs evidence."""
    amount = parse_pure(value)
    whole = F.floor(F.abs(amount)).cast("string")
    blank = F.trim(text_of(evidence)) == ""
    return F.when(amount.isNull(), F.lit(True)).when(blank, F.lit(not strict)).when(F.length(whole) < 4, F.lit(True)).otherwise(has_digit_run(evidence, whole))


def supported(value: Column, evidence: Column, context: Column, is_fiscal: Column) -> Column:
    """Whether a document supports a value, by its kind: date, fiscal number, amount or text.

    A text needs 80 % of its words in the context; with three words or more one may fail OCR if 60 % of the letters hit.
    """
    n_context, n_value, n_evidence = letters_and_digits(context), letters_and_digits(value), letters_and_digits(evidence)
    cited = (n_evidence != "") & F.contains(n_context, n_evidence)
    day = normalise_date(value)
    by_date = F.contains(n_context, F.replace(day, F.lit("/"), F.lit(""))) | (cited & F.contains(n_evidence, F.right(day, F.lit(4))))
    by_number = F.contains(n_context, n_value) | (cited & (F.length(n_evidence) >= 6))
    amount = parse_pure(value)
    whole = F.floor(F.abs(amount)).cast("string")
    by_amount = F.when(F.length(whole) >= 4, has_digit_run(context, whole) | (has_digit_run(evidence, whole) & cited & (F.length(n_evidence) >= 10))).otherwise(~((F.length(n_evidence) >= 15) & ~F.contains(n_context, n_evidence)))
    tokens = match_tokens(value)
    hit = F.filter(tokens, lambda t: F.contains(n_context, t))
    letters = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t))
    allowed = F.greatest(F.lit(1), F.floor(F.size(tokens) * 0.2))
    lenient = (F.size(tokens) >= 3) & (F.size(hit) >= F.size(tokens) - allowed) & (letters(hit) >= letters(tokens) * 0.6)
    by_words = F.contains(n_context, n_value) | ((F.size(tokens) > 0) & (lenient | (F.size(hit) >= F.ceil(F.size(tokens) * 0.8))))
    test = F.when(day.isNotNull(), by_date).when(text_of(value).rlike(r"^\d{6,16}$") & is_fiscal, by_number).when(amount.isNotNull(), by_amount).when(F.length(n_value) >= 4, by_words).otherwise(cited)
    return F.coalesce(test, F.lit(False))


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, line, text): lines from 1."""
    return pages.select("doc_id", "page", F.posexplode(lines(F.col(text))).alias("_n", "text")).select("doc_id", "page", (F.col("_n") + 1).alias("line"), "text")


def leading_label(line: Column) -> Column:
    """What a line says before its first colon or number."""
    return F.trim(F.regexp_extract(text_of(line), r"^\s*([^:\d]{2,60})", 1))


def line_holds(line: Column, value: Column, kind: Column) -> Column:
    """Whether a line holds a value of a kind (number, date, fiscal, text)."""
    digits = F.regexp_replace(text_of(value), "[^0-9]", "")
    whole = F.floor(F.abs(parse_grouped(value))).cast("string")
    number = has_digit_run(line, digits) | has_digit_run(line, whole) | ((F.length(whole) < 4) & F.contains(F.regexp_replace(line, "[^0-9]", ""), whole))
    day = F.contains(letters_and_digits(line), F.replace(normalise_date(value), F.lit("/"), F.lit("")))
    plain = (letters_and_digits(value) != "") & F.contains(letters_and_digits(line), letters_and_digits(value))
    return F.coalesce(F.when(kind == "number", number).when(kind == "date", day).otherwise(plain), F.lit(False))


def contradiction(line: Column, label: Column) -> Column:
    """The nature that a line's label states against the field's, or null."""
    said, asked = F.lower(fold_accents(leading_label(line))), F.lower(fold_accents(text_of(label)))
    limit, excess, money = "massimal", "franchig|scop", "premio|imponib|impost|fattur"
    return (
        F.when(asked.rlike(excess) & said.rlike(f"^(?:{limit})"), "limit").when(asked.rlike(limit) & said.rlike(f"^(?:{excess})"), "excess")
        .when(asked.rlike(money) & said.rlike(f"^(?:{limit}|{excess})"), "structural").when(asked.rlike(f"{limit}|{excess}") & said.rlike(f"^(?:{money}|totale)"), "economic")
    )


def verify_drafts(drafts: DataFrame, cited: DataFrame, least: float = 0.35) -> DataFrame:
    """Adds ``ok`` and ``reason`` to drafts (doc_id, page, line, label, kind, value, confidence): the first failing test.

    ``cited`` holds the lines (doc_id, page, line, text), joined by their place.
    """
    joined = drafts.join(cited.withColumnRenamed("text", "_line"), ["doc_id", "page", "line"], "left")
    against = contradiction(F.col("_line"), F.col("label"))
    reason = (
        F.when(F.col("confidence") < least, "low confidence").when(F.trim(text_of(F.col("value"))) == "", "no value").when(F.col("_line").isNull(), "no such line")
        .when(~line_holds(F.col("_line"), F.col("value"), F.col("kind")), "value not on the line").when(against.isNotNull(), F.concat(F.lit("label says "), against))
        .when((F.col("kind") == "number") & parse_grouped(F.col("value")).isNull(), "no amount").when((F.col("kind") == "fiscal") & clean_fiscal_id(F.col("value")).isNull(), "bad fiscal number")
    )
    return joined.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).withColumn("snippet", F.left(F.trim("_line"), F.lit(200))).drop("_line")


def evidence_windows(fields: DataFrame, cited: DataFrame, hints: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(field_id, doc_id, page, line, snippet, score, rank): lines that hold a field's label, and hints of its kind.

    ``fields`` (field_id, label, kind) is a small dimension; hints (kind, doc_id, page, line, source, confidence).
    """
    probes = fields.select("field_id", "kind", letters_and_digits(F.col("label")).alias("_probe")).filter(F.length("_probe") >= 3)
    plain = cited.withColumn("_plain", letters_and_digits(F.col("text")))
    first = Window.partitionBy("field_id", "doc_id", "page").orderBy("line")
    by_label = plain.join(probes, F.contains(F.col("_plain"), F.col("_probe"))).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("field_id", "doc_id", "page", "line", F.col("text").alias("snippet"), F.lit(0.5).alias("affinity"), (leading_label(F.col("text")) != "").alias("labelled"))
    every = by_label
    if hints is not None:
        every = every.unionByName(hints.join(fields.select("field_id", "kind"), "kind").select("field_id", "doc_id", "page", "line", F.col("source").alias("snippet"), F.col("confidence").alias("affinity"), F.lit(True).alias("labelled")))
    strong = F.lower(leading_label(F.col("snippet"))).rlike("massimal|sinistro|franchig|scopert|premio|imponib|impost|totale|fatturate|annuo")
    scored = every.withColumn("score", F.round(F.col("affinity") + F.when(F.col("labelled"), 0.3).otherwise(0.0) + F.when(strong, 0.4).otherwise(0.0), 6))
    once = scored.groupBy("field_id", "doc_id", "page", "line", F.left("snippet", F.lit(240)).alias("snippet")).agg(F.max("score").alias("score"))
    order = Window.partitionBy("field_id").orderBy(F.desc("score"), "doc_id", "page", "line", "snippet")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def value_window(text: Column, value: Column, span: int = SPAN) -> Column:
    """The raw text around a value's first occurrence, whose letters and digits may have other characters between."""
    pattern = F.array_join(F.transform(F.filter(F.split(letters_and_digits(value), ""), lambda c: c != ""), lambda c: c), "[^A-Za-z0-9]*")
    hit = F.regexp_substr(F.lower(fold_accents(text_of(text))), pattern)
    at = F.position(hit, F.lower(fold_accents(text_of(text))))
    start = F.greatest(at - span, F.lit(1))
    return F.when((F.length(letters_and_digits(value)) >= 3) & hit.isNotNull(), F.substr(text_of(text), start, at - start + F.length(hit) + span))


def label_near(text: Column, value: Column, label: Column, span: int = SPAN) -> Column:
    """True if a word stem of the label stands within ``span`` characters of the value; also if the label has none."""
    window = letters_and_digits(value_window(text, value, span))
    found = stems(label)
    return F.when(F.size(found) == 0, F.lit(True)).otherwise(F.coalesce(F.exists(found, lambda s: F.contains(window, s)), F.lit(False)))


def value_source(values: DataFrame, docs: DataFrame, value: str = "value") -> DataFrame:
    """Adds file and page of the newest document that contains each value (docs: entity_id, file, ts, text)."""
    found = values.join(docs, "entity_id").filter(F.contains(F.col("text"), F.col(value)))
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id", "field_id").orderBy(F.desc_nulls_last("ts"), "file"))).filter("_r = 1")
    return ranked.select(*[values[c] for c in values.columns], "file", page_number(F.col("text"), F.col(value)).alias("page"))


def staged_source(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds doc_id and page of the best support for each value (entity_id, field_id, value, evidence).

    pages (entity_id, doc_id, page, text, preferred, doc_pos): evidence on a page first, preferred documents first; a
    bare value counts inside preferred documents only.
    """
    plain = pages.withColumn("_p", letters_and_digits(F.col("text")))
    e, v = letters_and_digits(F.col("evidence")), letters_and_digits(F.col("value"))
    stage = F.when((e != "") & F.contains(F.col("_p"), e), F.when(F.col("preferred"), 0).otherwise(1)).when((v != "") & F.contains(F.col("_p"), v) & F.col("preferred"), 2)
    found = values.join(plain, "entity_id").withColumn("_s", stage).filter("_s IS NOT NULL")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id", "field_id").orderBy("_s", "doc_pos", "page"))).filter("_r = 1")
    return ranked.select(*[values[c] for c in values.columns], "doc_id", "page")


def match_document(cited: DataFrame, docs: DataFrame, name: str = "name") -> DataFrame:
    """(name, doc): documents by their exact name, else without regard to case, else without extension."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", ""))
    tries = lambda c: F.array(F.concat(F.lit("0"), c), F.concat(F.lit("1"), F.lower(c)), F.concat(F.lit("2"), bare(c)))
    left = cited.select(F.col(name).alias("name"), F.explode(tries(F.col(name))).alias("_k")).distinct()
    right = docs.select(F.col("doc").alias("doc"), F.explode(tries(F.col("doc"))).alias("_k"))
    return left.join(right, "_k").groupBy("name").agg(F.min(F.struct("_k", "doc")).alias("m")).select("name", F.col("m.doc").alias("doc"))


def rank_pages(pages: DataFrame, terms: Sequence[tuple[str, int]], text: str = "text") -> DataFrame:
    """Adds ``score``: weighted counts of terms, each saturated at three; order by score, document rank and page."""
    plain = letters_and_digits(F.col(text), spaced=True)
    total = F.lit(0)
    for term, weight in terms:
        count = F.size(F.split(plain, F.lit(term))) - 1 if term.isalnum() else F.lit(0)
        total = total + F.least(count, F.lit(3)) * weight
    return pages.withColumn("score", total).orderBy(F.desc("score"), "doc_rank", "page")


def parameter_pairs(cited: DataFrame, least: float = 1000.0) -> DataFrame:
    """(doc_id, page, line, name, amount): a label and an amount on one line, or on a line and the next."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    rows = cited.withColumn("_next", F.lead("text").over(w))
    label = F.trim(F.regexp_extract("text", r"^\s*([A-ZÀ-Ù][^:\d]{3,60}?)\s*:?\s*(?:€|euro)?\s*[\d.]*(?:,\d+)?\s*€?\s*$", 1))
    amount = lambda c: parse_grouped(F.regexp_extract(c, r"([0-9][0-9.]*(?:,[0-9]+)?)\s*€?\s*$", 1))
    alone = F.col("_next").rlike(r"^\s*(?:€|euro)?\s*[0-9][0-9.]*(?:,[0-9]+)?\s*€?\s*$")
    value = F.coalesce(amount(F.col("text")), F.when(alone, amount(F.col("_next"))))
    return rows.select("doc_id", "page", "line", label.alias("name"), value.alias("amount")).filter((F.col("name") != "") & (F.col("amount") >= least))


def veto_flags(values: DataFrame, facts: DataFrame, nature: str = "nature", tolerance: float = 0.01) -> DataFrame:
    """Adds, for each amount, what its occurrences in documents say: ``seen``, ``option_only`` (on option pages only),
    ``foreign`` (only next to other natures), ``other_coverage`` (only in other coverages' documents).

    facts (entity_id, value, cats, option_page, other_coverage); the join is on rounded logarithms, so near values meet.
    """
    width = F.log(F.lit(1.0 + tolerance))
    key = lambda c: F.floor(F.log(c) / width).cast("long")
    amount = parse_pure(F.col("value"))
    rows = values.withColumn("_v", amount)
    probe = rows.filter("_v > 0").select("entity_id", "field_id", "_v", F.col(nature).alias("_n"), F.explode(F.array(*[key(F.col("_v")) + F.lit(d) for d in (-2, -1, 0, 1, 2)])).alias("_k"))
    known = facts.filter("value > 0").select("entity_id", F.col("value").alias("_f"), "cats", "option_page", "other_coverage", key(F.col("value")).alias("_k"))
    met = probe.join(known, ["entity_id", "_k"]).filter(F.abs(F.col("_f") - F.col("_v")) <= F.col("_v") * tolerance)
    said = met.groupBy("entity_id", "field_id").agg(F.count("*").alias("seen"), F.bool_and("option_page").alias("option_only"), F.bool_and((F.size("cats") > 0) & ~F.array_contains("cats", F.col("_n"))).alias("foreign"), F.bool_and("other_coverage").alias("other_coverage"))
    out = rows.join(said, ["entity_id", "field_id"], "left").drop("_v")
    return out.select(*values.columns, F.coalesce("seen", F.lit(0)).alias("seen"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("option_only", "foreign", "other_coverage")])


def option_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``option_page``: a page that looks like a form with boxes to tick."""
    t = text_of(F.col(text))
    boxes = F.size(F.regexp_extract_all(t, F.lit(r"(\[\s?[xX ]?\s?\]|☐|☑|☒|❑|□)"), 1))
    return pages.withColumn("option_page", (boxes >= 3) | t.rlike("(?i)barrare\\s+(?:la|le)\\s+casell"))


def label_categories(text: Column) -> Column:
    return categories(F.lower(text_of(text)), CATEGORIES)
