"""From raw proposals to candidates: cleaning of values, the ladder of reasons to reject one, and merges of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_grouped, parse_pure
from ..functions.dates import labelled_date, normalise_date
from ..functions.fields import field_kind, premium_from_other_coverage
from ..functions.identifiers import clean_fiscal_id, is_garbage, is_placeholder
from ..functions.text import WORD_END, WORD_START, fold_accents, letters_and_digits, squeeze, strip, text_of
from .evidence import supported

#: Phrases of headings and clauses, on folded lower-case text.
HEADINGS = (
    WORD_START + r"il\s+contraente" + WORD_END, WORD_START + r"l\s?assicurato" + WORD_END, WORD_START + r"contratto\s+di\s+assicurazione" + WORD_END,
    WORD_START + r"polizza\s+di\s+assicurazione" + WORD_END, WORD_START + r"ramo\s+di\s+competenza" + WORD_END, WORD_START + r"centri\s+diagnostici" + WORD_END,
    r"^(?:sezione|garanzia|estensione)s?" + WORD_END, WORD_START + r"scoperto\s+generale" + WORD_END, WORD_START + r"tacito\s+rinnovo" + WORD_END,
    WORD_START + "frazionamento" + WORD_END, WORD_START + "esclusioni" + WORD_END, WORD_START + r"condizioni\s+particolari" + WORD_END,
    WORD_START + r"franchigia\s+(?:base|frontale)" + WORD_END, WORD_START + r"massimale\s+annuo" + WORD_END, WORD_START + r"massimale\s+per\s+sinistro" + WORD_END,
)
#: Fixed value: labels of fields that hold document numbers.
DOCUMENT_NUMBER = r"numero\s+(?:di\s+|della\s+|del\s+)?(?:polizz|propost|preventiv|appendic|contratt|adesion)|n[°.]?\s*(?:polizz|propost|preventiv|appendic)"


def is_label_like(c: Column) -> Column:
    """True for values that are headings: half of three or more words in long capitals, or a known phrase."""
    v = strip(text_of(c))
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    capitals = F.filter(words, lambda w: w.rlike("^[A-ZÀ-Ý]{6,}$"))
    plain = squeeze(F.regexp_replace(F.lower(fold_accents(v)), r"[^a-z0-9\s]+", " "))
    loud = (F.size(words) >= 3) & (F.size(capitals) >= 1) & (F.size(capitals) >= F.size(words) * 0.5)
    return (F.length(v) >= 4) & (loud | plain.rlike("|".join(f"(?:{p})" for p in HEADINGS)))


def is_zero(c: Column) -> Column:
    return F.regexp_replace(strip(text_of(c)), r"[€\s]", "").rlike(r"^0+(?:[.,]0+)?$")


def is_number_only(c: Column) -> Column:
    s = strip(text_of(c))
    return s.rlike(r"^[-+]?[\d.,\s€%‰']+$") & (parse_pure(s).isNotNull() | s.rlike(r"^[-+]?\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?$") | s.rlike(r"^[-+]?\d+(?:[.,]\d+)?[%‰]?$"))


def clean_value(value: Column, label: Column, description: Column, kind: Column) -> Column:
    """A field's value in its normal form, or null where it cannot be one.

    In order: placeholders; zeros and bare numbers of text fields; headings; the field's own label; a euro sign is cut;
    garbled document numbers; dates and fiscal numbers by their rules; percentages where an amount is asked for.
    """
    v = F.regexp_replace(strip(text_of(value)), r"(?i)^(?:€|EUR)\s*([\d.,]+)$", "$1")
    said = F.lower(fold_accents(F.concat_ws(" ", text_of(label), text_of(description))))
    textual = kind.isin("text", "boolean", "enum")
    plain = letters_and_digits(v)
    none = F.lit(None).cast("string")
    return (
        F.when(is_placeholder(v), none).when(textual & (is_zero(v) | is_number_only(v)), none).when(is_label_like(v), none)
        .when((plain != "") & (plain == letters_and_digits(label)), none).when(is_garbage(v) & said.rlike(DOCUMENT_NUMBER), none)
        .when(kind == "date", normalise_date(v)).when(said.rlike(r"p\s*\.?\s*iva|cod\.?\s*fiscale|codice fiscale|partita iva"), clean_fiscal_id(v))
        .when(said.rlike("parametro") & v.rlike(r"^[\d\s.,]+[%‰]?$"), none).when(said.rlike(WORD_START + "tass"), F.regexp_replace(v, r"\s*[‰%]\s*$", ""))
        .when(said.rlike("massimale|premio|imposta|importo|scoperto|franchig") & v.rlike(r"[%‰]\s*$"), none).otherwise(v)
    )


def absorb(proposals: DataFrame, fields: DataFrame, context: Column) -> DataFrame:
    """Adds ``cleaned``, ``eff_date`` and ``reject_reason`` to proposals (field_id, value, evidence, valid_on, file, ...).

    fields (field_id, label, description, type); ``context`` is the text that the proposal was read from.  The first
    failing test names the reason; null means that the proposal is a candidate.
    """
    rows = proposals.join(fields.select("field_id", F.col("label").alias("_l"), F.col("description").alias("_d"), F.col("type").alias("_t"), F.lit(True).alias("_known")), "field_id", "left")
    kind = field_kind(F.col("_t"), F.col("_l"))
    rows = rows.withColumn("_kind", kind).withColumn("cleaned", clean_value(F.col("value"), F.col("_l"), F.col("_d"), F.col("_kind")))
    fiscal = F.lower(F.concat_ws(" ", "_l", "_d")).rlike("fiscale|iva")
    reason = (
        F.when(F.col("_known").isNull(), "unknown field").when(strip(text_of(F.col("value"))) == "", "empty").when(is_placeholder(F.col("value")), "placeholder")
        .when(F.col("cleaned").isNull() | (F.col("cleaned") == ""), "cleaned away").when(~supported(F.col("cleaned"), F.col("evidence"), context, fiscal), "no evidence")
        .when(premium_from_other_coverage(F.col("_l"), F.col("_d"), F.col("file")), "premium of another coverage")
    )
    valid = normalise_date(F.col("valid_on"))
    stated = F.when(F.contains(letters_and_digits(context), F.replace(valid, F.lit("/"), F.lit(""))), valid)
    effective = F.coalesce(stated, F.when(F.col("_kind") == "date", F.col("cleaned")), F.col("doc_date"))
    return rows.withColumn("reject_reason", reason).withColumn("eff_date", effective).drop("_l", "_d", "_t", "_known", "_kind")


def rejection_counts(absorbed: DataFrame) -> DataFrame:
    return absorbed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def merge_extractions(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("entity_id", "field_id")) -> DataFrame:
    """Full outer merge of two extractions; the first one's value wins."""
    b = second.withColumnRenamed("value", "_other")
    return first.join(b, list(keys), "full").select(*keys, F.coalesce("value", "_other").alias("value"))


def initial_state(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """An empty state for each entity and field; fields are a small dimension."""
    return entities.select("entity_id").distinct().join(fields.select("field_id").distinct(), F.lit(True)).select("entity_id", "field_id", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("eff_date"), F.lit(None).cast("string").alias("source"))


def flat_state(state: DataFrame) -> DataFrame:
    """(entity_id, data, sources): maps of the filled fields and of where they come from."""
    filled = state.filter(strip(text_of(F.col("value"))) != "")
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", c))))
    return filled.groupBy("entity_id").agg(pairs("value").alias("data"), pairs("source").alias("sources"))


def excess_guard(values: DataFrame, fields: DataFrame, weak: str = "scoperto", strong: str = "franchigia") -> DataFrame:
    """Adds ``action`` and ``target`` for values (entity_id, field_id, value) by the fields' natures (field_id, nature, ord).

    A weak value that a strong field also has is cleared.  A weak value in an entity without any strong value moves to
    the first strong field, for values whose context says so (``says_strong``); without such a field it is cleared.
    """
    rows = values.join(fields.select("field_id", "nature"), "field_id", "left").withColumn("_c", F.round(parse_grouped(F.col("value")) * 100).cast("long"))
    same, whole = Window.partitionBy("entity_id", "_c"), Window.partitionBy("entity_id")
    is_strong = F.coalesce((F.col("nature") == strong) & F.col("_c").isNotNull(), F.lit(False))
    rows = rows.withColumn("_shared", F.bool_or(is_strong).over(same)).withColumn("_any", F.bool_or(is_strong).over(whole))
    home = fields.filter(F.col("nature") == strong).orderBy("ord").limit(1).collect()
    target = F.lit(home[0]["field_id"] if home else None).cast("string")
    is_weak = F.coalesce((F.col("nature") == weak) & F.col("_c").isNotNull(), F.lit(False))
    moves = is_weak & ~F.col("_any") & F.coalesce("says_strong", F.lit(False))
    action = F.when(is_weak & F.col("_shared"), "clear").when(moves & target.isNotNull(), "move").when(moves, "clear").otherwise("keep")
    return rows.withColumn("action", action).withColumn("target", F.when(F.col("action") == "move", target)).drop("_c", "_shared", "_any", "nature")


def coverage_dates(pages: DataFrame, starts: Sequence[str], ends: Sequence[str], text: str = "text", reach: int = 100) -> DataFrame:
    """(entity_id, start, end): the earliest date after a start label and the latest after an end label."""
    day = lambda label: F.to_date(labelled_date(F.col(text), label, reach), "dd/MM/yyyy")
    found = pages.select("entity_id", F.array_compact(F.array(*map(day, starts))).alias("s"), F.array_compact(F.array(*map(day, ends))).alias("e"))
    dates = found.groupBy("entity_id").agg(F.min(F.array_min("s")).alias("start"), F.max(F.array_max("e")).alias("end"))
    return dates.select("entity_id", F.date_format("start", "dd/MM/yyyy").alias("start"), F.date_format("end", "dd/MM/yyyy").alias("end"))


def placeholder_status(fields: DataFrame, placeholders: DataFrame, automatic: Sequence[str] = ()) -> DataFrame:
    """Adds ``status`` to fields (field_id, docx): unset, ok or mismatch against a template's placeholders (name).

    Without an inventory every placeholder is ok.
    """
    names = placeholders.select(F.col("name").alias("_n")).distinct()
    any_ = not names.isEmpty()
    joined = fields.join(names, F.trim(F.coalesce("docx", F.lit(""))) == F.col("_n"), "left")
    docx = F.trim(F.coalesce("docx", F.lit("")))
    ok = F.col("_n").isNotNull() | (docx.isin(*automatic) if automatic else F.lit(False)) | F.lit(not any_)
    return joined.withColumn("status", F.when(docx == "", "unset").when(ok, "ok").otherwise("mismatch")).drop("_n")


def unmapped_placeholders(placeholders: DataFrame, fields: DataFrame, automatic: Sequence[str] = ()) -> DataFrame:
    used = fields.select(F.trim("docx").alias("name")).filter("name <> ''").distinct()
    rest = placeholders.join(used, "name", "left_anti")
    return rest.filter(~F.col("name").isin(*automatic)) if automatic else rest


def document_pieces(docs: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """(doc_id, piece, text, periodic): texts cut at fixed places, for next-fit batches afterwards."""
    count = F.ceil(F.length(text) / F.lit(budget)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substr(F.col(text), i * budget + 1, F.lit(budget)))
    return docs.filter(F.length(text) > 0).select("doc_id", F.posexplode(pieces).alias("piece", "text"), "periodic")
