"""Expressions over the tables' own strings, dates and amounts, several of one family in a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, dates, identifiers, text
from ..sources.tables import table

OPTIONS = ("001", "014", "120", "A")
KEYWORDS = "Licence; the,  of\nversion ,a;THE"


def text_forms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    t = F.col("text")
    return docs.select(
        "doc_id", F.md5(text.fold_spaced(t)).alias("folded"), F.md5(text.normalise_header(F.concat(t, F.lit(" l’ora ‘x´")))).alias("header"), F.md5(text.collapse_lines(t)).alias("lines"),
        F.md5(text.alphanumeric(t)).alias("alphanumeric"), F.md5(text.safe_name(t)).alias("name"), F.md5(text.escape_xml(t)).alias("escaped"), (text.unescape_xml(text.escape_xml(t)) == t).alias("back"),
        text.last_chars(F.col("source"), 4).alias("tail"), F.md5(text.without_words(text.alphanumeric(t), text.parse_ignore_words("the, di;x\nun"))).alias("without"),
    )


def text_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    t = F.col("text")
    return docs.select(
        "doc_id", F.md5(F.array_join(text.stems(t), " ")).alias("stems"), F.md5(F.array_join(text.match_tokens(t), " ")).alias("tokens"), F.array_join(text.keyword_list(F.concat(F.lit(KEYWORDS + ";"), F.col("lang"))), "|").alias("keywords"),
        F.array_join(text.content_keywords(F.concat(F.lit(KEYWORDS + ";"), F.col("lang"))), "|").alias("content"), F.round(text.lexical_affinity(F.lit("General public license, version of the letter"), t), 9).alias("affinity"),
        text.page_number(F.regexp_replace(t, r"\. ", "\f"), F.lit("the")).alias("page"),
    )


def text_codes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    letters = text.column_letters(k % 18_278 + 1)
    template = F.concat(F.lit("Dear {{ name }}, {{c_"), (k % 3).cast("string"), F.lit("}} and {{name}}"))
    return c.select(
        "c_custkey", letters.alias("letters"), text.column_number(letters).alias("number"), text.cell_reference(F.concat(letters, k.cast("string")))["row"].alias("row"), text.cell_reference(F.concat(letters, k.cast("string")))["column"].alias("column"),
        F.array_join(text.placeholders(template), "|").alias("names"), text.advance_if_accepted(F.col("c_name"), F.when(k % 2 == 0, F.col("c_name"))).alias("advanced"),
        text.coerce_option((k % 130).cast("string"), OPTIONS).alias("option"), text.document_year(F.concat(F.lit("file_"), (k + 1990).cast("string")), F.lit("on 3/4/2021 and 5/6/2022")).alias("year"),
    )


def identifier_checks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    number = F.lpad((k * 7919 + 12_345_678_901).cast("string"), 11, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("000"), number)).when(k % 4 == 1, F.translate(number, "018", "OIB")).when(k % 4 == 2, F.concat(F.substring(number, 1, 5), F.lit(" . "), F.substring(number, 6, 6))).otherwise(F.col("c_name"))
    said = F.get(F.array(*map(F.lit, (" N/D ", "«non indicato»", "--", "vedi sopra", "value", "", "n.a.", "12.5"))), (k % 8).cast("int"))
    block = F.concat(F.lit("total "), (k * 37).cast("string"), F.when(k % 3 == 0, ",5").when(k % 3 == 1, "00").otherwise("7"), F.lit(" due"))
    code = F.concat(F.lit("rssmra"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("a01h"), F.lpad((k % 1000).cast("string"), 3, "0"), F.char(65 + k % 26))
    return c.select(
        "c_custkey", identifiers.clean_fiscal_id(raw).alias("cleaned"), identifiers.valid_fiscal_code(code).alias("code_ok"), identifiers.is_placeholder(said).alias("placeholder"),
        identifiers.is_garbage(F.concat(F.col("c_name"), F.when(k % 3 == 0, "##").when(k % 3 == 1, "#%&*!§?$£").otherwise(""))).alias("garbage"), identifiers.has_digit_run(block, (k * 37).cast("string")).alias("has_run"),
    )


def date_forms(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey")
    shown = F.when(k % 3 == 0, F.date_format("day", "d.M.yyyy")).when(k % 3 == 1, F.date_format("day", "yyyy-M-d")).otherwise(F.date_format("day", "dd-MM-yyyy"))
    other = F.when(k % 4 > 0, F.date_format(F.date_add("day", (k % 5 - 2).cast("int")), "dd/MM/yyyy"))
    page = F.concat(F.lit("Emissione 01/01/2031\nscadenza: "), F.when(k % 2 == 0, F.date_format("day", "dd/MM/yyyy")).otherwise("none"), F.lit("\nPeriodo dal 1/2/2003 al "), F.date_format(F.date_add("day", 30), "dd/MM/yyyy"), F.lit("\nvisto 05/06/2009"))
    rolled = F.concat((28 + k % 4).cast("string"), F.lit("/02/"), F.year("day").cast("string"))
    return o.select(
        "o_orderkey", dates.normalise_date(shown).alias("normalised"), dates.to_text(dates.to_date(rolled)).alias("rolled"), dates.newer_wins(F.date_format("day", "dd/MM/yyyy"), other).alias("newer"), dates.document_date(page).alias("stated"),
        dates.latest_date(page).alias("latest"), dates.to_text(dates.from_serial(F.datediff("day", F.lit("1899-12-30").cast("date")) + 0.75)).alias("serial"), dates.rome_day(F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("day").cast("timestamp"))).alias("rome"),
    )


def amount_forms(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    k, price = F.col("p_partkey"), F.col("price")
    shown = amounts.format_italian(price)
    plain = price.cast("string")
    return p.select(
        "p_partkey", amounts.round_half_up(price / 8).cast("double").alias("eighth"), F.round(amounts.loose_amount(F.concat(F.lit("circa "), shown, F.lit(" euro"))), 4).alias("loose"),
        F.transform(amounts.amounts_in(F.concat(F.lit("del 01.02.2020 "), shown, F.lit(" e 2019 poi 7,5"))), lambda x: F.round(x, 4)).alias("several"), F.round(amounts.parse_exported(F.when(k % 3 == 0, F.concat(F.lit("0"), k.cast("string"))).when(k % 3 == 1, shown).otherwise("12/03/2020")), 4).alias("exported"),
        amounts.retype_cell(F.when(k % 3 == 0, F.format_number(price, 2)).when(k % 3 == 1, plain).otherwise(F.concat(F.lit("0"), plain))).alias("retyped"), F.round(amounts.to_number(F.concat(F.lit("EUR "), shown, F.lit(" +"))), 4).alias("permissive"),
        amounts.plausible_amount(price / 20).alias("plausible"), amounts.money_text_if_present((price * 100).cast("long").cast("string"), F.concat(F.lit("pays "), shown)).alias("as_text"),
    )


QUERIES = {f.__name__: f for f in (text_forms, text_tokens, text_codes, identifier_checks, date_forms, amount_forms)}

_SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_FOLD = "lower(strip_accents({0}))"
_LIST = "list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: len(w) >= {1})"
_LETTERS = "CASE WHEN n > 702 THEN chr(65 + ((n - 703) // 676 % 26)::INT) ELSE '' END || CASE WHEN n > 26 THEN chr(65 + ((n - 27) // 26 % 26)::INT) ELSE '' END || chr(65 + ((n - 1) % 26)::INT)"
_DIGIT = "CASE WHEN i % 2 = 1 THEN code[i]::INT WHEN code[i]::INT > 4 THEN code[i]::INT * 2 - 9 ELSE code[i]::INT * 2 END"
_ODD = list(identifiers.ODD_PLACES)
_ITALIAN = "translate(format('{{:,.2f}}', {0}::DOUBLE), ',.', '.,')"
_DAY = "strftime({0}, '%d/%m/%Y')"
ORACLES = {
    "text_forms": rf"""WITH t AS (SELECT doc_id, source, text, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS a FROM documents)
      SELECT doc_id, md5({_SQUEEZE.format(_FOLD.format('text'))}) AS folded, md5(upper({_SQUEEZE.format("translate(replace(text, 'ß', 'SS') || ' l’ora ‘x´', '‘’ʼ´`', '''''''''''')")})) AS header,
        md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_SQUEEZE.format('x')}), chr(10))) AS lines, md5(a) AS alphanumeric,
        md5(left(regexp_replace(regexp_replace(strip_accents(text), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 80)) AS name,
        md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped, true AS back,
        right(source, 4) AS tail, md5(replace(replace(replace(a, 'THE', ''), 'DI', ''), 'UN', '')) AS without FROM t""",
    "text_tokens": rf"""WITH t AS (SELECT doc_id, lang, text, {_FOLD.format('text')} AS f FROM documents),
      w AS (SELECT *, {_LIST.format('f', 3)} AS tokens, list_transform({_LIST.format('f', 5)}, lambda x: left(x, 7)) AS s, ['general', 'public', 'license', 'version', 'letter'] AS d FROM t)
      SELECT doc_id, md5(coalesce(array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: list_position(s, s[i]) = i), lambda i: s[i]), ' '), '')) AS stems, md5(coalesce(array_to_string(tokens, ' '), '')) AS tokens,
        'licence|the|of|version|a' || CASE WHEN lang IS NULL THEN '' ELSE '|' || lower(lang) END AS keywords, 'Licence|the|version|THE' AS content, round(len(list_filter(d, lambda x: contains(f, x))) / 5.0, 9)::DOUBLE AS affinity,
        CASE WHEN contains(text, 'the') THEN len(string_split(left(replace(text, '. ', chr(12)), strpos(replace(text, '. ', chr(12)), 'the') - 1), chr(12)))::INT END AS page FROM w""",
    "text_codes": rf"""WITH c AS (SELECT c_custkey, c_name, c_custkey % 18278 + 1 AS n, (c_custkey % 130)::VARCHAR AS o FROM customer), l AS (SELECT *, {_LETTERS} AS letters FROM c)
      SELECT c_custkey, letters, n::BIGINT AS number, c_custkey::INT AS row, letters AS "column", 'name|c_' || (c_custkey % 3) AS names,
        CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE regexp_extract(c_name, '^(.*?)(\d+)$', 1) || lpad((regexp_extract(c_name, '(\d+)$', 1)::BIGINT + 1)::VARCHAR, len(regexp_extract(c_name, '(\d+)$', 1))::INT, '0') END AS advanced,
        CASE o WHEN '1' THEN '001' WHEN '14' THEN '014' ELSE o END AS option, CASE WHEN c_custkey + 1990 BETWEEN 2000 AND 2099 THEN c_custkey + 1990 ELSE 2021 END::INT AS year FROM l""",
    "identifier_checks": rf"""WITH c AS (SELECT c_custkey AS k, c_name, lpad((c_custkey * 7919 + 12345678901)::VARCHAR, 11, '0') AS code, (c_custkey * 37)::VARCHAR AS digits,
        'RSSMRA' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || 'A01H' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || chr(65 + (c_custkey % 26)::INT) AS f FROM customer),
      s AS (SELECT *, list_sum(list_transform(range(1, 11), lambda i: {_DIGIT})) AS t, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN {_ODD}[CASE WHEN ascii(f[i]) < 58 THEN ascii(f[i]) - 47 ELSE ascii(f[i]) - 54 END]
        WHEN ascii(f[i]) < 58 THEN ascii(f[i]) - 48 ELSE ascii(f[i]) - 65 END)) AS u FROM c)
      SELECT k AS c_custkey, CASE WHEN k % 4 < 3 AND (10 - t % 10) % 10 = code[11]::INT AND len(list_distinct(string_split(code[1:10], ''))) > 1 THEN code END AS cleaned, ascii(f[16]) = 65 + u % 26 AS code_ok,
        k % 8 NOT IN (4, 7) AS placeholder, k % 3 < 2 AS garbage, len(digits) >= 4 AND k % 3 < 2 AS has_run FROM s""",
    "date_forms": rf"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day FROM orders), p AS (SELECT *, CASE WHEN k % 4 > 0 THEN day + (k % 5 - 2)::INT END AS other FROM o)
      SELECT k AS o_orderkey, {_DAY.format('day')} AS normalised, {_DAY.format("make_date(year(day), 2, 1) + (27 + k % 4)::INT")} AS rolled, coalesce(other >= day, false) AS newer, {_DAY.format('CASE WHEN k % 2 = 0 THEN day ELSE day + 30 END')} AS stated,
        {_DAY.format("greatest(CASE WHEN k % 2 = 0 AND year(day) >= 2000 THEN day END, CASE WHEN year(day + 30) >= 2000 THEN day + 30 END, DATE '2009-06-05')")} AS latest, {_DAY.format('day')} AS serial,
        strftime(timezone('Europe/Rome', timezone('UTC', day + to_hours((k % 24)::INT))), '%Y%m%d') AS rome FROM p""",
    "amount_forms": rf"""WITH p AS (SELECT p_partkey AS k, p_retailprice::DECIMAL(18,2) AS price FROM part)
      SELECT k AS p_partkey, round(price::DECIMAL(28,10) / 8, 2)::DOUBLE AS eighth, price::DOUBLE AS loose, [price::DOUBLE, 7.5::DOUBLE] AS several, CASE WHEN k % 3 = 1 THEN price::DOUBLE END AS exported,
        CASE WHEN k % 3 < 2 THEN price::DOUBLE END AS retyped, price::DOUBLE AS permissive, price / 20 > 50 AS plausible, {_ITALIAN.format('price')} AS as_text FROM p""",
}
