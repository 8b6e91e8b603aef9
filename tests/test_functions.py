"""Expression libraries on literal rows."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import amounts, conditions, dates, formula, identifiers, rules, text


@pytest.fixture(scope="module")
def value(spark):
    """Evaluate an expression for each of some inputs."""

    def run(make, inputs, kind="string"):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_keys(value):
    inputs = ["000123", "0000", " a b.c'd ", "x y", None, "", "12-34 567"]
    assert value(lambda c: text.normalise_key(c), inputs) == ["123", "0000", "ABCD", "XY", "", "", "12-34567"]
    assert value(lambda c: text.normalise_key(c, "digits_only"), inputs)[-1] == "1234567"
    assert value(lambda c: text.normalise_key(c, "last4"), inputs)[-1] == "4567"
    assert value(lambda c: text.normalise_key(c, "letters_only"), [" a1-bà"]) == ["AB"]
    with pytest.raises(ValueError):
        text.normalise_key(F.col("x"), "nope")


def test_labels_and_folding(value):
    assert value(text.normalise_label, ["Calamità  Naturali", "A-B/c_d:e;f", None]) == ["calamita naturali", "a b c d e f", ""]
    assert value(lambda c: text.letters_and_digits(c, spaced=True), ["  Éà—1 2,x "]) == ["ea 1 2 x"]
    assert value(text.collapse_lines, [" a   b \n  c"]) == ["a b\nc"]
    assert value(text.useful_length, ["a    b"]) == [3]
    assert text.parse_ignore_words("totale, srl; x\nTotale") == ["TOTALE", "SRL"]
    assert value(lambda c: text.char_grams(c, 3), ["abcabc", "ab", ""]) == [["abc", "bca", "cab"], [], []]
    assert value(text.placeholders, ["{{a}} x {{ b }} {{a}}"]) == [["a", "b"]]
    assert value(text.keyword_list, ["A; b,\na ,, c"]) == [["a", "b", "c"]]


def test_identifiers_and_numbering(value):
    assert value(text.next_identifier, ["W0000001", "S099", "999", "ABC", "A9B", None]) == ["W0000002", "S100", "1000", "ABC", "A10B", ""]
    assert value(identifiers.valid_vat, ["12345678903", "12345678900", "00000000000", "1234567890", None]) == [True, False, False, False, False]
    assert value(identifiers.valid_fiscal_code, ["RSSMRA80A01H501U", "rssmra80a01h501u", "RSSMRA80A01H501X", "x"]) == [True, True, False, False]
    assert value(identifiers.clean_fiscal_id, ["123.456 789-03", "0000012345678903", "I2345678903", "RSSMRA80A01H501U", "x", None]) == ["12345678903", "12345678903", "12345678903", "RSSMRA80A01H501U", None, None]
    assert value(identifiers.is_placeholder, ["N/D", " «non indicato» ", "---", "vedi art. 3", "Rossi", None, ""]) == [True, True, True, True, False, True, True]
    assert value(identifiers.is_garbage, ["AB]]12", "AB12", "a-b-c", None]) == [True, False, True, False]
    assert value(text.column_letters, [1, 26, 27, 703], "int") == ["A", "Z", "AA", "AAA"]
    assert value(text.column_number, ["A", "Z", "AA", "AAA"]) == [1, 26, 27, 703]
    assert value(lambda c: text.coerce_option(c, ["001", "010", "A"]), ["1", "10", "A", "7", None]) == ["001", "010", "A", "7", ""]


def test_amounts(value):
    read = ["277,90", "1.234,56", "3.7", "€ 110,26", "-45,10", "1,234.56", "(12,5)", "12 abc", "", "-", None]
    assert value(amounts.parse_amount, read) == [277.9, 1234.56, 3.7, 110.26, -45.1, 1234.56, -12.5, 12.0, None, None, None]
    assert value(amounts.parse_grouped, ["7.500.000,00", "20.000", "10689,58", "4.000.000.00", "10689.58", "abc", "Euro 5,5"]) == [7500000, 20000, 10689.58, 4000000, 10689.58, None, 5.5]
    assert value(amounts.parse_pure, ["4.000.000,00", "10.000", "2,5", "12/3", "5 %", None]) == [4e6, 1e4, 2.5, None, None, None]
    assert value(amounts.amounts_in, ["del 31.12.2025 anno 2024: 1.000,50 e 7"]) == [[1000.5, 7.0]]
    assert value(amounts.retype_cell, ["12", "007", "1,234.5", "0.5", "12345678901234567890", "x"]) == [12, None, 1234.5, 0.5, None, None]
    assert value(lambda c: amounts.format_italian(c.cast("decimal(18,2)")), ["1234567.5", "-3"]) == ["1.234.567,50", "-3,00"]


@pytest.mark.parametrize(("net", "rate", "up", "even"), [(23, 0.135, 26.11, 26.10), (187, 0.135, 212.25, 212.24), (795, 0.135, 902.33, 902.32), (891, 0.135, 1011.29, 1011.28), (145, 0.135, 164.58, 164.58), (-23, 0.135, -26.11, -26.10)])
def test_rounding_of_ties(value, net, rate, up, even):
    (a,) = value(lambda c: amounts.apply_rate(c, F.lit(rate)), [net], "int")
    (b,) = value(lambda c: amounts.apply_rate(c, F.lit(rate), "half_even"), [net], "int")
    assert (float(a), float(b)) == (up, even)


def test_dates(value):
    assert [str(x) if x else None for x in value(dates.to_date, ["31/02/2024", "1-2-2024", "2024-12-31T10", "31/12/24", None])] == ["2024-03-02", "2024-02-01", "2024-12-31", None, None]
    assert value(dates.add_years, ["29/02/2024", "x", None]) == ["28/02/2025", "x", ""]
    assert value(dates.normalise_date, ["1.2.2024", "2024-1-2", "31/02/2024", "32/01/2024", "1/13/2024"]) == ["01/02/2024", "02/01/2024", "31/02/2024", None, None]
    pages = ["Emesso il 01/01/2025\nPERIODO 01/01/2024 - 31/12/2024", "SCADENZA: 31/12/2025\nstampato 02/02/2026", "emissione 05/05/2025\nil 03/03/2021 e 04.04.2022", ""]
    assert value(dates.document_date, pages) == ["31/12/2024", "31/12/2025", "04/04/2022", None]
    pairs = [("31/12/2023", "31/12/2025"), ("31/12/2024", None), (None, "01/01/2020"), ("31/12/2024", "01/01/2024"), (None, None)]
    assert value(lambda c: dates.newer_wins(c["_1"], c["_2"]), pairs, "struct<_1:string,_2:string>") == [True, False, True, False, True]
    assert value(lambda c: dates.rome_day(c.cast("timestamp")), ["2024-06-30 22:30:00", "2024-12-31 22:59:00"]) == ["20240701", "20241231"]


def test_formula(value):
    run = lambda source, x: value(lambda c: formula.compile_formula(source, {"Prezzo": c}), [x])[0]
    assert run("prezzo * 2 + 1", "3,5") == 8 and run("max(1,2)", "0") == 1.2 and run("max(1, 2)", "0") == 2
    assert run("2 - 3 - 4", "0") == -5 and run("-(2 + 3) * 2 % 4", "0") == -2 and run("missing + 1", "0") == 1
    assert run("1 / prezzo", "0") is None and run("min(1 / prezzo, 5)", "0") is None and run("round(2.5) + round(-2.5)", "0") == 1
    for bad in ("", "1 +", "2 ** 3", "foo(1)", "(1", "1)", "a b"):
        assert not formula.is_valid(bad)


@given(st.recursive(st.integers(1, 9).map(str), lambda e: st.tuples(e, st.sampled_from(["+", "-", "*"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | st.tuples(e, st.sampled_from(["+", "-", "*"]), e).map(" ".join), max_leaves=8))
@settings(max_examples=60, deadline=None)
def test_formula_precedence(source):
    def run(n):
        if n.kind == "num":
            return n.value
        a, b = map(run, n.parts)
        return {"+": a + b, "-": a - b, "*": a * b}[n.kind]

    assert math.isclose(run(formula.parse(source)), eval(source))  # noqa: S307


def test_conditions_fold_from_the_left(spark):
    c = [conditions.Condition("a", "a", "equals"), conditions.Condition("b", "b", "equals", connector="OR"), conditions.Condition("c", "c", "equals", connector="AND")]
    row = spark.createDataFrame([("x", "y", "z")], "a string, b string, c string")
    at = lambda **k: lambda name: F.lit(k.get(name, "no"))
    test = lambda right: row.select(conditions.predicate(c, F.col, right)).first()[0]
    assert not test(at(a="x")) and test(at(a="x", c="z")) and test(at(b="y", c="z")) and not test(at(c="z"))
    assert conditions.required_equalities(c) == [c[2]]
    assert not row.select(conditions.fold([], lambda x: F.lit(True))).first()[0]
    assert conditions.all_negative([conditions.Condition("a", "a", "not_equals")]) and not conditions.all_negative([])


@pytest.mark.parametrize("mode", conditions.MODES)
def test_empty_sides_satisfy_nothing(spark, mode):
    rows = spark.createDataFrame([("", "x"), ("x", ""), ("", "")], "a string, b string")
    assert not any(r[0] for r in rows.select(conditions.compare_values(F.col("a"), F.col("b"), mode)).collect())


def test_saved_configuration_round_trip():
    saved = {"keys": [{"label": "k", "column_a": "a", "column_b": "b", "unknown": 1}], "gram": 5, "title": "t", "fuzzy": None}
    config = conditions.CompareConfig.from_dict(saved)
    assert config.keys[0].transform == "default" and config.gram == 5 and config.broad_gram == 6 and config.fuzzy is False
    assert conditions.CompareConfig.from_dict(config.to_dict()) == config and config.to_dict()["title"] == "t"


def test_ordered_rules(value):
    table = [rules.Rule("rca", 1), rules.Rule("^infortun", 2, True)]
    assert value(lambda c: rules.lookup(c, table, 0), ["rca", "infortuni", "x", None]) == [1, 2, 0, 0]
    assert value(lambda c: rules.categories(c, {"a": ["x"], "b": ["y", "z"]}), ["xz", "q"]) == [["a", "b"], []]
