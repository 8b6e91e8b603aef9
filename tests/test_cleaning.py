"""Cleaning of values, rejection reasons and merges."""

from pyspark.sql import functions as F

from tallyloom.operators import cleaning


def test_values_are_cleaned_by_kind(spark):
    rows = [
        ("n/d", "Nome", "", "text", None), ("0,00", "Attività", "", "text", None), ("1.500", "Attività", "", "text", None), ("IL CONTRAENTE", "Nome", "", "text", None), ("Nome", "Nome", "", "text", None),
        ("€ 1.500,00", "Massimale", "", "number", "1.500,00"), ("AB]]--12", "Numero polizza", "", "text", None), ("1/2/2024", "Data", "", "date", "01/02/2024"), ("123.456.789-03", "Partita IVA", "", "fiscal", "12345678903"),
        ("12 %", "Tasso", "", "percent", "12"), ("10%", "Premio", "", "number", None), ("Rossi Mario", "Nome", "", "text", "Rossi Mario"), (None, "Nome", "", "text", None),
    ]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, v string, l string, d string, k string")
    got = [r["y"] for r in frame.select("i", cleaning.clean_value(*map(F.col, "vldk")).alias("y")).orderBy("i").collect()]
    assert got == [r[4] for r in rows]


def test_reasons(spark):
    fields = spark.createDataFrame([("n", "Nome", "", "text"), ("m", "Massimale", "", "number"), ("p", "Premio annuo", "", "number"), ("d", "Data scadenza", "", "date")], "field_id string, label string, description string, type string")
    rows = [
        (1, "n", "Rossi Mario", "", None, "a.pdf", None), (2, "n", "Bianchi Luigi", "", None, "a.pdf", None), (3, "zz", "x", "", None, "a.pdf", None), (4, "n", " ", "", None, "a.pdf", None), (5, "n", "n.d.", "", None, "a.pdf", None),
        (6, "m", "10%", "", None, "a.pdf", None), (7, "p", "1.200,00", "", "01/01/2024", "certificato.pdf", None), (8, "m", "1.200,00", "", "31/12/2024", "a.pdf", "01/01/2020"), (9, "d", "31/12/2024", "", None, "a.pdf", "01/01/2020"),
    ]
    frame = spark.createDataFrame(rows, "i int, field_id string, value string, evidence string, valid_on string, file string, doc_date string")
    out = cleaning.absorb(frame, fields, F.lit("Il sig. ROSSI MARIO paga 1.200,00 fino al 31/12/2024"))
    got = {r["i"]: (r["reject_reason"], r["eff_date"]) for r in out.collect()}
    assert {i: x[0] for i, x in got.items()} == {1: None, 2: "no evidence", 3: "unknown field", 4: "empty", 5: "placeholder", 6: "cleaned away", 7: "premium of another coverage", 8: None, 9: None}
    assert got[8][1] == "31/12/2024" and got[9][1] == "31/12/2024" and got[7][1] is None
    assert {r["outcome"]: r["n"] for r in cleaning.rejection_counts(out).collect()}["accepted"] == 3


def test_merges_and_guards(spark):
    a = spark.createDataFrame([("e", "x", "1"), ("e", "y", None)], "entity_id string, field_id string, value string")
    b = spark.createDataFrame([("e", "x", "2"), ("e", "y", "3"), ("e", "z", "4")], "entity_id string, field_id string, value string")
    assert {(r["field_id"], r["value"]) for r in cleaning.merge_extractions(a, b).collect()} == {("x", "1"), ("y", "3"), ("z", "4")}
    fields = spark.createDataFrame([("s", "scoperto", 1), ("f", "franchigia", 2), ("g", "franchigia", 3)], "field_id string, nature string, ord int")
    values = spark.createDataFrame([("a", "s", "10.000", True), ("a", "f", "10.000,00", False), ("b", "s", "500", True), ("c", "s", "500", False)], "entity_id string, field_id string, value string, says_strong boolean")
    assert {(r["entity_id"], r["field_id"]): (r["action"], r["target"]) for r in cleaning.excess_guard(values, fields).collect()} == {("a", "s"): ("clear", None), ("a", "f"): ("keep", None), ("b", "s"): ("move", "f"), ("c", "s"): ("keep", None)}
    pages = spark.createDataFrame([("e", "Decorrenza: 01/02/2024"), ("e", "DECORRENZA 01/01/2024 scadenza: 31/12/2024"), ("e", "scadenza 30/06/2024")], "entity_id string, text string")
    assert tuple(cleaning.coverage_dates(pages, ["decorrenza"], ["scadenza"]).first()) == ("e", "01/01/2024", "31/12/2024")
    slots = cleaning.placeholder_status(spark.createDataFrame([("a", "x"), ("b", None), ("c", "zz"), ("d", "auto")], "field_id string, docx string"), spark.createDataFrame([("x",), ("y",)], "name string"), ["auto"])
    assert {r["field_id"]: r["status"] for r in slots.collect()} == {"a": "ok", "b": "unset", "c": "mismatch", "d": "ok"}
    pieces = cleaning.document_pieces(spark.createDataFrame([(1, "abcdefg", True), (2, "", False)], "doc_id int, text string, periodic boolean"), 3).collect()
    assert [(r["piece"], r["text"]) for r in pieces] == [(0, "abc"), (1, "def"), (2, "g")]
    state = cleaning.flat_state(spark.createDataFrame([("e", "x", "1", "f"), ("e", "y", " ", "f")], "entity_id string, field_id string, value string, source string")).first()
    assert state["data"] == {"x": "1"} and state["sources"] == {"x": "f"}
