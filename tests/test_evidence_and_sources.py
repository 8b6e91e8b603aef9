"""Evidence, field kinds, models, spreadsheets and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fields, identifiers
from tallyloom.operators import evidence, resolve
from tallyloom.sources import models, xlsx
from tallyloom.streaming import rolling


def run(spark, make, rows, schema):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["y"] for r in frame.select("i", make.alias("y")).orderBy("i").collect()]


def test_digit_runs_and_amount_evidence(spark):
    rows = [("limite 4.000.000,00 euro", "4000000"), ("14000000", "4000000"), ("4.000.000,5", "4000000"), ("4.o00.000", "4000000"), ("40.000.000", "4000000"), ("123", "123"), (None, "4000")]
    assert run(spark, identifiers.has_digit_run(F.col("t"), F.col("d")), rows, "t string, d string") == [True, False, True, False, False, False, False]
    rows = [("4.000.000,00", "sono 4.000.000"), ("4.000.000,00", "sono 5.000.000"), ("4.000.000,00", None), ("text", None), ("12", "x")]
    assert run(spark, evidence.supports_amount(F.col("v"), F.col("e")), rows, "v string, e string") == [True, False, True, True, True]
    assert run(spark, evidence.supports_amount(F.col("v"), F.col("e"), True), rows, "v string, e string") == [True, False, False, True, True]


def test_supported_values(spark):
    rows = [
        ("31/12/2024", None, "fino al 31.12.2024", False, True), ("31/12/2024", "scade 2024", "polizza scade 2024 oggi", False, True), ("31/12/2024", "scade", "polizza scade oggi", False, False),
        ("12345678903", None, "P.IVA 123 456 789 03", True, True), ("1.500.000", None, "importo 1.500.000,00", False, True), ("1.500.000", None, "importo 2.500.000,00", False, False),
        ("Via Roma Milano Centro", None, "via roma 1 milano centro", False, True), ("Studio Legale Bianchi", None, "nessun nome", False, False), ("ab", "voce ab", "voce ab", False, True), ("ab", None, "ab", False, False),
    ]
    assert run(spark, evidence.supported(F.col("v"), F.col("e"), F.col("c"), F.col("f")), [r[:4] for r in rows], "v string, e string, c string, f boolean") == [r[4] for r in rows]


def test_cited_lines(spark):
    pages = spark.createDataFrame([("d", 1, "Massimale per sinistro: 500.000,00\nPremio annuo 1.200,50\nP.IVA 12345678903")], "doc_id string, page int, text string")
    cited = evidence.page_lines(pages)
    drafts = [
        ("a", "d", 1, 1, "Massimale", "number", "500.000,00", 0.9), ("b", "d", 1, 2, "Massimale", "number", "1.200,50", 0.9), ("c", "d", 1, 9, "x", "text", "v", 0.9), ("e", "d", 1, 1, "Massimale", "number", "7.000", 0.9),
        ("f", "d", 1, 3, "P.IVA", "fiscal", "12345678903", 0.9), ("g", "d", 1, 1, "x", "text", "Massimale", 0.1), ("h", "d", 1, 1, "x", "text", "", 0.9),
    ]
    out = evidence.verify_drafts(spark.createDataFrame(drafts, "field_id string, doc_id string, page int, line int, label string, kind string, value string, confidence double"), cited)
    assert {r["field_id"]: r["reason"] for r in out.collect()} == {"a": None, "b": "label says economic", "c": "no such line", "e": "value not on the line", "f": None, "g": "low confidence", "h": "no value"}
    windows = evidence.evidence_windows(spark.createDataFrame([("m", "Massimale", "k"), ("p", "Premio annuo", "k")], "field_id string, label string, kind string"), cited)
    assert {(r["field_id"], r["line"], r["rank"]) for r in windows.collect()} == {("m", 1, 1), ("p", 2, 1)}
    assert {(r["name"], r["amount"]) for r in evidence.parameter_pairs(evidence.page_lines(spark.createDataFrame([("d", 1, "Fatturato annuo\n1.500.000,00\nRetribuzioni: 25.000")], "doc_id string, page int, text string"))).collect()} == {("Fatturato annuo", 1.5e6), ("Retribuzioni", 25000.0)}


def test_windows_and_sources(spark):
    text = "x" * 300 + " Massimale annuo: 1.500.000 euro " + "y" * 300
    rows = [(text, "1500000", "Massimale"), (text, "1500000", "Franchigia"), (text, "999", "Massimale"), (text, "1500000", "di")]
    assert run(spark, evidence.label_near(F.col("t"), F.col("v"), F.col("l"), 60), rows, "t string, v string, l string") == [True, False, False, True]
    docs = spark.createDataFrame([("e", "old", 1, "uno\fdue 77"), ("e", "new", 2, "a\fb\fvale 77")], "entity_id string, file string, ts long, text string")
    values = spark.createDataFrame([("e", "f", "77"), ("e", "g", "nope")], "entity_id string, field_id string, value string")
    assert [(r["file"], r["page"]) for r in evidence.value_source(values, docs).collect()] == [("new", 3)]
    pages = spark.createDataFrame([("e", "d1", 1, "val 77", False, 0), ("e", "d2", 4, "il valore 77 x", True, 1)], "entity_id string, doc_id string, page int, text string, preferred boolean, doc_pos int")
    cited = spark.createDataFrame([("e", "f", "77", "valore 77"), ("e", "g", "val", "")], "entity_id string, field_id string, value string, evidence string")
    assert {(r["field_id"], r["doc_id"], r["page"]) for r in evidence.staged_source(cited, pages).collect()} == {("f", "d2", 4), ("g", "d2", 4)}
    names = evidence.match_document(spark.createDataFrame([("a.PDF",), ("B",), ("zz",)], "name string"), spark.createDataFrame([("A.pdf",), ("b.docx",)], "doc string"))
    assert {tuple(r) for r in names.collect()} == {("a.PDF", "A.pdf"), ("B", "b.docx")}


def test_vetoes(spark):
    values = spark.createDataFrame([("e", "f", "1.000.000", "massimale"), ("e", "g", "5.000", "premio"), ("e", "h", "text", "premio")], "entity_id string, field_id string, value string, nature string")
    facts = spark.createDataFrame([("e", 1e6, ["premio"], True, False), ("e", 1.005e6, ["franchigia"], True, False), ("e", 5000.0, [], False, True), ("x", 5000.0, ["premio"], False, False)], "entity_id string, value double, cats array<string>, option_page boolean, other_coverage boolean")
    got = {r["field_id"]: (r["seen"], r["option_only"], r["foreign"], r["other_coverage"]) for r in evidence.veto_flags(values, facts).collect()}
    assert got == {"f": (2, True, True, False), "g": (1, False, False, True), "h": (0, False, False, False)}
    assert [r["option_page"] for r in evidence.option_pages(spark.createDataFrame([(1, "[x] a [ ] b ☐ c"), (2, "none")], "i int, text string")).orderBy("i").collect()] == [True, False]


def test_kinds_of_fields(spark):
    rows = [("Massimale", ""), ("Premio annuo", "lordo"), ("Nome", ""), (None, None)]
    assert run(spark, fields.field_group(F.col("l"), F.col("d")), rows, "l string, d string") == ["structural", "economic", "other", "other"]
    assert run(spark, fields.is_periodic_document(F.col("n")), [("Quietanza 2024.pdf",), ("Polizza quietanzata",), ("quietanzata",), (None,)], "n string") == [True, False, False, False]
    assert run(spark, fields.without_examples(F.col("d")), [("Valore (es. 12) intero",), ("Nome, es. 'Rossi' e cognome",)], "d string") == ["Valore intero", "Nome e cognome"]
    assert run(spark, fields.field_kind(F.col("t"), F.col("l")), [("number", "x"), (None, "Data scadenza"), ("", "Codice fiscale"), (None, "Note")], "t string, l string") == ["number", "date", "fiscal", "text"]


def test_models_retry_and_keep_failures_apart(spark, monkeypatch):
    monkeypatch.setattr(models.time, "sleep", lambda s: None)
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError
        return x

    assert models.with_retry(flaky)("a") == "a" and len(calls) == 3

    def answer(p):
        if "bad" in p:
            raise ValueError(p)
        return p.upper()

    out = models.ask(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "i int, prompt string"), answer).orderBy("i").collect()
    assert [(r["answer"], r["error"]) for r in out] == [("OK", None), (None, "other"), ("", None)]
    vectors = models.embed(spark.createDataFrame([("a b",), ("",), (None,)], "text string")).collect()
    assert [len(r["embedding"]) for r in vectors] == [64] * 3 and sum(x * x for x in vectors[0]["embedding"]) == pytest.approx(1)


def test_spreadsheets(spark, tmp_path):
    header = ["Numero Polizza", "Movimento", "Garanzia", "Premio Netto"]
    data = xlsx.workbook_bytes("20240101", header, [["P1", "Inclusione", "RCA & co", "100"], ["007", None, "x<y", "1,234.5"], [None, None, None, None]])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    cells = xlsx.cells_of(files).cache()
    row, columns = xlsx.header_row(cells, header, ["Garanzia"], least=3)
    table = xlsx.as_table(cells, row, {h: columns[h.upper()] for h in header}).orderBy("row_id").collect()
    assert [tuple(r) for r in table] == [(2, "P1", "Inclusione", "RCA & co", "100"), (3, "007", None, "x<y", "1234.5")]
    with pytest.raises(xlsx.WorkbookError, match="headerNotFound"):
        xlsx.header_row(cells, ["Other", "Names"])
    with pytest.raises(xlsx.WorkbookError, match="missingColumns"):
        xlsx.header_row(cells, header, ["Zzz"], least=3)
    xlsx.register(spark)
    assert spark.read.format("xlsx").option("path", str(tmp_path / "in")).load().filter("num IS NOT NULL").count() == 2
    edited, skipped = xlsx.with_edits(data, [("20240101", "D2", "55"), ("20240101", "F9", "new"), ("none", "A1", "x")])
    got = {c[2]: c[3] for c in xlsx.Workbook.open(edited).cells("20240101")}
    assert got["D2"] == "55" and got["F9"] == "new" and got["A2"] == "P1" and skipped == [("none", "A1")]
    assert xlsx.choose_sheet(["x", "123"]) == "123" and xlsx.split_reference("AB12") == (28, 12) and xlsx.reference(28, 12) == "AB12"
    with pytest.raises(xlsx.WorkbookError, match="notXlsx"):
        xlsx.Workbook.open(b"nothing")
    spark.createDataFrame([("a", "1"), ("b", "02")], "k string, v string").coalesce(1).write.format("xlsx").option("path", str(tmp_path / "out")).mode("append").save()
    (written,) = (tmp_path / "out").iterdir()
    assert zipfile.is_zipfile(written) and [c[3] for c in xlsx.Workbook.open(written.read_bytes()).cells("Sheet1")] == ["k", "v", "a", "1", "b", "02"]


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    rows = [(f"e{i % 3}", "f", i, v, d, f"s{i}") for i, (v, d) in enumerate([("100", "01/01/2024"), ("120", None), ("110", "02/01/2024"), ("5", "03/01/2024"), ("4000", None), ("90", "01/01/2020"), ("", None), ("7", None), ("n", "05/05/2025")] * 3)]
    schema = "entity_id string, field_id string, seq long, value string, eff_date string, source string"
    for k in range(3):
        spark.createDataFrame(rows[k * 9 : k * 9 + 9], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    latest = {}

    def keep(batch, _):
        latest.update({r["entity_id"]: (r["value"], r["seq"]) for r in batch.collect()})

    query = rolling.rolling_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    batch = spark.createDataFrame([(*r[:4], r[4], None, r[5]) for r in rows], "entity_id string, field_id string, seq long, value string, valid_on string, doc_date string, source string")
    assert latest == {r["entity_id"]: (r["value"], r["seq"]) for r in resolve.rolling_state(batch, ["entity_id", "field_id"]).collect()}


def test_a_batch_is_written_once():
    written = []
    write = rolling.once_per_batch(lambda df, i: written.append(i), {1})
    for i in (0, 1, 2, 2):
        write(None, i)
    assert written == [0, 2]
