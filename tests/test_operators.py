"""Premiums, records, jobs, paths, conflicts, search, documents and scores on literal rows."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom import storage
from tallyloom.operators import documents, jobs, paths, premium, records, resolve, scoring, search
from tallyloom.plans import dossiers as dossier_plans
from tallyloom.sources import sinks, tables

LINES = "row_id long, policy_no string, movement string, guarantee string, net_premium string"


def test_totals_stand_on_the_last_calculable_row(spark):
    data = [
        (0, "P1", "Inclusione Applicazione", "RCA", "100"), (1, "P2", "inclusione-applicazione", "RCA", "200"), (2, "P1", "Inclusione Applicazione", "Cristalli", "100"),
        (3, "P1", "Quietanza Intermedia", "RCA", "100"), (4, "P2", "Inclusione Applicazione", "Cristalli", "200"), (5, "P1", "Inclusione Applicazione", "Cristalli", "-"),
    ]
    out = {r["row_id"]: (r["gross"] and float(r["gross"]), r["total"] and float(r["total"])) for r in premium.compute(spark.createDataFrame(data, LINES)).collect()}
    assert out == {0: (126.5, None), 1: (253.0, None), 2: (113.5, 240.0), 3: (None, None), 4: (227.0, 480.0), 5: (None, None)}


def test_worked_example_and_checks(spark):
    nets = ["3.7", "110.26", "5.46", "4.92", "120.76", "15.12", "13.6", "11.12", "43.62", "3.26", "134.2", "36"]
    kinds = ["cristalli", "assistenza in viaggio"] + ["incendio"] * 8 + ["rca", "tutela legale base"]
    data = [(i, " A ", "Inclusione Applicazione", k, n) for i, (n, k) in enumerate(zip(nets, kinds, strict=True))]
    out = premium.compute(spark.createDataFrame(data, LINES))
    assert [float(r["gross"]) for r in out.orderBy("row_id").collect()] == [4.2, 121.29, 6.2, 5.58, 137.06, 17.16, 15.44, 12.62, 49.51, 3.7, 169.76, 40.5]
    assert float(premium.grand_total(out).first()[0]) == 583.02
    assert all(r["ok"] for r in premium.integrity(out).collect())
    spoilt = out.withColumn("total", F.when(F.col("row_id") == 3, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("total")))
    assert {r["name"] for r in premium.integrity(spoilt).filter("NOT ok").collect()} == {"one_total"}
    unknown = spark.createDataFrame([(0, "P", "Inclusione Applicazione", "Novità", "1"), (1, "P", "Inclusione Applicazione", None, "1")], LINES)
    assert {(r["label"], r["n"], tuple(r["examples"])) for r in premium.unknown_labels(premium.compute(unknown)).collect()} == {("Novità", 1, (0,)), ("(empty)", 1, (1,))}
    with pytest.raises(premium.IntegrityError):
        premium.process(unknown)
    assert premium.process(unknown, allow_unknown=True).count() == 2


FIELDS = [
    records.FieldRule("name", "Name", required=True, max_length=5, flow_column="Nome", track_column="NOME"),
    records.FieldRule("start", "Start", "date", flow_column="Data Inizio", track_column="INIZIO"),
    records.FieldRule("code", "Code", "select", options=("001", "002"), flow_column="Cod", track_column="CODICE"),
    records.FieldRule("fixed", "Fixed", fixed="X", track_column="FISSO"),
]


def test_records_go_to_the_layout_and_back(spark):
    flow = spark.createDataFrame([(" Ada ", "2024-1-5", "1", "sì", None), ("", None, " ", "", "")], "`nome` string, `data  inizio` string, `COD` string, `Risposta 1` string, `R2` string")
    got = records.flow_to_records(flow, FIELDS, questions=2)
    row = got.collect()
    assert len(row) == 1 and row[0].asDict() == {"name": "Ada", "start": "05/01/2024", "code": "001", "fixed": "X", "idd": {"1": "sì", "2": ""}}
    headers = records.track_headers(["NOME", "INIZIO", "CODICE", "FISSO", "ALTRO"], 2)
    assert len(headers) == 15 and records.pair_capacity(headers) == 5 and records.pair_capacity(headers[:6]) == 0
    track = records.records_to_track(got, FIELDS, headers, ["Q1", "Q2"]).first().asDict()
    assert [track[h] for h in headers[:9]] == ["Ada", "05/01/2024", "001", "X", "", "Q1", "sì", "", ""]
    assert got.select(records.missing_answers(2, F.lit(True)).alias("m")).first()["m"] == [2]
    bad = spark.createDataFrame([("toolong", "x", "9"), ("", None, "")], "name string, start string, code string")
    errors = [[(e["field"], e["error"]) for e in r["e"]] for r in bad.select(records.errors(FIELDS).alias("e")).collect()]
    assert errors == [[("name", "too long"), ("start", "not a date"), ("code", "not an option")], [("name", "required")]]


def test_life_cycle(spark):
    store = spark.createDataFrame([(1, "29/02/2024", "28/02/2025", "archived", None, None), (2, "01/01/2024", "x", "pending", None, None)], "id long, start string, end string, status string, export_batch string, exported_at string")
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert [tuple(r)[:4] for r in records.renew(store, ids).orderBy("id").collect()] == [(1, "28/02/2025", "28/02/2026", "pending"), (2, "01/01/2024", "x", "pending")]
    assert [r["status"] for r in records.archive(store, ids, "b", F.lit("now")).orderBy("id").collect()] == ["archived", "pending"]
    new = spark.createDataFrame([(2, "a", "b", "pending", None, None), (3, "a", "b", "pending", None, None)], store.schema)
    assert records.upsert(store, new, ["id"]).count() == 3 and records.upsert(store, new, ["id"], keep_old=True).filter("id = 2 AND end = 'x'").count() == 1
    assert records.delete_where(store, status="pending").count() == 1
    with pytest.raises(ValueError):
        records.delete_where(store)
    assert [r["id"] for r in records.search(store, "X", ["start", "end"]).collect()] == [2]


def test_jobs(spark):
    rows = [(1, "a", "b1", "queued", 1, None, None, None, 0, "e"), (2, "a", "b1", "done", 2, "r", None, None, 5, None), (3, "z", "b1", "mismatch", 3, None, None, 2, 0, None), (4, "a", None, "running", 4, None, None, None, 0, None)]
    store = spark.createDataFrame(rows, "id long, email string, batch_id string, status string, created_at int, result string, duplicate_of long, source_job_id long, cursor int, error string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    state = lambda df: {r["id"]: r["status"] for r in df.collect()}
    assert state(jobs.cancel(store, ids(1, 2))) == {1: "canceled", 2: "done", 3: "mismatch", 4: "running"}
    assert state(jobs.bulk_action(store, ids(2, 3), "a", "retry"))[3] == "mismatch" and state(jobs.bulk_action(store, ids(2, 3), "a", "retry"))[2] == "queued"
    assert state(jobs.override_mismatch(store, ids(1, 3))) == {1: "queued", 2: "done", 3: "queued", 4: "running"}
    reused = {r["id"]: (r["status"], r["result"], r["duplicate_of"]) for r in jobs.reuse_results(store, spark.createDataFrame([(1, 2), (4, 3)], "id long, source_id long")).collect()}
    assert reused[1] == ("done", "r", 2) and reused[4][0] == "running"
    assert jobs.next_job(store).first()["id"] == 4 and jobs.active_job(store).first()["id"] == 4
    assert [r["id"] for r in jobs.child_order(store).collect()] == [4, 2, 3, 1]
    kept, files = jobs.delete_jobs(store, spark.createDataFrame([(1, "f"), (4, "g")], "job_id long, name string"), ids(1, 4))
    assert {r["id"] for r in kept.collect()} == {2, 3, 4} and {r["job_id"] for r in files.collect()} == {4}
    batches = spark.createDataFrame([("b1", True, None), ("b2", True, None)], "id string, upload_complete boolean, notified_at string")
    marked, claimed = jobs.claim_notifications(batches, store.filter("id IN (2, 3)"), F.lit("t"))
    assert [tuple(r) for r in claimed.collect()] == [("b1", 2, 1, 0)] and {r["id"]: r["notified_at"] for r in marked.collect()} == {"b1": "t", "b2": None}


def test_paths(spark):
    filters = paths.PathFilters(excluded_names=("private",), exclude_words=("bozz",), profile_exclude_words=("quiet",), include_words=("2025", "pol"))
    listed = ["A/2025/x.pdf", "A/2025/bozza.pdf", "A/.git/2025.pdf", "Private/2025.pdf", "A/x.txt", "A/quiet2025.pdf", "A/z.pdf", "pol.pdf", "A\\2025\\w.PDF"]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(listed)], "row_id long, path string")
    got = [(r["v"]["kept"], r["v"]["reason"], r["v"]["matched"]) for r in frame.select("row_id", paths.path_verdict(F.col("path"), filters).alias("v")).orderBy("row_id").collect()]
    assert got == [(True, None, "2025"), (False, "exclude_word", "bozz"), (False, "excluded_name", None), (False, "excluded_name", None), (False, "extension", None), (False, "profile_exclude_word", "quiet"), (False, "include_word", None), (True, None, "pol"), (True, None, "2025")]
    groups = paths.dossiers(frame, filters)
    assert {(r["dossier"], tuple(r["rows"])) for r in groups.collect()} >= {("A/2025", (0,)), ("#7", (7,))}
    merged = paths.merge_dossiers(groups, spark.createDataFrame([("A/2025", "T"), ("#7", "T")], "dossier string, target string"))
    assert ("T", [0, 7]) in [(r["dossier"], r["rows"]) for r in merged.collect()]


CANDIDATES = "entity_id string, field_id string, seq int, value string, eff_date string, affinity double, lex double, appendix_ord int, doc_pos int, file string, page int"


@pytest.mark.parametrize(
    ("rule", "old", "new", "winner"),
    [
        ("semantic", ("1", "31/12/2023", 0.55), ("2", "31/12/2025", 0.57), "2"), ("semantic", ("1", "31/12/2024", None), ("2", None, None), "1"),
        ("semantic", ("1", "01/01/2018", 0.62), ("2", "01/01/2024", 0.31), "1"), ("semantic", ("4.000.000,00", "01/01/2020", 0.60), ("10.000", "01/01/2021", 0.58), "4.000.000,00"),
        ("semantic", ("4.000.000,00", "01/01/2020", 0.60), ("500.000,00", "01/01/2020", 0.80), "500.000,00"), ("more_recent", ("a", "31/12/2024", None), ("n/d", "31/12/2025", None), "a"),
    ],
)
def test_candidates(spark, rule, old, new, winner):
    rows = [("e", "f", i, v, d, a, None, None, i, None, None) for i, (v, d, a) in enumerate((old, new))]
    assert resolve.fold(spark.createDataFrame(rows, CANDIDATES), ["entity_id", "field_id"], getattr(resolve, rule)).first()["value"] == winner


def test_ties_of_candidates(spark):
    def win(a, b):
        rows = [("e", "f", i, f"v{i}", None, None, lex, ord_, pos, None, None) for i, (lex, ord_, pos) in enumerate((a, b))]
        return resolve.fold(spark.createDataFrame(rows, CANDIDATES), ["entity_id", "field_id"], resolve.more_recent).first()["value"]

    assert win((0.3, None, 0), (0.7, None, 1)) == "v1" and win((None, 8, 0), (None, 12, 1)) == "v1" and win((None, None, 0), (None, None, 1)) == "v0" and win((None, 3, 0), (None, None, 1)) == "v0"


def test_guards(spark):
    values = spark.createDataFrame([("e", f"f{i}", "7.500.000,00") for i in range(4)] + [("e", "g", "10"), ("x", "f0", "7.500.000,00"), ("x", "f1", None)], "entity_id string, field_id string, value string")
    out = {(r["entity_id"], r["field_id"]): r["cleared"] for r in resolve.spill_guard(values, F.col("field_id").startswith("f")).collect()}
    assert [k for k, c in out.items() if c] and all(out["e", f"f{i}"] for i in range(4)) and not out["e", "g"] and not out["x", "f0"]
    natures = spark.createDataFrame([("e", "a", "1.000", "annual"), ("e", "b", "1000,00", "claim"), ("e", "c", "1.000", "excess"), ("e", "d", "30", "annual")], "entity_id string, field_id string, value string, nature string")
    assert {r["field_id"] for r in resolve.merge_guard(natures).filter("cleared").collect()} == {"c", "d"}
    assert {r["field_id"] for r in resolve.class_guard(natures, F.col("nature") == "excess", F.col("nature") == "annual").collect()} == {"a", "b", "d"}
    wide = spark.createDataFrame([("01/01/2024", "01/01/2023", "10", "20", "30", "1", "2", "4")], "start string, end string, annual string, claim string, sub_limit string, base string, tax string, total string")
    assert resolve.cross_field(wide).first()["violations"] == ["start_before_end", "annual_below_claim", "sub_limit_over_annual", "total_note"]


def test_chunks_and_contexts(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(80))
    pieces = search.chunk_natural(text, 300, 40)
    assert all(len(p) <= 300 for p in pieces) and all(p.endswith(".") for p in pieces) and search.chunk_natural("  ") == [] and search.chunk_natural("ab") == ["ab"]
    joined = pieces[0]
    for p in pieces[1:]:
        overlap = next(n for n in range(min(len(joined), len(p)), -1, -1) if joined.endswith(p[:n]))
        joined += p[overlap:] if overlap else " " + p
    assert joined.split() == text.split()
    docs = spark.createDataFrame([(1, "a  b " * 400), (2, ""), (3, None)], "doc_id int, text string")
    fixed = search.chunks_fixed(docs, size=100, overlap=20).collect()
    assert {r["doc_id"] for r in fixed} == {1} and fixed[1]["start"] == 80 and all(len(r["text"]) <= 100 for r in fixed)
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate(["aaaa", "bbbb", "cccc", "dddd"])], "g string, i int, t string")
    assert [r["t"] for r in search.budget_prefix(rows, ["g"], ["i"], "t", 6).orderBy("i").collect()] == ["aaaa", "bb"]
    assert [r["t"] for r in search.budget_prefix(rows, ["g"], ["i"], "t", 2).collect()] == ["aaaa"]
    assert search.rag_context(rows.withColumnRenamed("t", "text"), ["g"], "i", separator="|").first()["context"] == "[1] aaaa|[2] bbbb|[3] cccc|[4] dddd"
    turns = search.round_robin(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("b", 2), ("a", 3)], "k string, o int"), "k", "o", 4).collect()
    assert [(r["k"], r["o"]) for r in turns] == [("a", 1), ("b", 1), ("a", 2), ("b", 2)]


def test_pages(spark):
    words = [(1, "Inizio", 0.0, 60.0, 0.0, 10.0, 20.0), (1, "Fine", 300.0, 340.0, 1.0, 11.0, 20.0), (1, "01/01/2024", 0.0, 100.0, 40.0, 50.0, 20.0), (1, "31/12/2024", 300.0, 400.0, 40.0, 50.0, 20.0)]
    page = documents.spatial_pages(spark.createDataFrame(words, "page_id long, text string, x0 double, x1 double, y0 double, y1 double, height double"))
    lines = page.first()["page"].split("\n")
    assert len(lines) == 2 and lines[0].index("Fine") == lines[1].index("31/12/2024") == 30
    pairs = {(r["label"], r["value"], r["row"]) for r in documents.label_value_pairs(page).collect()}
    assert pairs == {("Inizio", "01/01/2024", 1), ("Fine", "31/12/2024", 1)}
    colon = spark.createDataFrame([(1, "Numero polizza: 123 Premio annuo: 1.000,00\nTel: 55\nnote: nessuna")], "page_id long, page string")
    assert {(r["label"], r["value"]) for r in documents.label_value_pairs(colon).collect()} == {("Numero polizza", "123 Premio"), ("annuo", "1.000,00")}
    facts = documents.numeric_facts(spark.createDataFrame([(1, "Massimale sinistro: 4.000.000,00\nanno 2024\nPremio annuo totale 5.501,25")], "page_id long, text string"), {"massimale": ["massimal"], "premio": ["premi"]})
    assert {(r["value"], tuple(r["cats"])) for r in facts.collect()} == {(4e6, ("massimale",)), (5501.25, ("premio",))}
    many = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([30, 60, 200, 5])], "d string, i int, t string")
    out = documents.page_batches(many, "d", ["i"], "t", 100).orderBy("batch").collect()
    assert [len(r["text"]) for r in out] == [92, 100, 5]


def test_scores(spark):
    expected = spark.createDataFrame(
        [("a", "X y", "text", None), ("b", "31/12/2024", "date", None), ("c", "1.800.000", "amount", None), ("d", "12345678903", "vat", None), ("e", "roma", "contains", None), ("f", "q", "exact", ["bad"]), ("g", "z", "exact", None)],
        "field_id string, value string, mode string, forbidden array<string>",
    )
    actual = spark.createDataFrame([("a", "x-Y"), ("b", "2024-12-31"), ("c", "1.800.000"), ("d", "123456789-03"), ("e", "Via Roma 1"), ("f", "very bad"), ("extra", "1"), ("empty", " ")], "field_id string, value string")
    r = scoring.score_extraction(expected, actual).first()
    assert (r["exact"], r["normalized"], r["missing"], r["forbidden"], r["mismatch"], r["extra"]) == (1, 4, 1, 1, 0, 1)
    assert r["hallucination_rate"] == pytest.approx(1 / 6)
    text = lambda t: scoring.keyword_verdict(F.lit(t), F.array(F.lit("Polizza"), F.lit("zz")))
    row = spark.range(1).select(
        scoring.precheck(F.lit("off"), F.lit(True), text("la polizza"), text(""), F.lit(None), F.lit(None)).alias("a"), scoring.precheck(F.lit("semantic"), F.lit(True), text("x"), text("polizza"), F.lit(0.9), F.lit(None)).alias("b"),
        scoring.precheck(F.lit("semantic"), F.lit(True), text("x"), text("x"), F.lit(0.2), F.lit(None)).alias("c"), scoring.precheck(F.lit("llm"), F.lit(False), text("x"), text("x"), F.lit(0.2), F.lit(0.9)).alias("d"),
        scoring.reliability(F.lit("v"), F.lit(True), F.lit(False), F.lit(True), F.lit(2), F.lit(0.1)).alias("e"), scoring.review_answer(F.lit('{"ok": false, "motivo": "no"}')).alias("f"),
        scoring.repair_json(F.lit('x {"a": [1, 2,], // c\n "b": 1,} y')).alias("g"),
    ).first()
    assert (row["a"]["verdict"], row["a"]["mode"], row["b"]["verdict"], row["c"]["verdict"], row["d"]["verdict"]) == ("ok", "keywords", "mismatch", "mismatch", "skipped")
    assert row["e"]["score"] == pytest.approx(0.9) and row["f"]["ok"] is False and row["f"]["reason"] == "no"
    import json

    assert json.loads(row["g"]) == {"a": [1, 2], "b": 1}
    names = spark.createDataFrame([("premio_anno",), ("decorrenza",), ("xx",)], "key string")
    known = spark.createDataFrame([("premio_annuo",), ("premio_annui",), ("decorrenzo",)], "known string")
    assert {tuple(r) for r in scoring.unique_key_match(names, known).collect()} == {("decorrenza", "decorrenzo")}


def test_row_ids_number_all_rows_in_order(spark):
    n = 2_000_000
    rows = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("v"), F.md5(F.col("id").cast("string")).alias("payload"))
    numbered = tables.with_row_id(rows, "v")
    assert numbered.columns == ["v", "payload", "row_id"]
    row = numbered.agg(F.count("*"), F.count_if(F.col("v") != F.col("row_id")), F.countDistinct("row_id"), F.max("row_id")).first()
    assert tuple(row) == (n, 0, n, n - 1)


def test_stored_tables_can_be_discarded_one_by_one(spark):
    a, b = (storage.stored(spark.range(3), name) for name in "ab")
    files = a.inputFiles()
    storage.discard(a, None, spark.range(1))
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert b.count() == 3


def test_tables_of_a_block_go_with_it(spark):
    with storage.passing() as keep:
        a = storage.stored(spark.range(3), "a")
        files = a.inputFiles()
        with storage.passing():
            storage.discard(storage.stored(spark.range(1), "b"))
        c = keep(storage.stored(a.filter("id > 0"), "c"))
    assert c.count() == 2 and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_a_cluster_has_to_name_the_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(Cluster)


def test_sources_and_sinks(spark, tmp_path):
    numbered = tables.with_row_id(spark.range(100).select((99 - F.col("id")).alias("v")), "v")
    assert all(r["v"] == r["row_id"] for r in numbered.collect())
    files = spark.createDataFrame([(1, "a"), (3, "c")], "job_id long, name string")
    owners = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "job_id long, source_job_id long")
    assert {tuple(r) for r in tables.own_or_source_files(files, owners).collect()} == {(1, "a"), (2, "a"), (3, "c")}
    cache = spark.createDataFrame([("h1", 1), ("h2", 2)], "hash string, version int")
    hits, misses = tables.cache_lookup(spark.createDataFrame([("h1",), ("h2",), ("h3",)], "hash string"), cache, "hash", 2)
    assert hits.count() == 1 and {r[0] for r in misses.collect()} == {"h1", "h3"}
    values = spark.createDataFrame([("j", "b", "1"), ("j", "a", "2"), ("k", "a", "3")], "job_id string, field_id string, value string")
    assert [tuple(r) for r in sinks.wide_fields(values, ["a", "b"]).orderBy("job_id").collect()] == [("j", "2", "1"), ("k", "3", None)]
    sinks.checked_write(values, f"{tmp_path}/v")
    with pytest.raises(sinks.ReadBackError):
        sinks.append_checked(values.withColumn("z", F.lit(1)), f"{tmp_path}/v", values)


def test_plausible_amounts_round_like_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    orders = [(1, 1, 1000.51), (3, 1, 1485.76), (5, 2, 1000.05), (9, 2, 1485.07), (7, 3, 66666.67), (11, 3, 100000.01)]
    frame = spark.createDataFrame([(k, e, p) for k, e, p in orders], "o_orderkey long, o_custkey long, o_totalprice double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["entity_id"], r["field_id"]): r["plausible"] for r in dossier_plans.QUERIES["plausible_amounts"](spark, str(tmp_path)).collect()}
    base = duckdb.connect()
    base.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == {(e, k): v for e, k, v in base.execute(dossier_plans.ORACLES["plausible_amounts"]).fetchall()}


def test_numeric_facts_take_runs_of_digits_past_a_long(spark):
    pages = [(1, "limit 12345678901234567890123\nlimit " + "9" * 400 + "\nlimit 77,4"), (2, "limit " + ".".join(["123"] * 30_000)), (3, "12345678901234567890123 and 77")]
    facts = documents.numeric_facts(spark.createDataFrame(pages, "page_id long, text string"), {"limit": ["limit"]})
    got = {(r["value_key"], r["pages"], r["facts"]) for r in documents.facts_index(facts).collect()}
    assert got == {(12345678901234567890123.0, 2, 2), (77.0, 2, 2)}
