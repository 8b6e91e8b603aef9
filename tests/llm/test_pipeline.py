"""Mixing, packing, token attribution, the pipeline and the registered queries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tallyloom.llm import attribution, jaccard, langid, mixing, packing, quality, registry, tokens


@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_schedule_deviates_by_less_than_a_block(slots):
    order = mixing.schedule(slots)
    period = sum(slots)
    assert Counter(order.tolist()) == Counter({i: a for i, a in enumerate(slots)})
    done = np.zeros(len(slots))
    for t, i in enumerate(order):
        done[i] += 1
        assert (np.abs(done - (t + 1) * np.array(slots) / period) < 1).all()


def test_weights_keep_every_source():
    slots = mixing.whole_weights({"a": 1e6, "b": 1.0, None: 2.0, "z": 0.0}, 100)
    assert sum(slots.values()) == 100 and min(slots.values()) >= 1 and "z" not in slots
    many = mixing.whole_weights({str(i): 1.0 for i in range(400)}, 100)
    assert sum(many.values()) == 1600 and set(many.values()) == {4}


def by_hand(rows, slots, block):
    """Positions by walking the slots; a source that ran out is passed over."""
    order = mixing.schedule(list(slots.values()))
    names, left = list(slots), {s: list(r) for s, r in rows.items()}
    out, t = [], 0
    while any(left.values()):
        s = names[order[t % len(order)]]
        out += [(s, t)] * len(left[s][:block])
        left[s] = left[s][block:]
        t += 1
    return out


def test_mixed_positions_equal_the_walk(spark):
    rows = [(i, s, "extra") for s, n in (("hot", 700), ("b", 90), ("c", 33), (None, 5)) for i in range(len(str(s)) * 10_000, len(str(s)) * 10_000 + n)]
    rows += [(None, "b", "e"), (1, "c", "e"), (1, "c", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_note string").repartition(3)
    got = mixing.mix(docs, {"hot": 2.0, "b": 1.0, "c": 1.0, None: 0.5}, block=8, period=90).collect()
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    slots = mixing.whole_weights({"hot": 2.0, "b": 1.0, "c": 1.0, None: 0.5}, 90)
    want = by_hand(sources, slots, 8)
    assert [(r["source"], r["mix_slot"]) for r in sorted(got, key=lambda r: r["mix_position"])] == want
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["source"], r["mix_note"]) for r in got) == Counter(rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []


def in_file_order(spark, path):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(path)
    rows = rows.select("*", mixing.file_order(rows).alias("_f"), F.monotonically_increasing_id().alias("_i")).collect()
    return sorted(rows, key=lambda r: (r["_f"], r["_i"]))


@pytest.mark.parametrize("block, file_bytes, cuts", [(32, 128 << 20, 2_000_000), (4, 600, 2_000_000), (4, 600, 30)])
def test_files_lie_in_mixed_order(spark, tmp_path, monkeypatch, block, file_bytes, cuts):
    monkeypatch.setattr(mixing, "MAX_CUTS", cuts)
    rows = [(i if i % 9 else None, "hot" if i % 3 else f"s{i % 7}", "t" * (i % 5), i) for i in range(600)]
    rows += [(7, None, "same", 7)] * 120 + [(1, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _metadata int").repartition(3)
    targets = {"hot": 3.0, "s3": 1.0, None: 1.0}
    mixing.in_mixed_order(docs, targets, block=block, file_bytes=file_bytes).write.parquet(f"{tmp_path}/m")
    got = in_file_order(spark, f"{tmp_path}/m")
    assert Counter((r["doc_id"], r["source"], r["text"], r["_metadata"]) for r in got) == Counter(rows)
    plan = mixing.plan_sources(docs.select(mixing._key(docs.source).alias("_s")), targets, mixing.PERIOD)
    slots = {k[1:] if k else None: int(w) for k, w in zip(plan.keys, plan.weight, strict=True)}
    sources = {s: [s] * sum(r[1] == s for r in rows) for s in slots}
    assert [r["source"] for r in got] == [s for s, _ in by_hand(sources, slots, block)]


def test_numbers_of_files_sort_beyond_99999(spark, tmp_path):
    import os

    for n in (99_999, 100_000, 7, 1_234_567):
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.parquet(f"{tmp_path}/one")
        name = next(f for f in os.listdir(tmp_path / "one") if f.startswith("part-"))
        os.makedirs(tmp_path / "all", exist_ok=True)
        os.rename(tmp_path / "one" / name, tmp_path / "all" / name.replace("part-00000", f"part-{n:05d}"))
        __import__("shutil").rmtree(tmp_path / "one")
    assert [r["n"] for r in in_file_order(spark, f"{tmp_path}/all")] == [7, 99_999, 100_000, 1_234_567]


def test_fifty_thousand_sources(spark):
    from pyspark.sql import functions as F

    n = 50_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, F.concat(F.lit("s"), F.col("id"))).otherwise("hot").alias("source"))
    out = mixing.mix(docs).agg(F.count("*"), F.countDistinct("mix_position"), F.min("mix_position"), F.max("mix_position"), F.count_if(F.expr("mix_slot < mix_release OR mix_slot >= mix_deadline"))).first()
    assert tuple(out) == (2 * n, 2 * n, 0, 2 * n - 1, 0)


def test_columns_of_added_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "doc_id long, source string, mix_position int")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", *mixing.ADDED] and sorted(r["mix_position"] for r in out.collect()) == [0, 1]


def ids_by_hand(text):
    return tokens.load(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(pieces, docs, sequence=2048):
    want = Counter()
    for i, t in docs:
        ids = np.array(ids_by_hand(t), "<u4")
        for a in range(0, len(ids), sequence):
            part = ids[a : a + sequence]
            want[i, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    at = defaultdict(list)
    for p in pieces:
        at[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= sequence
    assert sorted(at) == list(range(len(at)))
    return sum(p["length"] for p in pieces) / (len(at) * sequence) if at else 1.0


def test_packing_holds_every_token_once(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, None), (-1, ""), (-1, ""), (-2, "a<|endoftext|>B \x01 É. it's!! ΣΑΣ"), (-3, "x" * 9000), (-4, "İ. é… 'll !'s")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, offset string").repartition(3)
    pieces = packing.pack(docs, packing.tokenizer_path(), with_ids=True).collect()
    assert check_packing(pieces, rows) > 0.97
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack(docs.limit(0), packing.tokenizer_path()).collect() == []


def test_order_ranks_documents_of_a_length(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "word " * 1500) for i in range(40)], "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, packing.tokenizer_path(), order=F.lpad((99 - F.col("doc_id")).cast("string"), 3, "0")).collect()
    assert [p["doc_id"] for p in sorted(pieces, key=lambda p: p["sequence_id"])] == list(range(39, -1, -1))


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_layout_holds_every_piece(histogram):
    layout = packing.plan_layout(histogram, 32)
    load, places = Counter(), Counter()
    for size, (first, sequence, count, place) in layout.runs.items():
        for rank in range(histogram[size]):
            k = np.searchsorted(first, rank, "right") - 1
            within = rank - first[k]
            s = int(sequence[k] + within // count[k])
            load[s] += size
            places[s, int(place[k] + within % count[k])] += 1
    assert max(load.values()) <= 32 and max(places.values()) == 1 and len(load) <= layout.n_sequences
    bound = -(-sum(s * n for s, n in histogram.items()) // 32)
    assert layout.n_sequences >= bound


def test_linear_program_reaches_a_known_optimum():
    # three of 10 fit a bin of 32, one of 20 leaves 12 for one of 10: 20s need 10 bins, which take 10 of the 10s
    found = packing.solve_patterns(np.array([10, 20]), np.array([40.0, 10.0]), 32, 1e-9)
    assert sum(x for _, x in found) == pytest.approx(20)


def test_attribution_equals_offsets_of_another_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    rows = [("s", "one two\n\n\n  three éè\nlast", 1), (None, None, 2), ("", "\n", 3), ("é", "x\r\n\r\ny", 4), ("s", "日本\n語 end\n\n", 5), ("s", "日本\n語 end\n\n", 5)]
    docs = spark.createDataFrame(rows, "source string, text string, doc_id long")
    for rule in attribution.RULES:
        got = Counter((r["doc_id"], r["field"], r["section"], r["start"], r["length"], r["n_tokens"]) for r in attribution.token_attribution(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("source", "text"), rule=rule).collect())
        want = Counter()
        for source, text, i in rows:
            whole = (source or "") + "\n" + (text or "")
            cuts, names = [0, len(((source or "") + "\n").encode())], [("source", 0)]
            lines = (text or "").split("\n")
            lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
            for k, line in enumerate(lines):
                cuts.append(cuts[-1] + len(line.encode()))
                names.append(("text", k))
            counts = [0] * len(names)
            at = 0
            for token in coder.encode(whole, add_special_tokens=False).tokens:
                end = at + len(token)  # one letter of this vocabulary stands for one byte
                shares = [min(end, b) - max(at, a) for a, b in zip(cuts, cuts[1:], strict=False)]
                counts[max(range(len(shares)), key=lambda j: (shares[j], -j)) if rule == "most" else next(j for j, x in enumerate(shares) if x > 0)] += 1
                at = end
            for (field, section), start, stop, n in zip(names, cuts, cuts[1:], counts, strict=False):
                want[i, field, section, start, stop - start, n] += 1
        assert got == want


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "near_duplicates", "mix_sources", "pack"]
    a = stages["language_id"](spark, docs, sf)
    model = langid.fit(docs.filter(langid.training_rows(docs)))
    seen = langid.identify(docs, model).collect()
    assert sorted(r["doc_id"] for r in a.collect()) == sorted(r["doc_id"] for r in seen if r["lang_pred"] != "und" and r["fits"])
    assert a.count() > 0.95 * docs.filter("lang IS NOT NULL").count()
    b = stages["quality_rules"](spark, a, sf)
    kept = {r["doc_id"] for r in quality.quality_rules(a).filter("kept").collect()}
    assert {r["doc_id"] for r in b.collect()} == kept and len(kept) > 0.5 * docs.count()
    c = stages["near_duplicates"](spark, b, sf)
    assert {r["doc_id"] for r in c.collect()} == {r["component_id"] for r in jaccard.ngram_jaccard(b).collect()}
    d = stages["mix_sources"](spark, c, sf)
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    assert Counter(d.collect()) == Counter(c.collect())
    pieces = stages["pack"](spark, d, sf).collect()
    assert check_packing(pieces, [(r["doc_id"], r["text"]) for r in d.collect()]) > 0.9


def test_stages_take_anything(spark, sf, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and an empty table."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    clean = " ".join(f"word{i} is quite plain" for i in range(8))
    rows = [
        (1, clean, "en", "a", 10), (1, clean, "en", "a", 10), (2, None, None, None, None), (None, clean + " and more words here", None, None, None), (3, "", "en", "a", 0), (4, "123 456 !!", "en", None, 3),
        (5, " ".join(f"word{i} is quite plain" for i in range(9, 10_000)), "en", "b", 1), (6, clean + " at last", "de", None, 10), (7, "der die das und ist nicht ein eine zwei drei vier fünf sechs", "de", "b", 5),
    ]
    for name, data in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if i < 4:
                assert out.columns == schema.names
            out.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        pieces = docs.collect()
        assert len({p["sequence_id"] for p in pieces}) == (0 if name == "none" else max(p["sequence_id"] for p in pieces) + 1)
        assert {p["doc_id"] for p in pieces} <= {1, None, 5, 6, 7} and (name == "none" or {1, 5} <= {p["doc_id"] for p in pieces})


def test_stages_keep_columns_of_any_name_and_long_texts(spark, sf, tmp_path):
    """Extra columns with the names that operators use, and a text of some megabytes."""
    extra = ["host_ok", "_host", "mix_position", "_s", "_u", "_gone", "lang_pred", "n_words", "_c0", "_page", "component_id", "row_index"]
    clean = " ".join(f"word{i} is quite plain" for i in range(8))
    long_ = " ".join(f"token{i} is quite word{i * 3} and" for i in range(60_000))
    rows = [(i, clean + f" number {i} and some more of its own {i * 7} {i * 13} {i * 17}", "en", "a" if i % 2 else "b", 10, *range(len(extra))) for i in range(20)] + [(50, long_, "en", "a", len(long_), *range(len(extra)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            kept = docs.collect()
            assert 50 in {r["doc_id"] for r in kept} and all(tuple(r)[5:] == tuple(range(len(extra))) for r in kept)
    whole = docs.filter("doc_id = 50").agg({"length": "sum", "doc_tokens": "max"}).first()
    assert whole[0] == whole[1] > 300_000


def test_attribution_of_long_texts_ties_and_clashing_columns(spark):
    import public_tokenizers

    text = "\n".join(f"line {i} of a long text" for i in range(40_000))
    docs = spark.createDataFrame([(1, "s", text, 5, "x"), (2, "ab", "ab", 6, "y")], "doc_id long, source string, text string, n_tokens int, section string")
    out = attribution.token_attribution(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("source", "text"))
    rows = out.filter("doc_id = 1").agg({"n_tokens": "sum", "length": "sum", "*": "count"}).first()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows["sum(n_tokens)"] == len(coder.encode("s\n" + text, add_special_tokens=False).ids) and rows["sum(length)"] == len("s\n" + text) and rows["count(1)"] == 40_001


def test_run_applies_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"} and out.count() > 0


def test_names_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
