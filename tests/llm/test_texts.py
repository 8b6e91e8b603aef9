"""Language model, language identification, quality rules, licences and chats against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import chat, langid, licenses, quality, suffix_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_unigram_base_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(suffix_lm, "FREQUENT", 0.01)
    rows = [*texts(spark, sf), (None, "a  b"), (900001, None), (900002, ""), (900001, None)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, base_score double")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*WORD.findall(lower(t)), None])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        want[i, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6)] += 1
    out = suffix_lm.lm_score(docs, training=~suffix_lm.held_out()).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {total}
    assert all(r["score"] < 0 for r in out)


def tree_by_hand(tree, text):
    """The longest suffix in the tree, one symbol after the other."""
    data = [suffix_lm.END] * tree.depth + list(" ".join(WORD.findall(lower(text))).encode()) + [suffix_lm.END]
    total = 0.0
    for t in range(tree.depth, len(data)):
        node = 0
        for d in range(1, tree.depth + 1):
            child = tree.child[node, data[t - d]]
            if child < 0:
                break
            node = child
        total += float(tree.log_p[node, data[t]])
    return total


def test_suffix_tree_scores_and_beats_its_root(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tree = suffix_lm.fit_tree(suffix_lm.corpus_counts(docs.filter(~suffix_lm.held_out())))
    assert len(tree.child) > 50
    assert np.allclose((10.0 ** tree.log_p.astype(float)).sum(1), 1, atol=1e-3)
    scores = {r["doc_id"]: r["score"] for r in suffix_lm.lm_score(docs, training=~suffix_lm.held_out(), anchors=1 << 62).collect()}
    gain = 0.0
    for i, t in texts(spark, sf)[:60]:
        assert scores[i] == pytest.approx(tree_by_hand(tree, t), rel=1e-4)
        flat = suffix_lm.Tree(np.full((1, 256), -1, np.int32), tree.log_p[:1], tree.depth)
        gain += scores[i] - tree_by_hand(flat, t)
    assert gain > 0


def test_the_tree_equals_brute_force(spark, sf):
    rows = [t for _, t in texts(spark, sf)[:40]]
    tree = suffix_lm.fit_tree(suffix_lm.corpus_counts(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)), min_share=2e-3)
    seen = {}
    for t in rows:
        data = [suffix_lm.END] * 4 + list(" ".join(WORD.findall(lower(t))).encode()) + [suffix_lm.END]
        for i in range(4, len(data)):
            for d in range(5):
                seen.setdefault(tuple(data[i - d : i]), Counter())[data[i]] += 1
    total = sum(seen[()].values())
    tried = {c: n for c, n in seen.items() if not c or sum(n.values()) >= max(2, total * 2e-3)}
    p, stays = {}, {()}
    for c in sorted(tried, key=len):
        n, size = tried[c], sum(tried[c].values())
        if not c:
            p[c] = [(n[b] + 1) / (size + 256) for b in range(256)]
            continue
        above = p[c[1:]]
        p[c] = [(n[b] + len(n) * above[b]) / (size + len(n)) for b in range(256)]
        if sum(k * math.log(k / size / above[b]) for b, k in n.items()) > suffix_lm.CUT * len(n):
            stays |= {c[i:] for i in range(len(c))}
    found = {}

    def walk(node, context):
        found[context] = 10.0 ** tree.log_p[node].astype(float)
        for b in np.flatnonzero(tree.child[node] >= 0).tolist():
            walk(tree.child[node, b], (b, *context))

    walk(0, ())
    assert set(found) == stays and len(stays) > 100 and len(stays) < len(tried)
    assert all(np.allclose(found[c], p[c], rtol=1e-4) for c in stays)


def test_word_contexts_equal_brute_force(spark, monkeypatch):
    phrase = "one rare turn of phrase that stays the same"
    rows = [(i, f"start {i} the cat and the dog {phrase} then {'x' * (i % 4)} end{i}") for i in range(30)] + [(40, ""), (41, None), (42, "a"), (43, "a b"), (44, f"{phrase}"), (44, f"{phrase}"), (None, "the cat and the dog " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree = suffix_lm.fit_tree(suffix_lm.corpus_counts(docs.filter(~suffix_lm.held_out())))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, by_bytes, each = {}, {}, []
    for i, t in rows:
        words = WORD.findall(lower(t))
        grams = []
        for k in range(2, len(words)):
            context, word = tuple(words[k - 2 : k]), (words[k], k == len(words) - 1)
            data = [suffix_lm.END] * 4 + list((" ".join(words[:k]) + " ").encode())
            log_p = 0.0
            for b in [*words[k].encode(), suffix_lm.END if word[1] else 32]:
                node = 0
                for d in range(1, tree.depth + 1):
                    if (child := tree.child[node, data[-d]]) < 0:
                        break
                    node = child
                log_p += float(tree.log_p[node, b])
                data.append(b)
            by_bytes[context, word] = log_p
            grams.append((context, word))
            if not held(i):
                counts.setdefault(context, Counter())[word] += 1
        each.append((i, t, grams))
    kept = {}
    for c, n in counts.items():
        size = sum(n.values())
        if size >= 2 and sum(k * (math.log(k / size) - by_bytes[c, w] * math.log(10)) for w, k in n.items()) > suffix_lm.CUT * len(n):
            kept[c] = (size, len(n))
    want = Counter()
    for i, t, grams in each:
        score, deep = tree_by_hand(tree, t), 0
        for c, w in grams:
            if c in kept:
                size, kinds = kept[c]
                score += math.log10((counts[c][w] * 10 ** -by_bytes[c, w] + kinds) / (size + kinds))
                deep += 1
        want[i, round(score, 3), deep] += 1
    monkeypatch.setattr(suffix_lm, "FREQUENT", 0.01)
    got = suffix_lm.lm_score(docs, training=~suffix_lm.held_out(), anchors=1).collect()
    assert Counter((r["doc_id"], round(r["score"], 3), r["n_deep"]) for r in got) == want
    assert 10 < len(kept) < len(counts)


def test_what_is_gathered_grows_and_repeated_texts_score_apart(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(4000)]
    text = lambda: " ".join(rng.choice(words, 120))
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_lm.lm_score(docs, anchors=4).collect()}
    assert max(out[i] for i in range(20, 60)) < min(out[i] for i in range(20))
    kept = [sum(r["n_deep"] for r in suffix_lm.lm_score(docs.filter(f"doc_id % 100 < {n}"), anchors=4).collect()) for n in (5, 10, 20)]
    assert 0 < 1.5 * kept[0] < kept[1] and 1.5 * kept[1] < kept[2]


def test_lm_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_lm.lm_score(empty).collect() == []
    from pyspark.sql import functions as F

    (row,) = suffix_lm.lm_score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), training=F.lit(False)).collect()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["base_score"] == 0.0


def test_languages_of_held_out_documents(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.filter(langid.training_rows(docs)))
    out = langid.identify(docs.filter(~langid.training_rows(docs)), model, keep=("doc_id", "lang")).filter("n_letters >= 20")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.95 * n


def test_margins_and_decoding_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 7)
    learn = [("de", "Der die das und ist nicht ein eine"), ("en", "the and of to in is that it was"), ("fr", "le la les et est que une dans"), ("de", "kurz"), ("it", "il lo gli e che non una"), ("xx", "é")]
    asked = ["the DER the", "gli che", "zz", "und", "une dans les", "ab"]
    model = langid.fit(spark.createDataFrame(learn, "lang string, text string"))

    def buckets(text):
        data = lower(text).encode()
        return [(int.from_bytes(data[i : i + 4], "big") * 0x9E3779B1 % 2**32) >> (32 - 15) for i in range(len(data) - 3)]

    names = sorted({n for n, _ in learn if n != "xx"})
    p = {}
    for name in names:
        counts = Counter(b for n, t in learn if n == name for b in buckets(t))
        p[name] = lambda b, c=counts: (c[b] + 0.5) / (sum(c.values()) + 0.5 * 2**15)
    code = langid.codewords(len(names))
    bits = [([n for n, c in zip(names, code[:, k], strict=True) if c > 0], [n for n, c in zip(names, code[:, k], strict=True) if c < 0]) for k in range(code.shape[1])]
    weight = lambda b, k: math.log(sum(p[n](b) for n in bits[k][0]) / len(bits[k][0])) - math.log(sum(p[n](b) for n in bits[k][1]) / len(bits[k][1]))
    assert model.languages == names
    out = langid.identify(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model, keep=("i",)).collect()
    for r in out:
        found = buckets(asked[r["i"]])
        loss = []
        for row in range(len(names)):
            margins = [sum(weight(b, k) for b in found) / max(1, len(found)) * min(len(found), langid.EVIDENCE) for k in range(len(bits))]
            loss.append(sum(math.log1p(math.exp(-m * code[row, k])) * model.reliability[k] for k, m in enumerate(margins)))
        share = [math.exp(min(loss) - x) for x in loss]
        assert r["lang_pred"] == names[loss.index(min(loss))] and r["score"] == pytest.approx(max(share) / sum(share), rel=1e-4)


def test_long_texts_are_read_whole(spark):
    model = langid.fit(spark.createDataFrame([("de", "der die das und ist nicht ein eine "), ("en", "the and of to in is that it was ")], "lang string, text string"))
    rows = [(1, "der die das " * 200_000 + "the and of " * 100_000), (2, "der die das " * 100_000 + "the and of " * 200_000)]
    out = {r["i"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "i int, text string"), model, keep=("i",)).collect()}
    assert out == {1: "de", 2: "en"}


def test_language_edges(spark):
    rows = [("de", "der die das und ist nicht ein eine " * 3), ("en", "the and of to in is that it was " * 3), ("fr", "le la les et est que une dans " * 3), (None, "zzz")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["de", "en", "fr"] and model.code.shape == (3, 3)
    asked = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of the"), (5, "日本語"), (6, "a"), (4, "the and of the")]
    out = {r["i"]: r for r in langid.identify(spark.createDataFrame([(i, t, "x") for i, t in asked], "i int, text string, lang_pred string"), model, keep=("i",)).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[4]["lang_pred"] == "en" and out[5]["lang_pred"] != "und" and out[6]["ambiguous"]
    assert langid.identify(spark.createDataFrame([], "i int, text string"), model, keep=("i",)).collect() == []
    nothing = langid.fit(spark.createDataFrame([], "lang string, text string"))
    assert langid.identify(spark.createDataFrame([(1, "abc")], "i int, text string"), nothing, keep=("i",)).first()["lang_pred"] == "und"


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)]


def test_rule_counts_equal_brute_force(spark, sf):
    rows = [*texts(spark, sf), (-1, None), (-2, ""), (-3, "a b c d e a b c d e f"), (-4, "x\nx\n\n \nx"), (-5, "é" * 5 + " |<>"), (-6, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: [r[f"_q_{c}"] for c in quality.FEATURES] for r in quality.with_rule_counts(docs).collect()}
    assert got == {i: counts_by_hand(t) for i, t in rows}


def test_a_bad_host_loses_its_documents_and_a_small_one_is_shrunk(spark):
    good, bad = "all of these are different words in one good line of text", "too short"
    rows = [(i, "bad", bad if i % 10 else good) for i in range(200)] + [(1000 + i, "fine", good if i % 10 else bad) for i in range(300)]
    rows += [(5000, "tiny", bad), (5001, "tiny", good), (6000, None, good), (6001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert not any(kept[i] for i in range(200)) and sum(kept[1000 + i] for i in range(300)) == 270
    assert kept[5001] and not kept[5000] and kept[6000] and not kept[6001]
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == sorted(i for i, k in kept.items() if k)
    assert quality.quality_rules(docs.limit(0)).collect() == []


def test_licences(spark):
    mit = " ".join(next(n for n in licenses.NOTICES if n.label == "mit").words)
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."), (2, "cc BY-nc 4.0; CC by"), (3, None), (4, ""), (5, mit.upper()),
        (6, "gnu public general license"), (7, "MIT License. Apache License mit license"), (8, "licensed under the apache license version 2 1"), (9, "é-mit-license"), (9, "é-mit-license"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    out = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    label = lambda i: sorted({f["label"] for f in out[i]["found"]})
    assert label(1) == ["gpl", "gpl-3.0"] and [f["start"] for f in out[1]["found"] if f["base"]] == [6]
    assert label(2) == ["cc-by", "cc-by-nc-4.0"] or label(2) == ["cc-by"]
    assert label(3) == label(4) == label(6) == [] and out[3]["n_words"] == 0
    assert label(5) == ["mit"] and label(7) == ["apache", "mit"] and sum(f["base"] for f in out[7]["found"]) == 3
    assert label(8) == ["apache"] and label(9) == ["mit"] and out[9]["n_words"] == 3
    assert licenses.license_scan(docs.limit(0)).collect() == []


def test_chats_round_trip(spark):
    rows = [
        (1, 0, "system", "a<b\\c"), (1, 1, "user", chat.PROBE), (1, 2, "user", "</turn>\n<next/>"), (1, 3, "assistant", "\\l \\s \\g"), (1, 4, "assistant", ""), (1, 5, "user", None),
        (2, 1, "assistant", "second"), (2, 0, "us>er", "first"), (3, None, None, None), (None, 0, "user", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_chats(turns)
    from pyspark.sql import functions as F

    got = {r["conv_id"]: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    back = lambda i: [(t["role"], t["text"]) for t in got[i]["back"]]
    assert back(1) == [("system", "a<b\\c"), ("user", chat.PROBE), ("user", "</turn>\n<next/>"), ("assistant", "\\l \\s \\g"), ("assistant", ""), ("user", "")]
    assert got[1]["loss"] == "\\l \\s \\g" and got[1]["formatted"].count(chat.OPEN) == 4
    assert back(2) == [("us>er", "first"), ("assistant", "second")] and got[2]["loss"] == "second"
    assert back(3) == [("", "")] and back(None) == [("user", "x")] and back(4) == [("user", "same")] * 2
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_good_documents_of_good_hosts_stay_with_any_columns(spark):
    fine = " ".join(f"word{i}" for i in range(12))
    rows = [(i, fine if i % 4 == 0 else "bad", "spam", True, "x") for i in range(400)] + [(1000 + i, fine if i % 50 else "bad", h, False, "y") for i in range(300) for h in ("a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host_ok boolean, _host string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if r[2] != "spam" and r[1] == fine)
    assert quality.keep_good(docs.limit(0)).collect() == []


def test_every_notice_is_found_where_it_stands(spark):
    notices = [*licenses.BASE, *licenses.NOTICES]
    rows = [(i, "Über x " * i + " -- ".join(n.words).upper() + " tail") for i, n in enumerate(notices)]
    rows += [(1000, "\n".join(t for _, t in rows)), (1001, None), (1002, "license"), (1003, "mit mit license license"), (1004, "mit mit license license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in licenses.license_scan(docs).collect():
        assert got.setdefault(r["doc_id"], r) == r
    for i, n in enumerate(notices):
        hits = [x for x in got[i]["found"] if x["label"] == n.label]
        assert any(x["start"] == 2 * i + n.key and x["coverage"] == 1 and x["base"] == n.base for x in hits), n.label
    assert {x["label"] for x in got[1000]["found"]} == {n.label for n in notices}
    assert [got[i]["found"] for i in (1001, 1002)] == [[], []] and got[1001]["n_words"] == 0
    assert [(x["label"], x["start"]) for x in got[1003]["found"]] == [("mit", 1)]
    assert licenses.license_scan(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="n_words"):
        licenses.license_scan(docs.withColumn("n_words", docs.doc_id), keep=("doc_id", "n_words"))


def test_a_cut_header_needs_its_phrase_and_most_of_its_words(spark):
    whole = next(n for n in licenses.NOTICES if n.label == "mit-text").words
    cut = lambda *spoilt: " ".join("x" if i in spoilt else w for i, w in enumerate(whole))
    docs = spark.createDataFrame([(0, cut(0, 1, 2)), (1, cut(*range(12))), (2, cut(*range(22))), (3, cut(40)), (4, " ".join(whole[30:]))], "doc_id long, text string")
    found = {r["doc_id"]: {x["label"]: x["coverage"] for x in r["found"]} for r in licenses.license_scan(docs).collect()}
    assert found[0]["mit-text"] == pytest.approx(1 - 3 / len(whole)) and "mit-text" in found[1]
    assert all("mit-text" not in found[i] for i in (2, 3, 4))


def test_very_long_texts_are_scanned_to_their_end(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum, " * 400_000 + "MIT License; gnu general public license")], "doc_id long, text string")
    row = licenses.license_scan(docs).first()
    assert row["n_words"] == 800_006 and {(x["label"], x["start"]) for x in row["found"]} == {("mit", 800_000), ("gpl", 800_002)}


def test_every_context_of_two_words_is_tried(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{w}{i % 40}" for w in ("one", "two", "three", "four", "five", "six"))) for i in range(400)], "doc_id long, text string")
    deep = lambda **options: {r["doc_id"]: (r["n_deep"], round(r["score"], 9)) for r in suffix_lm.lm_score(docs, **options).collect()}
    got = deep()
    assert got == deep(anchors=1)
    assert min(n for n, _ in got.values()) >= 1


def test_words_after_contexts_are_never_stored_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 7 + j * j) % 199}" for j in range(190))) for i in range(60)], "doc_id long, text string")
    stored, keep = [], suffix_lm.materialise

    def count(df, name):
        table = keep(df, name)
        stored.append((name, table.count()))
        return table

    monkeypatch.setattr(suffix_lm, "materialise", count)
    out = suffix_lm.lm_score(docs).collect()
    assert len(out) == 60 and all(r["n_deep"] > 100 for r in out)
    # one for each document and word would be 11,000 and more; the tree's contexts stay below that
    assert max(n for _, n in stored) < 9000, stored


@pytest.mark.parametrize("window, flush", [(1, 3), (40, 10), (1 << 20, 200_000)])
def test_words_are_counted_by_windows(monkeypatch, window, flush):
    import pyarrow as pa

    from tallyloom.llm import kernels

    monkeypatch.setattr(suffix_lm, "WINDOW", window)
    rows = [None, "", "a b\ta", " \x0b\n", "é A\u00a0b z" * 9, "z" * 300, "a", "b a \r c"]
    words, got = suffix_lm.WordCounts(), Counter()
    for i in range(0, len(rows), 3):
        for chunk in kernels.chunks(pa.array(rows[i : i + 3], pa.string()), lower=True):
            starts, ends, _ = chunk.spans(kernels.SPACES)
            words.add(chunk, starts, ends)
        if words.table is not None and words.table.num_rows > flush:
            for column, n in words.take():
                got.update(dict(zip(column.to_pylist(), n.tolist(), strict=True)))
            assert words.table is None
    for column, n in words.take():
        got.update(dict(zip(column.to_pylist(), n.tolist(), strict=True)))
    assert got == Counter(w for t in rows for w in (t or "").replace("A", "a").encode().split())
    assert list(words.take()) == []


def test_long_words_after_contexts_have_finite_scores(spark):
    rows = [(i, " ".join(f"k{i % 30 + j}tail k{i % 30 + j}tail v{(i % 30 + j) ** 2}" for j in range(5))) for i in range(1, 121)]
    docs = spark.createDataFrame([(0, "k7tail k7tail " + "#" * 3000), *rows], "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffix_lm.lm_score(docs, training=docs.doc_id > 0).collect()}
    assert out[0]["n_deep"] == 1 and all(math.isfinite(r["score"]) for r in out.values())


def test_hubs_and_equal_rows_score_like_all_others(spark, monkeypatch):
    rng = np.random.default_rng(5)
    turns = ["seldom hurried walkers", "quiet rivers bending", "orange kites over", "jam"]
    rows = [(i, " ".join(rng.choice(turns, int(rng.integers(0, 20))))) for i in range(80)]
    docs = spark.createDataFrame([*rows, *rows[:10], *rows[:5], (None, "a b a"), (None, "a b a"), (None, None)], "doc_id long, text string").repartition(4)
    found = lambda: sorted((r["doc_id"] or -1, r["n_deep"], round(r["score"], 6)) for r in suffix_lm.lm_score(docs, training=~suffix_lm.held_out()).collect())
    want = found()
    assert sum(n for _, n, _ in want) > 500
    hubs, seen = suffix_lm.hub_contexts, []
    monkeypatch.setattr(suffix_lm, "TASK_WORDS", 64)
    monkeypatch.setattr(suffix_lm, "hub_contexts", lambda *args: seen.append(hubs(*args)) or seen[-1])
    got = found()
    assert len(seen[0]) > 3
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)
