"""N-gram Jaccard join, components and images against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from tallyloom import storage
from tallyloom.llm import images, jaccard, kernels
from tallyloom.llm.components import connected_components


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 75 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(3)) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, base = [], [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    for i, text in enumerate(base):
        rows.append((i * 10, text))
        for j in range(rng.randint(0, 8)):
            words = text.split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            rows.append((i * 10 + j + 1, "\t".join(words)))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "one two"), (None, base[0]), (2006, base[0]), (2006, base[1])]
    return rows


@pytest.mark.parametrize("linear", [0, 32])
def test_components_equal_brute_force(spark, monkeypatch, linear):
    monkeypatch.setattr(jaccard, "LINEAR", linear)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 8)
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 7)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component string").repartition(3)
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(docs).collect()], key=str)
    assert got == brute(rows)


def test_a_group_of_near_copies_that_are_mostly_no_links(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((2, 3, 4, 5))):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(docs).collect()], key=str)
    want = brute(rows)
    assert got == want and 5 < len({c for _, _, c in want}) < 155


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for n in (3, 40, 400, 3000):
        for _ in range(20):
            union = rng.integers(0, 2**63, n).astype(np.uint64)
            sets = [np.unique(union[rng.random(n) < 0.9]) for _ in range(2)]
            apart = int(np.bitwise_count(np.bitwise_xor(*jaccard.sketch(sets)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(*sets))


@pytest.mark.parametrize("hub, share", [(1024, 1000), (3, 1), (1, 1000)])
def test_hubs_are_dealt_to_several_tasks(spark, monkeypatch, hub, share):
    from tallyloom.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(components, "HUB_SHARE", share)
    monkeypatch.setattr(components, "HELD", 5)
    links = [(1, i) for i in range(2, 60)] + [(i, i + 100) for i in range(2, 60)] + [(500, 501), (501, 502), (500, 159)] + [(900, 901)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "x long, y long").repartition(4)).collect()}
    assert got == {i: 1 for a in links[:-1] for i in a if i != 1} | {901: 900}


def test_keep_one_leaves_one_of_each_group(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "keep", 1, 2) for i, t in rows], "doc_id long, text string, extra string, _gone int, component_id int")
    kept = jaccard.keep_one(docs).collect()
    want = {c for _, _, c in brute(rows) if c is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in kept) == 1 and kept[0]["extra"] == "keep"


def test_long_texts_are_compared_whole(spark):
    words = [f"w{i * 7919 % 1_000_003}" for i in range(120_000)]
    near, other = list(words), list(words)
    for i in range(0, 120_000, 100):
        near[i] = f"n{i}"
    for i in range(60_000, 120_000):
        other[i] = f"o{i}"
    docs = spark.createDataFrame([(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(other)), (4, "a b")], "doc_id long, text string").repartition(2)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(docs).collect()}
    assert got == {(3, 119_996, 2), (2, 119_996, 2), (1, 119_996, 1), (4, 1, 4)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.ngram_jaccard(docs).collect() == []


def test_prefix_lemma_holds_for_any_estimates():
    rng = np.random.default_rng(1)
    for _ in range(300):
        union = rng.choice(10_000, rng.integers(4, 60), replace=False).astype(np.uint64)
        a, b = (np.sort(union[rng.random(len(union)) < 0.93]) for _ in range(2))
        if not len(a) or not len(b):
            continue
        estimate = lambda s: ((s * np.uint64(2654435761)) % np.uint64(7)).astype(np.int32) * 4
        (x, _, m), (y, _, n) = jaccard.prefix(a, estimate(a)), jaccard.prefix(b, estimate(b))
        both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        met = len(np.intersect1d(x, y))
        if 100 * both >= 75 * every:
            rest = max(len(a) - len(x), len(b) - len(y))
            assert met >= min(m, n)
            assert met + rest >= -(-75 * (len(a) + len(b)) // 175)


def test_postings_are_narrow_and_counts_go_once_read(spark):
    rng = np.random.default_rng(1)
    salt, n, m = rng.integers(0, 1 << 22, 1000), int(2**31 - 1), 24
    assert all((x == y).all() for x, y in zip(jaccard.unplace(jaccard.place(salt, n, m)), (salt, n, m), strict=True))
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(20)], "doc_id long, text string")
    before = set(storage._written)
    known = jaccard.frequencies(jaccard.summaries(docs, 5))
    assert len(known.shingles[0]) and not [p for p in storage._written if p not in before and "frequent" in p]


def test_whole_sets_are_made_for_allowed_pairs_only_and_never_stored(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    names, wanted, stored, whole = [], [], jaccard.materialise, jaccard.whole_sets

    def whole_sets(docs, of, k):
        wanted.append(of.count())
        return whole(docs, of, k)

    monkeypatch.setattr(jaccard, "materialise", lambda df, name: names.append(name) or stored(df, name))
    monkeypatch.setattr(jaccard, "whole_sets", whole_sets)
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(docs).collect()], key=str)
    assert got == brute(rows)
    assert "allowed" in names and "whole" not in names and "sketches" not in names
    # two texts with half of their shingles in common are a pair, but neither gets its whole set
    words = [f"w{i}" for i in range(120)]
    pair = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:80] + [f"o{i}" for i in range(40)]))], "doc_id long, text string")
    drawn = jaccard.sketches(jaccard.summaries(pair, 5))
    wanted.clear()
    met = stored(spark.createDataFrame([(1, 2)], "a long, b long"), "met")
    assert jaccard.verify(pair, met, drawn, 5, 75).collect() == [] and wanted == [0]


def test_connected_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "x long, y long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}


def test_few_links_take_no_rounds_and_more_give_the_same(spark, monkeypatch):
    from tallyloom.llm import components

    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(None, 3), (-5, 7)]
    table = spark.createDataFrame(links, "x long, y long").repartition(4)
    names = []
    monkeypatch.setattr(components, "materialise", lambda df, name, keep=components.materialise: names.append(name) or keep(df, name))
    got = {r["node"]: r["component"] for r in connected_components(table).collect()}
    assert names == ["links", "components"]
    monkeypatch.setattr(components, "FEW", 10)
    assert got == {r["node"]: r["component"] for r in connected_components(table).collect()} and len(names) > 6
    assert got[60] == -5 and all(got.get(a, a) == got.get(b, b) for a, b in links if a is not None)
    assert connected_components(table.limit(0)).collect() == []


@pytest.mark.parametrize("hub, share", [(1024, 1000), (3, 1), (1, 1000)])
def test_hubs_are_dealt_in_rounds(spark, monkeypatch, hub, share):
    from tallyloom.llm import components

    monkeypatch.setattr(components, "FEW", -1)
    test_hubs_are_dealt_to_several_tasks(spark, monkeypatch, hub, share)


def test_a_long_chain_settles_in_rounds(spark, monkeypatch):
    from tallyloom.llm import components

    monkeypatch.setattr(components, "FEW", -1)
    test_connected_components_of_a_long_chain(spark)


def test_kernel_words_and_hashes():
    import pyarrow as pa

    texts = ["", "a b", None, "b a", " a\x0bb\n", "é à", "a b"]
    chunk = next(kernels.chunks(pa.array(texts), lower=True))
    starts, ends, bounds = chunk.spans(kernels.SPACES)
    hashes = chunk.span_hash(chunk.prefix_hash(), starts, ends)
    words = [[bytes(chunk.data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert words == [(t or "").split() for t in texts]
    assert hashes[0] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 4


def picture(seed, size=(110, 130)):
    rng = np.random.default_rng(seed)
    x = np.kron(rng.integers(0, 256, (14, 14)), np.ones((10, 10)))[: size[0], : size[1]]
    return x.astype(np.uint8)


def test_copies_are_found_and_others_are_not(spark):
    base = {i: picture(i) for i in range(12)}
    dark = np.clip(base[3][10:100, 16:] * 0.7 + 10, 0, 255).astype(np.uint8)
    turned = np.rot90(base[4]).copy()
    frame = lambda d: spark.createDataFrame([(i, x.shape[0], x.shape[1], bytearray(x.tobytes())) for i, x in d.items()], "image long, height int, width int, pixels binary")
    index = {**base, 50: base[5]}
    found = images.image_copies(frame({103: dark, 104: turned, 105: base[5], 106: picture(99)}), frame(index)).collect()
    pairs = {(r["query"], r["image"]) for r in found}
    assert pairs == {(103, 3), (104, 4), (105, 5)}
    assert next(r for r in found if r["query"] == 105)["inliers"] >= 12


def test_images_that_cannot_be_read_are_left_out(spark):
    rows = [(1, None, None, None), (2, 3, 3, bytearray(b"x")), (3, 4, 4, bytearray(b"\x00" * 16)), (4, 0, 0, bytearray())]
    bad = spark.createDataFrame(rows, "image long, height int, width int, pixels binary")
    assert images.image_copies(bad, bad).collect() == []


def test_recall_of_edited_images(spark, sf):
    found = images.op3_image_copies(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert sum(r["itself"] or False for r in found) >= 0.9 * n


def test_rows_hold_every_match_and_every_member(spark, tmp_path):
    rng = np.random.default_rng(4)
    a, b = (np.cumsum(rng.normal(size=64)) for _ in range(2))
    near = a + np.where(np.arange(64) == 60, 0.05, 0)
    rows = [(50, a.tolist()), (51, a.tolist()), (52, near.tolist()), (53, near.tolist()), (54, b.tolist()), (100, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["image"]: (r["class"], r["component"], r["n_queries"], r["n_found"], r["itself"], r["best"]) for r in images.op3_image_copies(spark, str(tmp_path)).collect()}
    assert got == {
        50: (50, 50, 1, 2, True, 50), 51: (50, 50, 1, None, None, None), 52: (52, 50, 1, None, None, None), 53: (52, 50, 1, None, None, None),
        54: (54, 54, 0, None, None, None), 100: (None, None, None, 0, False, None),
    }


def test_a_group_of_near_copies_has_a_row_for_each_member(spark, tmp_path):
    """Six queries and their near copies, all alike: 36 links between queries alone, but a row for each image."""
    rng = np.random.default_rng(5)
    a = np.cumsum(rng.normal(size=64))
    ids = [k * 50 + j for k in range(1, 7) for j in range(2)]
    rows = [(i, (a + np.where(np.arange(64) == 60, 0.01 * k, 0)).tolist()) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = images.op3_image_copies(spark, str(tmp_path)).collect()
    assert sorted(r["image"] for r in got) == ids and {r["component"] for r in got} == {50}
    images_ = images.recurrence_images(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    links = images.image_copies(images.edited(images_.filter("image % 50 = 0")), images_).collect()
    assert len(links) > len(ids) and sum(r["n_found"] or 0 for r in got) == len(links)
    of_class = {r["class"]: r["n_queries"] for r in got}
    assert sum(of_class.values()) == len(links)


def scene(seed, size=(160, 160)):
    rng = np.random.default_rng(seed)
    x = sum(np.kron(rng.normal(0, 1, (size[0] // b + 1, size[1] // b + 1)), np.ones((b, b)))[: size[0], : size[1]] * b for b in (5, 12, 31))
    return np.clip(np.round(128 + 2.5 * x), 0, 255).astype(np.uint8)


def resized(x, factor):
    at = [np.clip((np.arange(round(n * factor)) + 0.5) / factor - 0.5, 0, n - 1) for n in x.shape]
    lo = [np.minimum(a.astype(int), n - 2) for a, n in zip(at, x.shape, strict=True)]
    v, u = (at[0] - lo[0])[:, None], (at[1] - lo[1])[None]
    take = lambda i, j: x[lo[0] + i][:, lo[1] + j].astype(float)
    return np.round((1 - v) * ((1 - u) * take(0, 0) + u * take(0, 1)) + v * ((1 - u) * take(1, 0) + u * take(1, 1))).astype(np.uint8)


def encoded(x, step=40):
    """Cosine transform of blocks of 8, rounded to ``step``, and back."""
    h, w = (n // 8 * 8 for n in x.shape)
    k, n = np.mgrid[:8, :8]
    c = np.cos(np.pi * k * (2 * n + 1) / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    blocks = x[:h, :w].astype(float).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    back = c.T @ (np.round(c @ blocks @ c.T / step) * step) @ c
    return np.clip(np.round(back.transpose(0, 2, 1, 3).reshape(h, w)), 0, 255).astype(np.uint8)


def noisy(x, seed=1, sigma=14):
    return np.clip(np.round(x + np.random.default_rng(seed).normal(0, sigma, x.shape)), 0, 255).astype(np.uint8)


def table_of(spark, d):
    return spark.createDataFrame([(i, x.shape[0], x.shape[1], bytearray(x.tobytes())) for i, x in d.items()], "image long, height int, width int, pixels binary")


def test_repeated_ids_null_ids_ties_and_blocks_of_queries(spark, monkeypatch):
    base = {i: scene(i) for i in range(4)}
    rows = [(i, 160, 160, bytearray(x.tobytes()), "extra") for i, x in base.items()]
    rows += [(0, 160, 160, bytearray(base[1].tobytes()), "x"), (None, 160, 160, bytearray(base[2].tobytes()), "x"), (9, 160, 160, bytearray(base[3].tobytes()), "x"), (9, 160, 160, bytearray(base[3].tobytes()), "x")]
    index = spark.createDataFrame(rows, "image long, height int, width int, pixels binary, _content string").repartition(3)
    asked = spark.createDataFrame([*[(str(i), *r[1:]) for i, r in enumerate(rows)], (None, *rows[0][1:]), ("1", *rows[3][1:])], "image string, height int, width int, pixels binary, q_image string")
    want = {("0", 0), ("1", 0), ("2", 2), ("3", 3), ("4", 0), ("5", 2), ("6", 3), ("7", 3), (None, 0), ("1", 3), ("2", None), ("5", None)}
    found = [{(r["query"], r["image"]): r["inliers"] for r in images.image_copies(asked, index).collect()}]
    for name, value in (("QUERY_CORNERS", 300), ("CANDIDATES", 50)):
        monkeypatch.setattr(images, name, value)
        found.append({(r["query"], r["image"]): r["inliers"] for r in images.image_copies(asked, index).collect()})
    assert found[0] == found[1] == found[2] and set(found[0]) - {("2", None), ("5", None)} == want - {("2", None), ("5", None)}
    assert images.image_copies(asked.limit(0), index).collect() == images.image_copies(asked, index.limit(0)).collect() == []
    classes = {(r["image"], r["class"]) for r in images.image_classes(index).collect()}
    assert classes == {(0, 0), (1, 0), (0, 0), (2, 2), (None, 2), (3, 3), (9, 3)}


def by_hand_votes(query, image):
    """The most corners that agree on a placement, by brute force over pairs of corners and bins."""
    a, b = images.corners_of(*query.shape, query.tobytes()), images.corners_of(*image.shape, image.tobytes())
    apart = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(p["words"], q["words"], strict=True)) for q in b] for p in a])
    near = np.array([[any((int(p["words"][k // 2] ^ q["words"][k // 2]) >> 16 * (k % 2) & 0xFFFF).bit_count() <= 1 for k in range(8)) for q in b] for p in a])
    apart = np.where(near & (apart <= images.MAX_DISTANCE), apart, 999)
    bins = {}
    for i, j in zip(*np.nonzero(apart < 999), strict=True):
        if apart[i, j] != apart[i].min() or apart[i, j] != apart[:, j].min():
            continue
        turn, step = (int(b[j]["angle"]) - int(a[i]["angle"])) % 24, int(b[j]["level"]) - int(a[i]["level"])
        t, z = turn * 2 * np.pi / 24, (1 / 0.5**0.5) ** step
        x = b[j]["x"] - z * (np.cos(t) * a[i]["x"] - np.sin(t) * a[i]["y"])
        y = b[j]["y"] - z * (np.sin(t) * a[i]["x"] + np.cos(t) * a[i]["y"])
        halves = lambda v, w: (int(np.floor(v / w)) * 2, int(np.floor(v / w + 0.5)) * 2 - 1)
        for bx in halves(x, 12):
            for by in halves(y, 12):
                for bt in halves(turn, 4):
                    bins.setdefault((bx, by, bt % 12, step), []).append((i, j))
    return max((min(len({i for i, _ in m}), len({j for _, j in m})) for m in bins.values()), default=0)


def test_votes_equal_brute_force(spark):
    base = {i: scene(i, (90, 90)) for i in range(3)}
    edits = {10: np.rot90(base[0]).copy(), 11: base[1][8:, 5:].copy(), 12: noisy(base[2])}
    got = {(r["query"], r["image"]): r["inliers"] for r in images.image_copies(table_of(spark, edits), table_of(spark, base), min_inliers=1).collect()}
    want = {(q, d): by_hand_votes(x, y) for q, x in edits.items() for d, y in base.items()}
    assert got == {p: n for p, n in want.items() if n} and min(got[i + 10, i] for i in range(3)) >= 6


def test_tables_meet_what_brute_force_finds(spark):
    base = {i: scene(i) for i in range(8)}
    edits = {100 * k + i: f(x) for i, x in base.items() for k, f in enumerate((noisy, encoded, lambda x: resized(x, 0.9), lambda x: x[50:130, 50:130]), 1)}
    got = {(r["q_image"], r["q_corner"], r["d_image"], r["d_corner"]) for r in images.matches(table_of(spark, edits), table_of(spark, base)).collect()}
    q, d = ([(i, k, w) for i, x in t.items() for k, w in enumerate(images.describe(x)[4])] for t in (edits, base))
    a, b = (np.array([w for _, _, w in t]) for t in (q, d))
    apart = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(int) for k in range(4))
    want = {(*q[i][:2], *d[j][:2]): apart[i, j] for i, j in zip(*np.nonzero(apart <= images.MAX_DISTANCE), strict=True)}
    assert got <= set(want) and {p for p, n in want.items() if n <= 15} <= got
    for k in range(1, 5):
        mine = [p for p in want if p[0] // 100 == k]
        assert len(mine) > 50 and sum(p in got for p in mine) >= 0.9 * len(mine)


def test_small_crops_resized_and_faint_copies_are_found(spark):
    base = {i: scene(i, (320, 320)) for i in range(6)}
    base[6] = np.where(np.arange(320)[:, None] < 160, base[0], np.round(110 + 0.1 * (scene(77, (320, 320)) - 110.0))).astype(np.uint8)
    edits = {100 * k + i: f(base[i]) for i in range(6) for k, f in enumerate((lambda x: x[120:200, 90:170], lambda x: resized(x, 0.7), lambda x: resized(x, 0.8), encoded, noisy), 1)}
    edits[906] = base[6][180:300, 60:260]
    found = {(r["query"], r["image"]) for r in images.image_copies(table_of(spark, edits), table_of(spark, base)).collect()}
    for k in range(1, 6):
        assert sum((100 * k + i, i) in found for i in range(6)) >= 0.9 * 6, k
    assert (906, 6) in found
    assert sum(q % 100 != i and (q % 100, i) not in {(0, 6), (6, 0)} for q, i in found) <= 0.1 * len(found)


def test_many_corners_under_one_key_are_compared_in_small_blocks():
    """4,000 corners of queries against 250 under one key: a million pairs, of which a task holds few at a time."""
    rng = np.random.default_rng(12)
    table, asked = np.zeros(4000, images.CORNER), np.zeros(250, images.CORNER)
    for x in (table, asked):
        x["words"][:, 1:] = rng.integers(0, 2**32, (len(x), 3), dtype=np.uint32)
        x["words"][:10, 1:] = 7
    tables = images.Tables(table, np.arange(len(table)))
    tracemalloc.start()
    q, d, apart = tables.meet(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.bitwise_count(table["words"][:, None] ^ asked["words"][None]).sum(2, dtype=np.int64)
    want = np.argwhere(whole <= images.MAX_DISTANCE)
    assert len(want) == 100 and np.array_equal(np.stack([q, d], 1), want) and np.array_equal(apart, whole[tuple(want.T)])
    assert peak < 16e6  # 53 MB when as many as 2**20 pairs were held
