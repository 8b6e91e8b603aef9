"""Copies of images by local descriptors (operator 3).

Corners are found at several scales (Harris response, local maxima), turned upright by the intensity centroid of their
patch and described by 128 binary brightness tests, as four 32-bit words.  Two descriptors can meet if one of their eight
16-bit halves differs in at most one bit: the halves are the keys of eight hash tables, and a descriptor asks each for its
own key and the 16 beside it.  Distances up to 15 are always found; of pairs at distance 20, random flips leave 92 %.
Matches vote for a rotation, a scale step and a translation, in bins that overlap by half; images whose matches agree on
one placement are copies, also when cropped, brightened or re-encoded.

Queries are a stated set of images, against all classes of equal images.  The tables hold the corners of a block of
queries, at most about QUERY_CORNERS of them, and are broadcast; images stream past them, one pass for each block, and
their corners, matches and votes never leave the task.  Nothing is shuffled but images that may equal others, and the
pairs that were found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmaps
from .components import connected_components
from .scratch import materialise

#: Scales half an octave apart.
SCALES = (1.0, 0.5**0.5, 0.5)
#: The least response of a corner relative to the strongest within one or two AREA (pixels) of it.
AREA = 32
RESPONSE = 0.01
RADIUS = 11
TESTS = 128
ANGLES = 24
MAX_DISTANCE = 20
#: Pixels and turns (in units of ANGLES) of a vote's bin.
SHIFT_BIN = 12
TURN_BIN = 4
#: Corners that must agree on one placement.
MIN_INLIERS = 6

_rng = np.random.Generator(np.random.PCG64(31))
_pairs = np.clip(np.round(_rng.normal(0, RADIUS / 2.2, (TESTS, 2, 2))), -RADIUS + 3, RADIUS - 3)
_turn = np.arange(ANGLES) * 2 * np.pi / ANGLES
_turned = np.round(np.einsum("aij,tpj->atpi", np.stack([np.stack([np.cos(_turn), -np.sin(_turn)], 1), np.stack([np.sin(_turn), np.cos(_turn)], 1)], 1), _pairs)).astype(int)
_dy, _dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_disc = (_dx**2 + _dy**2 <= RADIUS**2).astype(np.float32)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over a (2r + 1)-square, edges repeated; ``x`` may be a stack of tables, each taken by itself."""
    for axis in (-2, -1):
        n = x.shape[axis]
        total = np.cumsum(np.take(x, np.clip(np.arange(-r - 1, n + r), 0, n - 1), axis=axis), axis=axis)
        hi, lo = (total[..., 2 * r + 1 :, :], total[..., :n, :]) if axis == -2 else (total[..., 2 * r + 1 :], total[..., :n])
        x = (hi - lo) / (2 * r + 1)
    return x


def _greatest_near(x: np.ndarray, r: int) -> np.ndarray:
    """For each place the maximum over a (2r + 1)-square, with nothing beyond the edges."""
    for _ in (0, 1):
        x = np.pad(x, [(r, r), (0, 0)], constant_values=-np.inf)
        n, size = len(x) - 2 * r, 1
        while 2 * size <= 2 * r + 1:  # maxima of ``size`` places from each place on
            x = np.maximum(x[: len(x) - size], x[size:])
            size *= 2
        x = np.maximum(x[:n], x[2 * r + 1 - size : n + 2 * r + 1 - size]).T
    return x


def _shrink(x: np.ndarray, scale: float) -> np.ndarray:
    """Resampled by linear interpolation; at a half that is the mean of four."""
    if scale == 1:
        return x
    for axis in (0, 1):
        n = x.shape[axis]
        at = np.clip((np.arange(int(n * scale)) + 0.5) / scale - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(n - 2, 0))
        part = (at - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        x = np.take(x, lo, axis=axis) * (1 - part) + np.take(x, np.minimum(lo + 1, n - 1), axis=axis) * part
    return x


def _strongest_near(x: np.ndarray) -> np.ndarray:
    """For each place the maximum over its square of AREA and the eight squares around."""
    h, w = x.shape
    tall, wide = -(-h // AREA), -(-w // AREA)
    cells = np.full((tall * AREA, wide * AREA), -np.inf)
    cells[:h, :w] = x
    cells = np.pad(cells.reshape(tall, AREA, wide, AREA).max((1, 3)), 1, constant_values=-np.inf)
    cells = np.max([cells[i : i + tall, j : j + wide] for i in range(3) for j in range(3)], axis=0)
    return np.repeat(np.repeat(cells, AREA, 0), AREA, 1)[:h, :w]


#: Hash tables and bits of a key.
TABLES, KEY_BITS = 8, 16
#: What a key is changed by: no bit or one.
PROBES = np.array([0, *[1 << b for b in range(KEY_BITS)]])
#: Corners of queries that are broadcast at a time (some 80 bytes each, with their places in the tables).
QUERY_CORNERS = 1 << 18
#: Pairs of descriptors that a task compares at a time.
CANDIDATES = 1 << 16
#: Bits of the map of images that equal another one (8 MB, whatever their number).
MAP_BITS = 1 << 26


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y (in the image's pixels), scale index, angle index and four 32-bit words of each corner."""
    out = []
    for level, scale in enumerate(SCALES):
        x = _shrink(image.astype(np.float64), scale)
        if min(x.shape) <= 2 * RADIUS + 2:
            break
        smooth = _box(x, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        top = (response >= _greatest_near(response, 3)) & (response > RESPONSE * np.maximum(_strongest_near(response), 1e-9))
        top[:RADIUS], top[-RADIUS:], top[:, :RADIUS], top[:, -RADIUS:] = False, False, False, False
        ys, xs = np.nonzero(top)
        if not len(ys):
            continue
        patch = x[ys[:, None, None] + _dy, xs[:, None, None] + _dx] * _disc
        angle = np.arctan2((patch * _dy).sum((1, 2)), (patch * _dx).sum((1, 2)))
        angle = np.round(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
        offsets = _turned[angle]
        p = smooth[ys[:, None, None] + offsets[..., 1], xs[:, None, None] + offsets[..., 0]]
        bits = p[:, :, 0] < p[:, :, 1]
        words = np.packbits(bits, axis=1).view(">u4").astype(np.int64)
        px, py = (np.round((z + 0.5) / scale - 0.5).astype(np.int64) for z in (xs, ys))
        out.append((px, py, np.full(len(xs), level), angle, words))
    if not out:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros((0, 4), np.int64))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


#: A corner as stored and broadcast.
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("level", "<i2"), ("angle", "<i2"), ("words", "<u4", (4,))])


def corners_of(height: int | None, width: int | None, pixels: bytes | None) -> np.ndarray:
    """The corners of an image of one byte a pixel; none if its pixels are null, empty or not height x width bytes."""
    if not pixels or height is None or width is None or len(pixels) != height * width:
        return np.zeros(0, CORNER)
    x, y, level, angle, words = describe(np.frombuffer(pixels, np.uint8).reshape(height, width))
    out = np.empty(len(x), CORNER)
    out["x"], out["y"], out["level"], out["angle"], out["words"] = x, y, level, angle, words
    return out


def descriptors(images: DataFrame) -> DataFrame:
    """(image, n, corners) from rows (image, height, width, pixels): an image's corners as the bytes of CORNER records.

    Null or malformed pixels (not height x width bytes), and images without corners, have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [corners_of(*(batch.column(k)[i].as_py() for k in (1, 2, 3))) for i in range(batch.num_rows)]
            some = [i for i, c in enumerate(found) if len(c)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int32())), pa.array([len(found[i]) for i in some], pa.int32()), pa.array([found[i].tobytes() for i in some], pa.binary())], names=["image", "n", "corners"])

    kind = images.schema["image"].dataType.simpleString()
    return images.select("image", "height", "width", "pixels").mapInArrow(run, f"image {kind}, n int, corners binary")


def _keys(words: np.ndarray, table: int) -> np.ndarray:
    """A table's key of each descriptor: half of word ``table // 2``."""
    return (words[:, table // 2] >> np.uint32(KEY_BITS * (table % 2))).astype(np.int64) & ((1 << KEY_BITS) - 1)


def _halves(words: np.ndarray) -> list[np.ndarray]:
    """The 128 bits of each descriptor as two 64-bit numbers."""
    words = words.astype(np.uint64)
    return [words[:, i] << np.uint64(32) | words[:, i + 1] for i in (0, 2)]


class Tables:
    """The corners of some queries and where each key's lie in each table."""

    def __init__(self, corners: np.ndarray, image: np.ndarray):
        self.corners, self.image = corners, image  # of each corner, the place of its query
        first = np.flatnonzero(np.append(True, image[1:] != image[:-1])) if len(image) else np.zeros(0, np.int64)
        self.nth = np.arange(len(image)) - np.repeat(first, np.diff(first, append=len(image)))
        self.order, self.bounds, self.halves = [], [], []
        halves = _halves(corners["words"])
        for k in range(TABLES):
            keys = _keys(corners["words"], k)
            self.order.append(np.argsort(keys, kind="stable").astype(np.int32))
            self.halves.append([x[self.order[-1]] for x in halves])  # in the table's order, so a key's lie side by side
            self.bounds.append(np.searchsorted(keys[self.order[-1]], np.arange((1 << KEY_BITS) + 1)).astype(np.int32))

    def meet(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a query's corner and one of ``corners`` that meet in a table and differ in MAX_DISTANCE bits or
        less, each once, and in how many bits."""
        found = [(np.zeros(0, np.int64),) * 3]
        own = _halves(corners["words"])
        for k in range(TABLES):
            keys = (_keys(corners["words"], k)[:, None] ^ PROBES[None]).ravel()
            some = np.flatnonzero(self.bounds[k][keys + 1] > self.bounds[k][keys])
            start, size = self.bounds[k][keys[some]], self.bounds[k][keys[some] + 1] - self.bounds[k][keys[some]]
            owner = some // len(PROBES)
            before = np.append(0, np.cumsum(size, dtype=np.int64))
            at = 0
            while at < len(some):  # as many keys as have CANDIDATES pairs
                stop = max(at + 1, int(np.searchsorted(before, before[at] + CANDIDATES, "right")) - 1)
                n = size[at:stop]
                place = np.arange(before[stop] - before[at]) + np.repeat(start[at:stop] - (before[at:stop] - before[at]), n)
                d = np.repeat(owner[at:stop], n)
                apart = sum(np.bitwise_count(table[place] ^ mine[d]) for table, mine in zip(self.halves[k], own, strict=True))
                near = np.flatnonzero(apart <= MAX_DISTANCE)
                found.append((self.order[k][place[near]].astype(np.int64), d[near], apart[near].astype(np.int64)))
                at = stop
        q, d, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        _, one = np.unique(q * max(1, len(corners)) + d, return_index=True)
        return q[one], d[one], apart[one]

    def votes(self, corners: np.ndarray, min_inliers: int) -> list[tuple[int, int, int, int]]:
        """(place of the query, inliers, turn, step) for each query with which an image's corners agree on a placement.

        A corner votes with its nearest corners of the other image only, ties included.
        """
        q, d, apart = self.meet(corners)
        owner = self.image[q]
        for one in (q, owner * max(1, len(corners)) + d):
            order = np.lexsort((apart, one))
            first = np.flatnonzero(np.append(True, one[order][1:] != one[order][:-1])) if len(one) else np.zeros(0, np.int64)
            least = np.empty(len(one), np.int64)
            least[order] = np.repeat(apart[order][first], np.diff(first, append=len(one)))
            q_or_d = apart == least
            keep = q_or_d if one is q else keep & q_or_d
        q, d, owner = q[keep], d[keep], owner[keep]
        many = np.bincount(owner) >= min_inliers if len(owner) else np.zeros(0, bool)
        q, d, owner = (x[many[owner]] for x in (q, d, owner)) if len(owner) else (q, d, owner)
        if not len(q):
            return []
        a, b = self.corners[q], corners[d]
        turn = (b["angle"].astype(np.int64) - a["angle"]) % ANGLES
        step = b["level"].astype(np.int64) - a["level"]
        angle, size = turn * (2 * math.pi / ANGLES), (SCALES[0] / SCALES[1]) ** step
        shift = (b["x"] - size * (np.cos(angle) * a["x"] - np.sin(angle) * a["y"]), b["y"] - size * (np.sin(angle) * a["x"] + np.cos(angle) * a["y"]))
        both = lambda value, width: (np.floor(value / width).astype(np.int64) * 2, np.floor(value / width + 0.5).astype(np.int64) * 2 - 1)
        bins = [np.stack([owner, bx, by, bt % (2 * ANGLES // TURN_BIN), step], 1) for bx in both(shift[0], SHIFT_BIN) for by in both(shift[1], SHIFT_BIN) for bt in both(turn, TURN_BIN)]
        rows, place = np.unique(np.concatenate(bins), axis=0, return_inverse=True)
        place = place.ravel()
        corner = lambda x: np.bincount(np.unique(np.stack([place, np.tile(x, len(bins))], 1), axis=0)[:, 0], minlength=len(rows))
        inliers = np.minimum(corner(q), corner(d))
        turns = np.full(len(rows), ANGLES)
        np.minimum.at(turns, place, np.tile(turn, len(bins)))
        best: dict[int, tuple[int, int, int, int]] = {}
        for i in np.flatnonzero(inliers >= min_inliers).tolist():
            vote = (int(inliers[i]), -abs(int(rows[i, 4])), int(turns[i]), int(rows[i, 4]))
            best[int(rows[i, 0])] = max(vote, best.get(int(rows[i, 0]), vote))
        return [(owner, n, turn, step) for owner, (n, _, turn, step) in best.items()]


def _against(queries: DataFrame, images: DataFrame, schema: str, emit: Callable[[Tables, np.ndarray], list[tuple]]) -> DataFrame:
    """What ``emit`` makes of the corners of a block of queries and of each image: rows whose first value is the place
    of a query, before which the query and the image are put.  Both sides have images and corners."""
    spark = queries.sparkSession
    asked = materialise(descriptors(queries), "corners")
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // QUERY_CORNERS))
    known = images if blocks == 1 else materialise(descriptors(images), "corners")
    raw = blocks == 1
    kinds = [asked.schema["image"].dataType, images.schema["image"].dataType]
    whole = f"q_image {kinds[0].simpleString()}, d_image {kinds[1].simpleString()}, {schema}"
    names = [f.name for f in T.StructType.fromDDL(whole).fields]
    out = None
    for i in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("image"), F.lit(blocks)) == i).toArrow().sort_by("image").combine_chunks()
        ids = part["image"].combine_chunks().dictionary_encode(null_encoding="encode") if part.num_rows else None
        corners = [np.frombuffer(c, CORNER) for c in part["corners"].to_pylist()]
        which = np.repeat(ids.indices.to_numpy(), [len(c) for c in corners]) if part.num_rows else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast((np.concatenate([*corners, np.zeros(0, CORNER)]), which.astype(np.int64), ids.dictionary if ids is not None else pa.array([], pa.int64())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            corners, which, ids = shared.value
            if not len(corners):
                return
            tables = Tables(corners, which)
            for batch in batches:
                rows = []
                for k in range(batch.num_rows):
                    found = corners_of(*(batch.column(c)[k].as_py() for c in (1, 2, 3))) if raw else np.frombuffer(batch.column(2)[k].as_py(), CORNER)
                    rows += [(k, *r) for r in emit(tables, found)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[1])), batch.column(0).take(pa.array(columns[0])), *[pa.array(c, pa.int32()) for c in columns[2:]]], names=names)

        columns = ["image", "height", "width", "pixels"] if raw else ["image", "n", "corners"]
        now = known.select(*columns).mapInArrow(run, whole)
        out = now if out is None else out.unionByName(now)
    return out


def matches(queries: DataFrame, images: DataFrame) -> DataFrame:
    """The pairs of descriptors that meet in a table and differ in MAX_DISTANCE bits or less, each once: q_image, d_image,
    q_corner, d_corner (places among the image's corners) and ``apart``, in how many bits."""

    def emit(tables: Tables, corners: np.ndarray) -> list[tuple]:
        q, d, apart = tables.meet(corners)
        return list(zip(tables.image[q].tolist(), tables.nth[q].tolist(), d.tolist(), apart.tolist(), strict=True))

    return _against(queries, images, "q_corner int, d_corner int, apart int", emit)


def _content() -> Column:
    return F.sha2(F.concat_ws("x", F.col("height").cast("string"), F.col("width").cast("string"), F.sha2("pixels", 256)), 256)


def image_classes(images: DataFrame) -> DataFrame:
    """(image, class): the smallest id of the images equal to each image; images with null pixels have no class.  An id
    of several images has a row for each of their classes."""
    each = materialise(images.filter("pixels IS NOT NULL").select("image", _content().alias("_content")).distinct(), "contents")
    least = each.groupBy("_content").agg(F.min("image").alias("class"))
    return each.join(least, "_content").select("image", "class")


def _first_of_class(images: DataFrame) -> DataFrame:
    """The images whose id is the smallest of their class.  Ids and hashes are shuffled, and the few images that a map
    of bits takes for later members: all others stay where they are."""
    images = images.filter("pixels IS NOT NULL").select("image", "height", "width", "pixels", _content().alias("_content"))
    each = materialise(images.select("image", "_content").distinct(), "contents")
    later = each.join(each.groupBy("_content").agg(F.min("image").alias("_least")), "_content").filter("image > _least").select("image", "_content")
    spot = F.pmod(F.xxhash64("image", "_content"), F.lit(MAP_BITS))
    first, asked = bitmaps.split(images, spot, bitmaps.pages(later.select(spot.alias("at")), "at"))
    narrow = asked.join(later, ["image", "_content"], "left_anti")
    return first.unionByName(narrow.select(first.columns)).drop("_content")


def image_copies(queries: DataFrame, images: DataFrame, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """(query, image, inliers, turn, level_step): classes of images that hold a copy of a query's content.  A level step is half an octave.

    Both tables have rows (image, height, width, pixels); ``image`` of the result is the smallest id of its class of
    equal images.  Ids that repeat are searched together, rows without an id like any id; the best placement counts, the
    nearest level step if inliers tie.  Null and malformed pixels match nothing.  An empty table on either side gives no
    rows.  Other columns are left out.  An image is described in memory, so a task holds some 200 bytes a pixel of it.
    """
    found = _against(queries, _first_of_class(images), "inliers int, turn int, step int", lambda tables, corners: tables.votes(corners, min_inliers))
    best = found.groupBy("q_image", "d_image").agg(F.max(F.struct("inliers", (-F.abs("step")).alias("near"), "turn", "step")).alias("m"))
    return best.select(F.col("q_image").alias("query"), F.col("d_image").alias("image"), F.col("m.inliers").alias("inliers"), F.col("m.turn").alias("turn"), F.col("m.step").alias("level_step"))


CELL = 2


def recurrence_images(vectors: DataFrame, image: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Images from numeric vectors: recurrence plots, each pair of values a square whose brightness is their distance.

    Null, empty and non-finite vectors have null pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, sides = [], []
            for v in batch.column(1).to_pylist():
                v = np.array([x if x is not None else np.nan for x in v or []], float)
                if not len(v) or not np.isfinite(v).all():
                    pixels.append(None)
                    sides.append(None)
                    continue
                apart = np.abs(v[:, None] - v[None, :])
                grey = np.round(apart / (apart.max() or 1) * 255).astype(np.uint8)
                pixels.append(np.kron(grey, np.ones((CELL, CELL), np.uint8)).tobytes())
                sides.append(len(v) * CELL)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sides, pa.int32()), pa.array(sides, pa.int32()), pa.array(pixels, pa.binary())], names=["image", "height", "width", "pixels"])

    kind = vectors.schema[image].dataType.simpleString()
    return vectors.select(F.col(image).alias("image"), F.col(values).alias("v")).mapInArrow(run, f"image {kind}, height int, width int, pixels binary")


def edited(images: DataFrame, crop: int = 14, gain: float = 0.8, lift: float = 20.0) -> DataFrame:
    """Each image without ``crop`` pixels at its top and left, and with another contrast and brightness; null pixels for
    images that are malformed or no larger than the crop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, raw in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                if raw is None or h is None or w is None or len(raw) != h * w or h <= crop or w <= crop:
                    out.append((None, None, None))
                    continue
                x = np.frombuffer(raw, np.uint8).reshape(h, w)[crop:, crop:]
                out.append((h - crop, w - crop, np.clip(np.round(x * gain + lift), 0, 255).astype(np.uint8).tobytes()))
            h, w, raw = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(raw, pa.binary())], names=["image", "height", "width", "pixels"])

    return images.mapInArrow(run, images.schema)


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: edited copies of the images whose id is divisible by 50; index: every row's image.

    One row for each image, so a group of near copies has as many rows as members and not one for each of its links:
    ``image``; ``class``, the smallest id of the images equal to it (null without pixels; an id of several images has a
    row for each class); ``component``, the smallest id that links reach, where a link joins a query with a class that its
    copy matches and a member with its class; ``n_queries``, the queries whose copies match its class.  Null if the
    image is no query: ``n_found``, the classes that its copy matches; ``itself``, whether its own class is one of them;
    ``best`` (the class with most inliers), ``inliers``, ``turn`` and ``level_step``.  ``image_copies`` gives the links.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # a vector is short but its image takes long to describe: rows are dealt evenly, whatever the files' sizes
    vectors = vectors.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")
    asked = vectors.filter("vec_id % 50 = 0")
    images = recurrence_images(vectors)
    found = materialise(image_copies(edited(recurrence_images(asked)), images), "copies")
    classes = materialise(image_classes(images), "members")
    component = connected_components(found.select("query", "image").union(classes.select("image", "class")))
    met = found.groupBy("image").agg(F.count("*").alias("n_queries")).withColumnRenamed("image", "class")
    best = F.max(F.struct("inliers", (-F.abs("level_step")).alias("near"), (-F.col("image")).alias("least"), "turn", "level_step")).alias("m")
    own = asked.select(F.col("vec_id").alias("image")).distinct().join(found.groupBy(F.col("query").alias("image")).agg(F.count("*").alias("n_found"), best), "image", "left")
    own = own.select("image", F.coalesce("n_found", F.lit(0)).alias("n_found"), (-F.col("m.least")).alias("best"), *[f"m.{c}" for c in ("inliers", "turn", "level_step")])
    itself = found.select(F.col("query").alias("image"), F.col("image").alias("class"), F.lit(True).alias("_hit"))
    rows = vectors.select(F.col("vec_id").alias("image")).distinct().join(classes, "image", "left").join(component.withColumnRenamed("node", "image"), "image", "left").join(own, "image", "left")
    rows = rows.join(itself, ["image", "class"], "left").join(met, "class", "left")
    return rows.select(
        "image", "class", F.when(F.col("class").isNotNull(), F.coalesce("component", "image")).alias("component"), F.when(F.col("class").isNotNull(), F.coalesce("n_queries", F.lit(0))).alias("n_queries"),
        "n_found", F.when(F.col("n_found").isNotNull(), F.coalesce("_hit", F.lit(False))).alias("itself"), "best", "inliers", "turn", "level_step",
    )
