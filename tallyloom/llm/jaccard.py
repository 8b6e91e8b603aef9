"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes (operator 9).

A document is the set of its distinct word shingles.  Shingles have one global order, by estimated frequency and then
by hash.  The estimate is the larger of what the frequencies of the shingle's words let expect and the counts of shingles
that recur within tasks; both tables have a fixed bound.  If two sets r and s reach the threshold t, they
share at least ceil(t * |r|) shingles of r, so for any l the first |r| - ceil(t * |r|) + l shingles of both share l or
more.  Each document takes the l of least estimated cost: a longer prefix costs more postings, but candidates must then
share more of it: what the prefixes do not share can only lie behind one of them, so a pair is a candidate if the shared
part of its prefixes and the longer of its rests add up to the overlap that the threshold asks of sets of these sizes
(at least min(l_r, l_s) shared shingles, and far more for sets of like size).  Candidates are verified on whole sets.

Links need not be listed pair by pair, so no group is expanded into its pairs:

1. equal sets are linked through one representative per task and set;
2. within each posting list every document is first compared with the list's smallest one only, and verified if they
   share enough in this way;
3. what those links connect is one component; long lists that still hold many pairs between components are thinned by
   turns in which each document meets a few others of its list;
4. documents of different components that meet in a list are paired only if their sketches allow the overlap that the
   threshold asks for, then go through the multi-match count and are verified, so no link that could join two components
   is lost;
5. connected components of all verified links.

A sketch is the parity of a set's shingles in each of SKETCH_BITS classes of their hash.  Two sketches differ in at most
as many bits as the sets differ in shingles, so a pair whose sketches differ in more than the threshold allows is no link.
The join of a list with itself tests that as part of its condition: a group of near copies in which few pairs are links
gives about as many rows as links, and each row is 64 bytes wide however long the texts are.

Estimates only choose the order and l, so they never change the result.
Long posting lists are dealt to several tasks by a salt, and their pairs by blocks of rows on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitmaps
from . import kernels as K
from .components import connected_components, join_dealt
from .scratch import discard, materialise, passing

SHINGLE = 5
PERCENT = 75
#: Words of this share of all words or more are broadcast (1 / COMMON at most); rarer ones count as just below it.
COMMON = 2.0**-17
#: At most so many counts of recurring shingles are broadcast, 12 bytes each.
MAX_FREQUENT = 1 << 20
#: A task's counts are cut to the recurring ones when so many have gathered.
FLUSH = 1 << 21
#: Rows of a posting list that one task takes.
LIST_ROWS = 1 << 14
MATCHES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24])
#: Cost of verifying a candidate against that of a posting.
VERIFY_COST = 4.0
#: Bits of the map of document ids that need whole sets (8 MB, whatever the input).
MAP_BITS = 1 << 26


#: Lists whose pairs between components are more than so many times their rows are first thinned by comparing each
#: document with PIVOTS others, as long as that halves the pairs.
LINEAR = 32
PIVOTS = 8


#: Bits of a sketch, and its columns.
SKETCH_BITS = 512
SKETCH = [f"k{i}" for i in range(SKETCH_BITS // 64)]
#: Rows of a list that one task pairs with as many others.
PAIR_ROWS = 1 << 12


#: Bits of a posting's l and size in the number that it is sorted by; the rest is its salt.
L_BITS, N_BITS = 5, 32


LIST_COLUMNS = ["h", "salt", "doc_id", "n", "l", "pivot", "pivot_n", "pivot_l", "met"]
LIST_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def required(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Shingles that a set of n must share with any partner."""
    return (percent * n + 99) // 100


def _words(column: pa.Array) -> Iterator[tuple[K.Chunk, np.ndarray, np.ndarray]]:
    for chunk in K.chunks(column, lower=True):
        starts, ends, bounds = chunk.spans(K.SPACES)
        yield chunk, chunk.span_hash(chunk.prefix_hash(), starts, ends), bounds


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for chunk, hashes, bounds in _words(column):
        yield from zip(chunk.rows, [s for s, _ in K.shingle_sets(hashes, bounds, k)], strict=True)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array start."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


class Tally:
    """Counts of hashes in a task; beyond FLUSH, those seen less than ``least`` times are let go."""

    def __init__(self, least: int):
        self.least, self.held, self.room = least, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.room += len(x)
        if self.room > FLUSH:
            self.settle()

    def settle(self) -> None:
        x = np.sort(np.concatenate([*self.held, np.zeros(0, np.uint64)]))
        self.held, self.room = [], 0
        at = _runs(x)
        keys, counts = np.concatenate([self.keys, x[at]]), np.concatenate([self.counts, np.diff(at, append=len(x))])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = _runs(keys)
        counts = np.add.reduceat(counts, at) if len(at) else counts
        keep = counts >= self.least
        self.keys, self.counts = keys[at][keep], counts[keep]


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _batch(schema: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()) if isinstance(c, np.ndarray) else c, t) for c, t in columns], names=schema)


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """Stored rows of three kinds from (doc_id, text): documents (doc_id, n, key, rep, and the set's sketch), shingles and
    words (n, hash).

    ``rep`` is the first document of the task with the same set.  Shingles come with their counts over the task's
    distinct sets, where that is two or more, words where they are COMMON of the task's words; the number of all words
    comes as a word with hash null.
    """
    names = ["kind", "doc_id", "n", "key", "rep", "hash", *SKETCH]

    def batch_of(kind: int, size: int, n, doc_id=None, key=None, rep=None, hashes=None, drawn=None) -> pa.RecordBatch:
        none = [None] * size
        columns = [([kind] * size, pa.int32()), (doc_id, pa.int64()), (n, pa.int64()), (key, pa.binary()), (rep, pa.int64()), (hashes, pa.int64())]
        columns += [(None if drawn is None else drawn[:, i], pa.int64()) for i in range(len(SKETCH))]
        return _batch(names, *[(none if c is None else c, kind) for c, kind in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps: dict[bytes, int] = {}
        shingles, words, n_words = Tally(2), Tally(2), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            size, keys, first = np.zeros(len(ids), np.int64), [b""] * len(ids), [None] * len(ids)
            drawn = np.zeros((len(ids), len(SKETCH)), np.int64)
            for chunk, hashes, bounds in _words(batch.column(1)):
                words.add(hashes)
                n_words += len(hashes)
                sets = [s for s, _ in K.shingle_sets(hashes, bounds, k)]
                drawn[chunk.rows] = sketch(sets)
                for i, s in zip(chunk.rows, sets, strict=True):
                    size[i], keys[i] = len(s), _key(s)
                    if len(s) and ids[i] is not None:
                        if keys[i] not in reps:
                            shingles.add(s)
                        first[i] = reps.setdefault(keys[i], ids[i])
            yield batch_of(0, len(ids), size, ids, keys, first, drawn=drawn)
        shingles.settle()
        words.settle()
        often = words.counts >= n_words * COMMON
        for kind, x, n in ((1, shingles.keys, shingles.counts), (2, words.keys[often], words.counts[often])):
            for i in range(0, len(x), 100_000):
                part = K.as_long(x[i : i + 100_000])
                yield batch_of(kind, len(part), n[i : i + 100_000], hashes=part)
        yield batch_of(2, 1, [n_words])

    return materialise(docs.mapInArrow(run, f"kind int, doc_id long, n long, key binary, rep long, hash long, {', '.join(f'{c} long' for c in SKETCH)}"), "sets")


@dataclass
class Frequencies:
    """Hashes in order with quarter powers of two: of words' shares (negative) and of recurring shingles' counts."""

    words: tuple[np.ndarray, np.ndarray]
    shingles: tuple[np.ndarray, np.ndarray]
    total: int  # quarter powers of two of all words

    @staticmethod
    def quarters(x: np.ndarray | float) -> np.ndarray:
        return np.round(4 * np.log2(np.maximum(x, 1e-12))).astype(np.int32)

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], x: np.ndarray, default: int) -> np.ndarray:
        keys, values = table
        out = np.full(len(x), default, np.int32)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[at] == x
            out[hit] = values[at[hit]]
        return out

    def word_shares(self, hashes: np.ndarray) -> np.ndarray:
        return self.find(self.words, hashes, int(self.quarters(COMMON)))

    def of(self, s: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Estimated frequencies of shingles, in quarter powers of two, from their words' shares and their counts."""
        return np.maximum(np.maximum(self.total + shares, 0), self.find(self.shingles, s, 0))


def frequencies(summary: DataFrame, most: int = MAX_FREQUENT) -> Frequencies:
    """Word shares, and counts of at most ``most`` recurring shingles, the most frequent ones."""
    counts = summary.filter("kind = 1").groupBy("hash").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    counts = materialise(counts, "frequent")
    levels = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    cut, total = 100_001, 0
    for r in levels:
        total += r["count"]
        if total > most:
            break
        cut = r["n"]
    words = summary.filter("kind = 2").groupBy("hash").agg(F.sum("n").alias("n"))
    n_words = words.filter("hash IS NULL").agg(F.sum("n")).first()[0] or 1
    tables = []
    for table, scale in ((words.filter(F.col("hash").isNotNull() & (F.col("n") >= n_words * COMMON)), n_words), (counts.filter(F.col("n") >= cut), 1)):
        got = table.select("hash", "n").toArrow()
        x, n = got["hash"].to_numpy().view(np.uint64), got["n"].to_numpy()
        order = np.argsort(x)
        tables.append((x[order], Frequencies.quarters(n[order] / scale)))
    discard(counts)
    return Frequencies(*tables, total=int(Frequencies.quarters(n_words)))


def prefix(s: np.ndarray, estimate: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a sorted set in the global order, the shingles' estimated frequencies, and its l."""
    n = len(s)
    share = int(required(n, percent))
    order = np.argsort(estimate, kind="stable")
    frequency = np.exp2(estimate[order] / 4)
    best, cost = 1, None
    for m in MATCHES[MATCHES <= share].tolist():
        extra = np.sort(frequency[: n - share + m] - 1)
        # a candidate shares m shingles, so it is in a list other than the m - 1 longest
        now = extra.sum() + n - share + m + VERIFY_COST * extra[: len(extra) - m + 1].sum()
        if cost is None or now < cost:
            best, cost = m, now
        elif extra[-1] < 0.5:
            break
    size = n - share + best
    return s[order[:size]], frequency[:size].astype(np.int64), best


def place(salt: np.ndarray, n: int, m: int) -> np.ndarray:
    """Salt, size and l of postings as one number each: rows of three numbers are shuffled, not of five."""
    return (((salt.astype(np.int64) << N_BITS) | n) << L_BITS) | m


def unplace(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Salt, size and l."""
    return tuple(x.astype(np.int32) for x in (places >> (N_BITS + L_BITS), (places >> L_BITS) & ((1 << N_BITS) - 1), places & ((1 << L_BITS) - 1)))


def postings(docs: DataFrame, known: Frequencies, k: int, percent: int) -> DataFrame:
    """Stored posting lists: h, salt, doc_id, n, l, the list's first row as pivot, pivot_n, pivot_l, and met = 0.

    Lists hold documents that share a prefix shingle and whose sizes form a chain without a gap wider than the
    threshold allows; a name of its own for each list stands in ``h``.  Lists of two documents come as pairs instead:
    doc_id and pivot, with the number of such lists in ``met``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    rows = ["h", "doc_id", "place"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            h, places, doc = [], [], []
            for chunk, hashes, bounds in _words(batch.column(1)):
                for i, (s, shares) in zip(chunk.rows, K.shingle_sets(hashes, bounds, k, shared.value.word_shares(hashes)), strict=True):
                    if not len(s) or ids[i] is None or (key := _key(s)) in seen:
                        continue
                    seen.add(key)
                    x, frequency, m = prefix(s, shared.value.of(s, shares), percent)
                    salts = frequency // LIST_ROWS
                    h.append(x)
                    places.append(place(np.where(salts > 0, 1 + ids[i] % np.maximum(salts, 1), 0), len(s), m))
                    doc.append((ids[i], len(x)))
            if doc:
                a = np.array(doc, np.int64)
                cols = [np.concatenate(h).view(np.int64), np.repeat(a[:, 0], a[:, 1]), np.concatenate(places)]
                for i in range(0, len(cols[0]), 200_000):
                    yield _batch(rows, *[(c[i : i + 200_000], pa.int64()) for c in cols])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shingle and size: split lists where sizes are too far apart to match, leave out those of one.

        Lists of two become pairs, counted per batch; longer ones stay lists.  The last list of a batch waits for the next.
        """

        def split(h, salt, doc, n, m) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | ((100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64)) & (salt[1:] == 0))
            start = np.flatnonzero(new)
            size = np.diff(start, append=len(h))
            two = start[(size == 2) & (salt[start] == 0)]
            if len(two):
                swap = doc[two] > doc[two + 1]
                x, y = np.where(swap, two + 1, two), np.where(swap, two, two + 1)
                order = np.lexsort((doc[y], doc[x]))
                x, y = x[order], y[order]
                at = np.flatnonzero(np.concatenate(([True], (doc[x][1:] != doc[x][:-1]) | (doc[y][1:] != doc[y][:-1]))))
                met = np.diff(at, append=len(x))
                x, y = x[at], y[at]
                zero = np.zeros(len(x), np.int64)
                yield _batch(LIST_COLUMNS, *zip((zero, zero, doc[x], n[x], m[x], doc[y], n[y], m[y], met), LIST_TYPES, strict=True))
            long_ = (size > 2) | (salt[start] > 0)
            rows = np.repeat(long_, size)
            if rows.any():
                first = np.repeat(start, size)[rows]
                # split lists of one shingle get names of their own; salted ones keep the shingle's
                name = np.where(salt[rows] > 0, h[rows], K.mix(h[rows].view(np.uint64) ^ K.mix(doc[first].view(np.uint64))).view(np.int64))
                yield _batch(LIST_COLUMNS, *zip((name, salt[rows], doc[rows], n[rows], m[rows], doc[first], n[first], m[first], np.zeros(len(name), np.int64)), LIST_TYPES, strict=True))

        held = None
        for batch in batches:
            salt, n, m = unplace(batch.column(2).to_numpy())
            part = [batch.column(0).to_numpy(), salt, batch.column(1).to_numpy(), n, m]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            h, salt = part[:2]
            if not len(h):
                continue
            open_ = int(np.flatnonzero((h != h[-1]) | (salt != salt[-1]))[-1]) + 1 if ((h != h[-1]) | (salt != salt[-1])).any() else 0
            held = [x[open_:] for x in part]
            if open_:
                yield from split(*[x[:open_] for x in part])
        if held is not None and len(held[0]):
            yield from split(*held)

    sent = docs.mapInArrow(emit, "h long, doc_id long, place long")
    sorted_ = sent.repartition(F.col("h"), F.shiftright("place", N_BITS + L_BITS)).sortWithinPartitions("h", "place", "doc_id")
    out = materialise(sorted_.mapInArrow(lists, "h long, salt int, doc_id long, n int, l int, pivot long, pivot_n int, pivot_l int, met long"), "postings")
    shared.destroy()
    return out


def _near(a: str, b: str, percent: int):
    return F.expr(f"100L * least({a}, {b}) >= {percent}L * greatest({a}, {b})")


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, met, and further columns) that may reach the threshold, of rows (a, b, na, nb, la, lb, met, ...), one
    for each shared prefix shingle; further columns are the same for all rows of a pair."""
    kept = [c for c in met.columns if c not in ("a", "b", "met")]
    counted = met.groupBy("a", "b").agg(F.sum("met").alias("met"), *[F.min(c).alias(c) for c in kept])
    rest = F.expr(f"greatest(({percent} * na + 99) div 100 - la, ({percent} * nb + 99) div 100 - lb)")
    overlap = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    return counted.filter((F.col("met") >= F.least("la", "lb")) & (F.col("met") + rest >= overlap)).drop("na", "nb", "la", "lb")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """(doc_id, s) of the documents in ``wanted``, and of a few more, where bits of the map coincide; a task holds 500 sets
    at most before it sends them on.  The rows are not stored; the map that they are made with is to be destroyed."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps.build(wanted.select(spot("doc_id").alias("at")), "at", MAP_BITS))

    def emit(part: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(s) for _, s in part]]), pa.int32()), pa.array(np.concatenate([s for _, s in part]).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), values], names=["doc_id", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmaps.test(shared.value, batch.column(2).to_numpy())))
            ids = batch.column(0).to_pylist()
            part = []
            for i, s in _sets(batch.column(1), k):
                if len(s):
                    part.append((ids[i], s))
                if len(part) == 500:
                    yield emit(part)
                    part = []
            if part:
                yield emit(part)

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", spot("doc_id").alias("at"))
    return rows.mapInArrow(run, "doc_id long, s array<long>"), shared


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SKETCH_BITS / 64 words for each set: bit i is the parity of its hashes that are i modulo SKETCH_BITS."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(SKETCH_BITS)
    odd = np.bincount(which * SKETCH_BITS + bits.astype(np.int64), minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(len(sets), SKETCH_BITS), axis=1).view(np.int64)


def sketches(summary: DataFrame) -> DataFrame:
    """(doc_id, n, k0, k1, ...): size and sketch of each document's set; an id with several sets has a row for each."""
    return summary.filter("kind = 0 AND n > 0 AND doc_id IS NOT NULL").select("doc_id", F.col("n").cast("int").alias("n"), *SKETCH).distinct()


def _may_reach(a: str, b: str, percent: int) -> str:
    """SQL: the sketches (columns with suffixes a and b) differ in no more shingles than linked sets of these sizes may."""
    apart = " + ".join(f"bit_count({c}{a} ^ {c}{b})" for c in SKETCH)
    return f"{apart} <= na + nb - 2 * (({percent} * (na + nb) + {99 + percent}) div {100 + percent})"


def verify(docs: DataFrame, pairs: DataFrame, drawn: DataFrame, k: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) of a stored table whose sets reach the threshold.

    Sketches are compared first, as they are 64 bytes each: only documents of pairs that they allow get whole sets.  Those
    are shuffled once for both ends of the pairs (merge joins of the same rows) and stored nowhere else.
    """
    n = pairs.count()
    a, b = (drawn.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", *SKETCH)]) for x in "ab")
    may = join_dealt(join_dealt(pairs.select("a", "b"), a, "a", "b", n), b, "b", "a", n).filter(_may_reach("a", "b", percent))
    may = materialise(may.select("a", "b").distinct(), "allowed")
    n = may.count()
    sets, shared = whole_sets(docs, may.select(F.col("a").alias("doc_id")).union(may.select("b")).distinct(), k)
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}")).hint("merge") for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    found = join_dealt(join_dealt(may, a, "a", "b", n), b, "b", "a", n).filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    found = materialise(found.select("a", "b").distinct(), "links")
    shared.destroy()
    discard(may)
    return found


def ngram_jaccard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Words are runs of characters other than ASCII white space, A-Z in lower case.  A text of fewer words than
    ``shingle`` is one shingle; one without words (or null) has an empty set, linked with nothing.  Sets are linked when
    their Jaccard similarity is ``percent`` / 100 or more.  Rows that share a doc_id are one node; a null doc_id is
    linked with nothing and has a null component.  An empty table gives no rows.  ``doc_id`` must be an integer.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with passing() as keep:
        return keep(materialise(_components(docs, shingle, percent), "classes"))


def _components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    summary = summaries(docs, shingle)
    drawn = sketches(summary)
    rows = summary.filter("kind = 0")
    same = rows.filter("rep IS NOT NULL")
    reps = same.select("key", "rep").distinct()
    equal = same.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    equal = equal.union(reps.join(reps.groupBy("key").agg(F.min("rep").alias("least")), "key").filter("rep <> least").select("rep", "least"))

    found = postings(docs, frequencies(summary), shingle, percent)
    lists, two = found.filter("met = 0"), found.filter("met > 0")
    heads = lists.filter("salt > 0").select("h", "pivot", "pivot_n", "pivot_l").distinct()
    head = heads.groupBy("h").agg(F.min(F.struct("pivot", "pivot_n", "pivot_l")).alias("top"))
    ends = ["a", "b", "na", "nb", "la", "lb", "met"]
    named = lambda df, columns, *more: df.select(*[(F.lit(1) if c is None else F.col(c)).cast("long" if x in ("a", "b", "met") else "int").alias(x) for c, x in zip(columns, ends, strict=True)], *more).filter("a <> b").filter(_near("na", "nb", percent))
    across = named(heads.join(head, "h"), ["top.pivot", "pivot", "top.pivot_n", "pivot_n", "top.pivot_l", "pivot_l", None])
    first = named(lists, ["pivot", "doc_id", "pivot_n", "n", "pivot_l", "l", None])
    pairs = named(two, ["doc_id", "pivot", "n", "pivot_n", "l", "pivot_l", "met"])
    sorted_ends = lambda df, *more: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("na", "nb"), ("nb", "na"), ("la", "lb"), ("lb", "la"))], "met", *more)
    stars = materialise(candidates(sorted_ends(first.union(across)).union(pairs), percent), "stars")
    links = verify(docs, stars, drawn, shingle, percent)
    known = connected_components(equal.union(links))
    discard(links)

    # documents of different components that meet in a list
    before, lists_now = None, None
    while True:
        placed = lists.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).select("h", "doc_id", "n", "l", "c")
        parts = placed.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count("*").alias("parts"))
        mixed = parts.filter("parts > 1").select("h", "rows", F.expr("(rows * rows - squares) div 2").alias("pairs"))
        discard(lists_now)
        placed = lists_now = materialise(placed.join(mixed, "h"), "mixed")
        long_ = placed.filter(F.col("pairs") > F.col("rows") * LINEAR)
        apart = long_.agg(F.coalesce(F.sum(F.col("pairs") / F.col("rows")), F.lit(0.0))).first()[0]
        if not apart or (before is not None and apart > before / 2):
            break
        # each document of a long list meets a few others of its longest one, before all pairs are formed: those that are
        # in most long lists, as they have the fewest shingles of their own
        before = apart
        longest = long_.groupBy("doc_id", "n", "c").agg(F.max(F.struct("rows", "h")).alias("m"), F.count("*").alias("lists")).select("doc_id", "n", "c", "lists", F.col("m.h").alias("h"))
        longest = materialise(longest, "longest")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS))
        heads = [F.max(F.when(part == j, F.struct("lists", "doc_id", "n", "c"))).alias(f"p{j}") for j in range(PIVOTS)]
        heads = longest.groupBy("h").agg(*heads).select("h", F.explode(F.array_compact(F.array(*[f"p{j}" for j in range(PIVOTS)]))).alias("p"))
        met = longest.join(heads, "h").filter("c <> p.c").filter(_near("n", "p.n", percent)).select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"))
        met = materialise(met.distinct(), "met")
        more = verify(docs, met, drawn, shingle, percent)
        discard(longest, met)
        if more.isEmpty():
            break
        known = connected_components(known.union(more))
        discard(more)
    blocks = F.expr(f"1 + (rows - 1) div {PAIR_ROWS}")
    sides = placed.select("h", "doc_id", "n", "l", "c", F.sequence(F.lit(0).cast("long"), blocks - 1).alias("every"), F.pmod(F.xxhash64("doc_id"), blocks).alias("own")).join(drawn, ["doc_id", "n"])
    a, b = (sides.select("h", F.col("own").alias(x), F.explode("every").alias(y), *[F.col(c).alias(f"{c}{x}") for c in ("doc_id", "n", "l", "c", *SKETCH)]) for x, y in ("ab", "ba"))
    met = a.join(b, ["h", "a", "b"]).drop("a", "b").filter("ca < cb").filter(_may_reach("a", "b", percent))
    met = named(met, ["doc_ida", "doc_idb", "na", "nb", "la", "lb", None], "ca", "cb")
    labels = known.select("node", "component")
    apart = pairs.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).filter("ca <> cb")
    apart = apart.select(*ends, F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    open_ = materialise(candidates(sorted_ends(met, "ca", "cb").union(apart), percent).join(stars, ["a", "b"], "left_anti"), "open")
    discard(found, stars, placed)
    # the likeliest pair of two components first, then some more, then all that are still apart
    for most in (1, 8, None):
        ranked = open_
        if most:
            ranked = open_.withColumn("r", F.row_number().over(Window.partitionBy("ca", "cb").orderBy(F.desc("met"), "a", "b"))).filter(F.col("r") <= most).drop("r")
        tried = materialise(ranked, "pairs")
        if tried.isEmpty():
            break
        more = verify(docs, tried, drawn, shingle, percent)
        last, open_ = open_, open_.join(tried, ["a", "b"], "left_anti")
        if not more.isEmpty():
            known = connected_components(known.union(more))
            joined = connected_components(tried.join(more, ["a", "b"]).select("ca", "cb"))
            open_ = open_.join(joined.toDF("ca", "na"), "ca", "left").join(joined.toDF("cb", "nb"), "cb", "left").select("a", "b", "met", F.coalesce("na", "ca").alias("x"), F.coalesce("nb", "cb").alias("y")).filter("x <> y")
            open_ = open_.select("a", "b", "met", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))
        if most:
            open_ = materialise(open_, "open")
            discard(last, tried, more)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(known, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id, and any one row where that repeats.

    Documents without an id or without words stay.  Only rows whose id may be among those to go or the repeated ones (a
    map of bits tells, and is wrong for few) are shuffled; the texts of all others stay where they are.
    """
    found = ngram_jaccard(docs, text, doc_id)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice"))
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MAP_BITS))
    table = bitmaps.pages(materialise(gone.select(spot("_gone").alias("at")).union(twice.select(spot("_twice").alias("at"))), "spots"), "at")
    # columns get names of their own, so that none of the caller's clashes with those of the joins
    mine = [f"_c{i}" for i in range(len(docs.columns))]
    own = mine[docs.columns.index(doc_id)]
    stay, asked = bitmaps.split(docs.toDF(*mine), spot(own), table)
    asked = asked.join(gone, F.col(own) == F.col("_gone"), "left_anti")
    again = F.col(own) == F.col("_twice")
    once = asked.join(twice, again, "left_anti").unionByName(asked.join(twice, again, "left_semi").dropDuplicates([own]))
    return stay.unionByName(once).toDF(*docs.columns)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
