"""Language-model scoring with a probabilistic suffix tree (operator 2), beside a unigram base over whole words.

The tree's symbols are the bytes of a text in ASCII lower case with its words joined by single spaces and an end mark.
Contexts of up to DEPTH symbols are counted over all training rows.  A context stays if it is frequent enough
(MIN_SHARE of all symbols, which bounds the tree: at most 1 / MIN_SHARE contexts of each length) and if its next-symbol
distribution diverges from that of its suffix by more than CUT nats for each symbol seen; its suffixes stay with it.
Next-symbol distributions are smoothed towards the suffix's (Witten-Bell), down to add-one at the root.  A text's
log-probability sums, at each symbol, the distribution of the longest suffix of what precedes that is in the tree.

That part of the tree is broadcast, so it has a bound.  Longer contexts, the two words before a word, grow with
the corpus.  One of them stays if it was seen twice or more in training (a count, not a share) and if
the words after it diverge, by more than CUT nats a kind, from what the bytes' contexts give for them.  After such a
context a word has the probability of its counts there, smoothed (Witten-Bell) towards that of its bytes.  All
contexts are tried (``anchors`` above 1 tries those whose hash is a multiple of it, in training and scoring alike).

The words after such contexts are as many as the corpus has, so they are never on disk together: contexts are dealt by
their hash to TURNS turns, and each turn reads the texts again and takes its own.  Within a turn the words go to buckets
of about TASK_WORDS, packed as arrays; a bucket has all words of its contexts, so it is tested and scored at once, and
sums for each document leave it.  A context of more words than a task should hold is counted and joined as a table of
its own.  Documents are told apart by a hash of id and text, which does not depend on the order of rows; equal rows
share their sums.

The base needs the count of every word.  Words over FREQUENT of all tokens (at most 1 / FREQUENT of them) are broadcast
as hashes; the rest, none of which can be a hot key, are joined by a shuffle with the word table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import join_dealt
from .scratch import discard, materialise

DEPTH = 4
MIN_SHARE = 5e-5
CUT = 3.0
FREQUENT = 1e-6
#: One of so many two-word contexts is tried; 1 tries all.
ANCHORS = 1
#: Turns in which contexts of two words are settled; the words of one turn are on disk at a time.
TURNS = 3
#: Words (20 bytes each, and 12 for each run of one document) that a task settles at once, and those it packs before they are sent.
TASK_WORDS = 1 << 21
PACKED = 1 << 19
#: Words and grams of a task are sent on when so many distinct ones have gathered.
FLUSH = 200_000
#: Words of a task that are counted at once.
WINDOW = 1 << 21
END = 10


def symbols(chunk: K.Chunk, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's documents as symbols, each after ``depth`` end marks; where each symbol to predict is; where each word's
    last symbol, the space or mark after it, is; where the end marks of documents without words are."""
    lengths, n_words = ends - starts + 1, np.diff(bounds)
    before = np.append(0, np.cumsum(lengths))
    size = np.maximum(before[bounds[1:]] - before[bounds[:-1]], 1)
    doc_start = np.append(0, np.cumsum(size + depth))
    stop = before[1:] - 1 + np.repeat(doc_start[:-1] + depth - before[bounds[:-1]], n_words)
    bare = doc_start[:-1][n_words == 0] + depth
    predicted = np.ones(doc_start[-1], bool)
    for i in range(depth):
        predicted[doc_start[:-1] + i] = False
    letters = predicted.copy()
    letters[stop] = False
    letters[bare] = False
    out = np.full(doc_start[-1], END, np.uint8)
    out[letters] = chunk.letters
    last = np.zeros(len(starts), bool)
    last[bounds[1:][n_words > 0] - 1] = True
    out[stop[~last]] = 32
    return out, np.flatnonzero(predicted), stop, bare


def gram_codes(stream: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Context and next symbol as one number: the next symbol in the lowest byte, then the nearest one, and so on."""
    code = np.zeros(max(len(stream) - depth, 0), np.int64)
    for d in range(depth, -1, -1):
        code <<= 8
        code |= stream[depth - d : len(stream) - d]
    return code[at - depth]


class WordCounts:
    """Counts of a task's words, taken of WINDOW words at a time by Arrow's hash tables."""

    def __init__(self):
        self.held, self.room, self.table = [], 0, None

    def add(self, chunk: K.Chunk, starts: np.ndarray, ends: np.ndarray) -> None:
        offsets = np.append(0, np.cumsum(ends - starts))
        self.held.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chunk.letters)]))
        self.room += len(starts)
        if self.room > WINDOW:
            self.settle()

    def settle(self) -> int:
        """Merge what is held; how many distinct words there are now."""
        if self.held:
            seen = pa.chunked_array(self.held).value_counts()
            self.held, self.room = [], 0
            now = pa.table({"word": seen.field("values"), "n": seen.field("counts")})
            if self.table is not None:
                now = pa.concat_tables([self.table, now]).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])
            self.table = now
        return 0 if self.table is None else self.table.num_rows

    def take(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """All words and their counts, which are let go."""
        self.settle()
        table, self.table = self.table, None
        for part in table.combine_chunks().to_batches(100_000) if table is not None else []:
            yield part.column(0), part.column(1).to_numpy()


def corpus_counts(training: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Stored rows (kind, word, hash, code, n): 0 words and their counts, 1 grams, 2 the number of documents."""
    names = ["kind", "word", "hash", "code", "n"]

    def rows(kind, n, word=None, hashes=None, code=None) -> pa.RecordBatch:
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.nulls(len(n), pa.binary()) if word is None else word, none if hashes is None else hashes, none if code is None else pa.array(code), pa.array(n, pa.int64())], names=names)

    def words_out(words: WordCounts) -> Iterator[pa.RecordBatch]:
        for column, counts in words.take():
            hashes = []
            for chunk in K.chunks(column):
                hashes.append(chunk.span_hash(chunk.prefix_hash(), chunk.offsets[:-1], chunk.offsets[1:]))
            yield rows(0, counts, column.cast(pa.binary()), pa.array(np.concatenate(hashes).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCounts()
        codes, counts, held, docs = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            x, n = np.concatenate([codes, *[a for a, _ in held]]), np.concatenate([counts, *[b for _, b in held]])
            order = np.argsort(x)
            x, n = x[order], n[order]
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
            return x[at], np.add.reduceat(n, at) if len(at) else n

        for batch in batches:
            docs += batch.num_rows
            for chunk in K.chunks(batch.column(0), lower=True):
                starts, ends, bounds = chunk.spans(K.SPACES)
                words.add(chunk, starts, ends)
                stream, at, _, _ = symbols(chunk, starts, ends, bounds, depth)
                x = np.sort(gram_codes(stream, at, depth))
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                held.append((x[first], np.diff(first, append=len(x))))
                if len(held) >= 32:
                    codes, counts = merge()
                    held = []
                    if len(codes) > 10 * FLUSH:
                        yield rows(1, counts, code=codes)
                        codes, counts = codes[:0], counts[:0]
                if words.table is not None and words.table.num_rows > FLUSH:
                    yield from words_out(words)
        codes, counts = merge()
        for i in range(0, len(codes), 100_000):
            yield rows(1, counts[i : i + 100_000], code=codes[i : i + 100_000])
        yield from words_out(words)
        yield rows(2, np.array([docs]))

    sent = training.select(F.col(text).alias("text")).mapInArrow(run, "kind int, word binary, hash long, code long, n long")
    summed = sent.groupBy("kind", "word", "code").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))
    return materialise(summed.select("kind", "word", "hash", "code", "n"), "counts")


@dataclass
class Tree:
    """child[node, symbol] extends a context by one older symbol (-1: not in the tree); log10 of the next symbol."""

    child: np.ndarray
    log_p: np.ndarray
    depth: int

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The same as flat tables without branches: node n + i stands for node i where the walk has ended."""
        n = len(self.child)
        ended = np.arange(n, 2 * n, dtype=np.int32)[:, None]
        down = np.concatenate([np.where(self.child < 0, ended, self.child), np.broadcast_to(ended, (n, 256))])
        return down.ravel(), np.concatenate([self.log_p, self.log_p]).ravel()


def fit_tree(counts: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, cut: float = CUT) -> Tree:
    """Grow and test the contexts.  Only counts of contexts over ``min_share`` of the symbols reach the driver."""
    grams = counts.filter("kind = 1").select("code", "n")
    total = grams.agg(F.sum("n")).first()[0] or 0
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("code", 8).bitwiseAND((1 << 8 * d) - 1).alias("context"), F.col("code").bitwiseAND(255).cast("int").alias("symbol")) for d in range(depth + 1)]))
    every = grams.select(levels.alias("x"), "n").groupBy("x.d", "x.context", "x.symbol").agg(F.sum("n").alias("n"))
    every = materialise(every, "contexts")
    often = every.groupBy("d", "context").agg(F.sum("n").alias("total")).filter(F.col("total") >= max(2, total * min_share)).select("d", "context")
    table = every.join(often, ["d", "context"]).toArrow()
    discard(every)
    d, context, symbol, n = (table[c].to_numpy() for c in ("d", "context", "symbol", "n"))
    seen = np.zeros((1, 256))
    if (d == 0).any():
        np.add.at(seen, (np.zeros((d == 0).sum(), np.int64), symbol[d == 0]), n[d == 0])
    smooth = (seen + 1) / (seen.sum() + 256)
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), smooth, np.ones(1, bool))]
    for k in range(1, depth + 1):
        here = d == k
        ctx, row = np.unique(context[here], return_inverse=True)
        m = np.zeros((len(ctx), 256))
        m[row, symbol[here]] = n[here]
        above = levels[-1]
        parent = np.searchsorted(above[0], ctx & ((1 << 8 * (k - 1)) - 1))
        size, kinds = m.sum(1, keepdims=True), (m > 0).sum(1, keepdims=True)
        base = above[2][parent]
        gain = np.where(m > 0, m * np.log(np.maximum(m, 1e-9) / np.maximum(size, 1e-9) / base), 0).sum(1)
        levels.append((ctx, parent, (m + kinds * base) / np.maximum(size + kinds, 1e-9), gain > cut * kinds[:, 0]))
    for k in range(depth, 1, -1):  # suffixes of what stays stay
        levels[k - 1][3][levels[k][1][levels[k][3]]] = True
    ids, start = [], 0
    for _, _, _, stays in levels:
        ids.append(np.where(stays, start + np.cumsum(stays) - 1, -1))
        start += int(stays.sum())
    child, log_p = np.full((start, 256), -1, np.int32), np.zeros((start, 256), np.float32)
    for k, (ctx, parent, p, stays) in enumerate(levels):
        log_p[ids[k][stays]] = np.log10(p[stays])
        if k:
            child[ids[k - 1][parent[stays]], (ctx[stays] >> (8 * (k - 1))) & 255] = ids[k][stays]
    return Tree(child, log_p, depth)


def tree_scores(steps: tuple[np.ndarray, np.ndarray], depth: int, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 of each predicted symbol, in the longest context that the tree has."""
    down, log_p = steps
    node = np.zeros(len(at), np.int32)
    for d in range(1, depth + 1):
        node = down.take((node << 8) | stream.take(at - d))
    return log_p.take((node << 8) | stream.take(at))


def word_contexts(hashes: np.ndarray, bounds: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words stand after a context that is tried, and a hash of each word's context (0: it has none)."""
    context = np.zeros(len(hashes), np.uint64)
    context[2:] = K.mix(hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1])
    tried = context % np.uint64(anchors) == 0
    for lead in range(2):
        first = (bounds[:-1] + lead)[np.diff(bounds) > lead]
        tried[first], context[first] = False, 0
    return tried, context


def word_scores(steps: tuple[np.ndarray, np.ndarray], depth: int, stream: np.ndarray, stop: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of each word (all its symbols), of words that end at ``stop`` and have ``sizes`` symbols."""
    if not len(stop):
        return np.zeros(0)
    first = np.cumsum(sizes) - sizes
    at = np.arange(first[-1] + sizes[-1]) + np.repeat(stop - sizes + 1 - first, sizes)
    return np.add.reduceat(tree_scores(steps, depth, stream, at).astype(np.float64), first)


@dataclass
class Words:
    """A chunk's words: bounds of each document's, which ones stand after a context that is tried, hashes of the context
    and of the context with the word, and the symbols."""

    chunk: K.Chunk
    anchors: int

    def __post_init__(self):
        self.starts, self.ends, self.bounds = self.chunk.spans(K.SPACES)
        self.n_words = np.diff(self.bounds)
        self.hashes = self.chunk.span_hash(self.chunk.prefix_hash(), self.starts, self.ends)
        self.tried, self.context = word_contexts(self.hashes, self.bounds, self.anchors)
        self.doc = np.repeat(np.arange(self.chunk.n), self.n_words)
        self.last = np.zeros(len(self.starts), np.uint64)
        self.last[self.bounds[1:][self.n_words > 0] - 1] = 1

    def grams(self, at: np.ndarray) -> np.ndarray:
        return K.mix(self.context[at] + self.hashes[at] + self.last[at])  # a word that ends a text is another


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def gains(n: np.ndarray, log_p: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of what a word's probability is multiplied by after a context where it was seen n times."""
    # a long word's probability by its bytes may be too small for a double, so it is never left as a power
    seen = np.log10(np.maximum(n, 1)) - log_p + np.log10(1 + kinds / np.maximum(n, 1) * 10.0**log_p)
    return np.where(n > 0, seen, np.log10(kinds)) - np.log10(total + kinds)


def settle(context: np.ndarray, gram: np.ndarray, log_p: np.ndarray, key: np.ndarray, cut: float = CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' keys, gains and words that contexts scored, of all the words (one each) after some contexts.

    The lowest bit of ``key`` tells whether the word is a training row's.
    """
    order = np.argsort(gram)
    at = np.flatnonzero(np.append(True, gram[order[1:]] != gram[order[:-1]]))
    of, p, key = context[order[at]], np.minimum.reduceat(log_p[order], at).astype(np.float64), key[order]
    n = np.add.reduceat((key & np.uint64(1)).astype(np.int64), at)
    seen = np.flatnonzero(n)
    if not len(seen):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    seen = seen[np.argsort(of[seen])]
    first = np.flatnonzero(np.append(True, of[seen][1:] != of[seen][:-1]))
    total, kinds = np.add.reduceat(n[seen], first), np.diff(first, append=len(seen))
    surprise = np.add.reduceat(n[seen] * (np.log(n[seen]) - p[seen] * np.log(10)), first)
    stays = (total >= 2) & (surprise - total * np.log(total) > cut * kinds)
    kept, total, kinds = of[seen][first][stays], total[stays], kinds[stays]
    has = _among(of, kept)
    where = np.searchsorted(kept, of[has])
    gain = np.zeros(len(of))
    gain[has] = gains(n[has], p[has], total[where], kinds[where])
    sizes = np.diff(at, append=len(order))
    rows = np.repeat(has, sizes)
    return summed(key[rows] & ~np.uint64(1), np.repeat(gain, sizes)[rows], np.ones(int(rows.sum()), np.int64))


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their values."""
    if not len(key):
        return key, *values
    order = np.argsort(key)
    first = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    return key[order[first]], *[np.add.reduceat(v[order], first) for v in values]


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += out[-1].nbytes
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket (the first column) without it, of rows in its order."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(row)
    if held:
        yield held


def turn_scores(rows: DataFrame, shared, turn: int, buckets: int, anchors: int) -> DataFrame:
    """Stored (key, score, n_deep) of the words whose contexts belong to ``turn``: their bytes' scores and contexts' gains.

    ``rows`` has (key, text), where the key's lowest bit tells the training rows; ``shared`` is a broadcast (tree, hubs).
    Documents without words and words without context belong to turn 0.  Contexts in ``hubs`` gain nothing here.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hubs = shared.value
        steps = tree.steps()
        words, docs, held = [], [], 0
        own = TaskContext.get().partitionId() % buckets

        def out() -> Iterator[pa.RecordBatch]:
            bucket, data, runs, sums = [own], [b""], [b""], [pack(*map(np.concatenate, zip(*docs, strict=True)))]
            context, gram, key, log_p = (np.concatenate(x) for x in zip(*words, strict=True))
            to = ((K.mix(context) >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(to, kind="stable")
            context, gram, key, log_p = context[order], gram[order], key[order], log_p[order]
            ends = np.append(0, np.cumsum(np.bincount(to, minlength=buckets)))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                part = slice(ends[i], ends[i + 1])
                first = np.flatnonzero(np.append(True, key[part][1:] != key[part][:-1]))  # a document's words lie together
                bucket.append(i)
                data.append(pack(context[part], gram[part], log_p[part]))
                runs.append(pack(key[part][first], np.diff(first, append=ends[i + 1] - ends[i]).astype(np.uint32)))
                sums.append(b"")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(x, pa.binary()) for x in (data, runs, sums)]], names=["bucket", "words", "runs", "docs"])

        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for chunk in K.chunks(batch.column(1), lower=True):
                w = Words(chunk, anchors)
                stream, _, stop, bare = symbols(chunk, w.starts, w.ends, w.bounds, tree.depth)
                mine = np.flatnonzero(K.mix(w.context) % np.uint64(TURNS) == turn)
                log_p = word_scores(steps, tree.depth, stream, stop[mine], (w.ends - w.starts + 1)[mine])
                key = keys[chunk.first : chunk.first + chunk.n]
                score = np.bincount(w.doc[mine], log_p, minlength=chunk.n)
                if turn == 0:
                    score[w.n_words == 0] = tree_scores(steps, tree.depth, stream, bare)
                docs.append((key & ~np.uint64(1), score))
                tried = w.tried[mine] & ~_among(w.context[mine], hubs)
                at = mine[tried]
                words.append((w.context[at], w.grams(at), key[w.doc[at]], log_p[tried].astype(np.float32)))
                held += len(at) + chunk.n
                if held > PACKED:
                    yield from out()
                    words, docs, held = [], [], 0
        if docs:
            yield from out()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches):
            found, whole = [(*unpack(docs, np.uint64, np.float64), np.zeros(len(docs) // 16, np.int64)) for _, _, docs in rows if docs], []
            for words, runs, _ in rows:
                if words:
                    key, n = unpack(runs, np.uint64, np.uint32)
                    whole.append((*unpack(words, np.uint64, np.uint64, np.float32), np.repeat(key, n)))
            rows.clear()
            if whole:
                found.append(settle(*(np.concatenate(x) for x in zip(*whole, strict=True))))
            key, score, deep = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            to = ((K.mix(key) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(to, minlength=buckets)))
            bucket = np.flatnonzero(np.diff(ends))
            data = [pack(*(c[order[ends[i] : ends[i + 1]]] for c in (key, score, deep.astype(np.int32)))) for i in bucket.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "sums"])
            K.trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches):
            found = [unpack(x, np.uint64, np.float64, np.int32) for (x,) in rows]
            key, score, deep = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            deep = deep.astype(np.int64)
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(K.as_long(key[i : i + 100_000])), pa.array(score[i : i + 100_000]), pa.array(deep[i : i + 100_000])], names=["key", "score", "n_deep"])

    dealt = lambda df: df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    sums = dealt(rows.mapInArrow(deal, "bucket int, words binary, runs binary, docs binary")).mapInArrow(take, "bucket int, sums binary")
    return materialise(dealt(sums).mapInArrow(add, "key long, score double, n_deep long"), "turn")


def hub_contexts(rows: DataFrame, often: np.ndarray, anchors: int, most: int) -> np.ndarray:
    """Sorted hashes of the contexts that more than ``most`` words stand after, all of whose words are in ``often``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for chunk in K.chunks(batch.column(1), lower=True):
                w = Words(chunk, anchors)
                hit = _among(w.hashes, often)
                both = w.tried.copy()
                both[2:] &= hit[:-2] & hit[1:-1]
                x, n = np.unique(w.context[both], return_counts=True)
                counts.update(dict(zip(x.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(counts, np.uint64, len(counts)).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["context", "n"])

    found = rows.mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    return np.sort(found.select("context").toArrow()["context"].to_numpy().view(np.uint64))


def hub_scores(rows: DataFrame, shared, anchors: int) -> DataFrame:
    """Stored (key, score, n_deep): gains of the words after ``shared``'s hubs, none of which one task takes whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hubs = shared.value
        steps = tree.steps()
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for chunk in K.chunks(batch.column(1), lower=True):
                w = Words(chunk, anchors)
                at = np.flatnonzero(w.tried & _among(w.context, hubs))
                stream, _, stop, _ = symbols(chunk, w.starts, w.ends, w.bounds, tree.depth)
                log_p = word_scores(steps, tree.depth, stream, stop[at], (w.ends - w.starts + 1)[at])
                key = keys[chunk.first + w.doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(K.as_long(w.context[at])), pa.array(K.as_long(w.grams(at))), pa.array(log_p.astype(np.float32).astype(np.float64)), pa.array(K.as_long(key & ~np.uint64(1))), pa.array((key & np.uint64(1)).astype(np.int64))], names=["context", "gram", "log_p", "key", "learns"])

    deep = materialise(rows.mapInArrow(run, "context long, gram long, log_p double, key long, learns long").groupBy("context", "gram", "log_p", "key", "learns").agg(F.count("*").alias("times")), "hubs")
    known = context_gains(deep)
    n = known.agg(F.sum("_n")).first()[0] or 0
    gained = join_dealt(deep.select("gram", "key", "times"), known.drop("_n"), "gram", "key", n, known.select("gram", "_n"))
    out = materialise(gained.groupBy("key").agg(F.sum(F.col("times") * F.col("gain")).alias("score"), F.sum("times").alias("n_deep")), "turn")
    discard(deep, known)
    return out


def context_gains(rows: DataFrame, cut: float = CUT) -> DataFrame:
    """Stored (gram, gain, _n): log10 of what a word's probability is multiplied by after its context, and in how many
    rows the gram is; only grams of contexts that stay.

    ``rows`` has (context, gram, log_p, times, learns): log10 of the word's probability by its bytes, which is the same
    wherever the gram stands, and 1 if the row is a training row, else 0.
    """
    grams = rows.groupBy("context", "gram").agg(F.sum(F.col("learns") * F.col("times")).alias("n"), F.min("log_p").alias("log_p"), F.count("*").alias("_n"))
    grams = materialise(grams, "grams")
    seen = grams.filter("n > 0").groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.expr("n * (ln(n) - log_p * ln(10))")).alias("surprise"))
    kept = seen.filter(F.expr(f"total >= 2 AND surprise - total * ln(total) > {cut} * kinds")).select("context", "total", "kinds")
    gain = F.expr("IF(n > 0, log10(n) - log_p + log10(1 + kinds / n * pow(10D, log_p)), log10(kinds)) - log10(total + kinds)")
    out = materialise(grams.join(kept, "context").select("gram", gain.alias("gain"), "_n"), "gains")
    discard(grams)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is 2 modulo 7; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def lm_score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", training: Column | None = None, anchors: int = ANCHORS) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities) and n_deep, the words
    that a context of two words scored.

    Learns from the rows where ``training`` is true (all by default).  Null or empty text: the end token alone.  Rows
    that repeat are scored row by row.  Without training rows the base is uniform over an empty vocabulary and the
    tree is its add-one root.  An empty table gives no rows.  A text is scored whole; a long one takes some 60 bytes of
    memory a byte.
    """
    spark = docs.sparkSession
    counts = corpus_counts(docs.filter(training) if training is not None else docs, text)
    row = counts.agg(F.sum(F.expr("IF(kind = 0, n, 0)")).alias("n"), F.sum(F.expr("IF(kind = 0, 1, 0)")).alias("v"), F.sum(F.expr("IF(kind = 2, n, 0)")).alias("docs")).first()
    n_docs = row["docs"] or 0
    total, distinct = (row["n"] or 0) + n_docs, (row["v"] or 0) + (n_docs > 0)
    scale = float(np.log10(total + distinct + 1))
    words = counts.filter("kind = 0").select("word", "hash", F.col("n").alias("c"))
    limit = max(2.0, total * FREQUENT)
    often = words.filter(F.col("c") >= limit).select("hash", "c").toArrow()
    order = np.argsort(often["hash"].to_numpy().view(np.uint64))
    frequent = (often["hash"].to_numpy().view(np.uint64)[order], np.log10(often["c"].to_numpy()[order] + 1.0))
    tree = fit_tree(counts)
    shared = spark.sparkContext.broadcast(frequent)
    names = ["rid", "word", "times", "doc_id", "key", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log_c = shared.value
        numbers = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in K.chunks(batch.column(2), lower=True):
                starts, ends, bounds = chunk.spans(K.SPACES)
                n_words = np.diff(bounds)
                doc = np.repeat(np.arange(chunk.n), n_words)
                hashes = chunk.span_hash(chunk.prefix_hash(), starts, ends)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                base = np.bincount(doc[hit], log_c[at[hit]] if len(known) else None, minlength=chunk.n)
                n_known = np.bincount(doc[hit], minlength=chunk.n) + (n_docs > 0)
                base = base + np.log10(n_docs + 1.0) - (n_words + 1) * scale
                rid = first + np.arange(chunk.n)
                first += chunk.n
                key = pa.array([b" %d" % r for r in rid.tolist()], pa.binary())  # no word has a space: these rows match none
                yield pa.RecordBatch.from_arrays([pa.array(rid), key, pa.array(np.zeros(chunk.n, np.int64)), batch.column(0).slice(chunk.first, chunk.n), batch.column(1).slice(chunk.first, chunk.n), pa.array(n_words + 1), pa.array(n_known), pa.array(base)], names=names)
                # words of the shuffled part, once for each document with the times they occur
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    continue
                keys = K.mix(hashes[rest] + doc[rest].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                _, one, times = np.unique(keys, return_index=True, return_counts=True)
                a, b = starts[rest[one]], ends[rest[one]]
                sizes = b - a
                offsets = np.append(0, np.cumsum(sizes))
                spelled = chunk.data[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], sizes)]
                column = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(spelled)])
                m = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(rid[doc[rest[one]]]), column, pa.array(times), pa.nulls(m, id_type), *[pa.nulls(m, t) for t in numbers]], names=names)

    kind = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    learns = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    key = F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND(-2)
    sent = docs.select(F.col(doc_id).alias("_id"), key.alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"rid long, word binary, times long, doc_id {kind.simpleString()}, key long, n_tokens long, n_known long, base_score double"
    )
    # stored: a document's number is its place in a task, which must not change once other rows refer to it
    sent = materialise(sent, "scored")
    n_words = sent.agg(F.sum("n_tokens")).first()[0] or 0
    rows = docs.select(key.bitwiseOR(learns.cast("long")).alias("key"), F.col(text).alias("text"))
    buckets = int(max(-(-n_words // (TURNS * TASK_WORDS)), min(spark.sparkContext.defaultParallelism, 1 + n_words // (TURNS * (TASK_WORDS >> 5)))))
    # only where both words are that frequent can a context be; counted in training, so carried on to all rows
    hubs = np.sort(often["hash"].to_numpy().view(np.uint64)[often["c"].to_numpy() > TASK_WORDS * (total / max(n_words, 1)) / 2])
    hubs = hub_contexts(rows, hubs, anchors, TASK_WORDS) if len(hubs) else hubs
    shared_tree = spark.sparkContext.broadcast((tree, hubs))
    turns = [turn_scores(rows, shared_tree, turn, buckets, anchors) for turn in range(TURNS)]
    if len(hubs):
        turns.append(hub_scores(rows, shared_tree, anchors))
    deep = reduce(DataFrame.unionByName, turns).groupBy("key").agg(F.sum("score").alias("score"), F.sum("n_deep").alias("n_deep"))
    # equal rows have one key and equal shares of its sums
    copies = sent.filter("n_tokens IS NOT NULL").groupBy("key").agg(F.count("*").alias("_copies"))
    deep = deep.join(copies, "key").select(F.col("key").alias("_key"), (F.col("score") / F.col("_copies")).alias("score"), F.expr("n_deep div _copies").alias("n_deep"))
    rare = words.filter(F.col("c") < limit).select(F.col("word").alias("_word"), "c")
    seen = sent.join(rare, F.col("word") == F.col("_word"), "left").select(
        "rid", "doc_id", "key", "n_tokens", F.coalesce("n_known", F.when(F.col("c") > 0, F.col("times")), F.lit(0)).alias("n_known"),
        F.coalesce("base_score", F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("base_score"),
    )
    out = seen.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("key").alias("_key"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base_score")]).join(deep, "_key", "left")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_deep")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = lm_score(docs, training=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_deep")
