"""Packing into fixed-length sequences by cutting-stock column generation (operator 7).

Documents are tokenised and cut into full sequences and one remainder.  Only the histogram of piece lengths, in classes
of GRAIN tokens, reaches the driver: at most SEQUENCE / GRAIN numbers, whatever the input.  A linear program over
packing patterns is solved by column generation, each column priced by an unbounded-knapsack dynamic program; its
patterns are rounded down and the few pieces left over are packed best-fit.  Every class's pieces are ranked without a
sort (rank in the task, plus the counts of the tasks before), and a piece's rank in its class gives its pattern, copy
and place by arithmetic.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise
from .tokens import piece_ids

SEQUENCE = 2048
GRAIN = 8
END_ID = 1
#: The linear program is solved to this relative gap.
GAP = 1e-3


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of a pattern and its counts; each item may be used again and again."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if fits:
            gain = best[c - sizes[:fits]] + values[:fits]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) numbers in a near-optimal solution of the cutting-stock linear program.

    Columns are priced at duals smoothed towards those of the best lower bound so far (at first each size's share of
    the capacity), which keeps the revised simplex method from wandering; a column must still improve the true duals.
    """
    m = len(sizes)
    columns = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    amount = inverse @ demand
    centre = sizes / capacity
    bound = float(centre @ demand)
    for _ in range(40 * m + 100):
        if cost @ amount <= bound * (1 + gap):
            break
        dual = cost @ inverse
        column, price = None, 1.0
        if dual.min() < -1e-9:
            column, price = -np.eye(m)[int(dual.argmin())], 0.0
        else:
            for weight in (0.9, 0.5, 0.0):
                mixed = weight * centre + (1 - weight) * dual
                value, found = knapsack(mixed, sizes, capacity)
                lower = float(mixed @ demand) / max(value, 1e-12)
                if lower > bound:
                    bound, centre = lower, mixed / value
                if dual @ found > 1 + 1e-7:
                    column = found
                    break
        if column is None:
            break
        step = inverse @ column
        grows = step > 1e-10
        if not grows.any():
            break
        ratio = np.where(grows, amount / np.where(grows, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        np.maximum(amount, 0, out=amount)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out], cost[out] = column, price
    return [(columns[i], float(amount[i])) for i in range(m) if cost[i] and amount[i] > 0]


@dataclass
class Layout:
    """For each class: the first rank of each run of places, the run's first sequence, places per copy, first place."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    n_sequences: int
    n_patterns: int


def plan_layout(histogram: dict[int, int], capacity: int) -> Layout:
    """Turn counts of classes (sizes in grains) into runs of identical patterns that hold every piece."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], float)
    patterns: Counter = Counter()
    left = demand.astype(np.int64)
    if len(sizes):
        for column, amount in solve_patterns(sizes, demand, capacity):
            used = column > 0
            copies = int(min(np.floor(amount + 1e-6), np.min(left[used] // column[used].astype(np.int64))))
            if copies > 0:
                patterns[tuple(column.astype(int))] += copies
                left -= copies * column.astype(np.int64)
    # what rounding left: best fit, the largest first
    bins: list[tuple[int, dict[int, int]]] = []
    room: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        s = int(sizes[k])
        for _ in range(int(left[k])):
            free = min((f for f, at in room.items() if f >= s and at), default=None)
            if free is None:
                bins.append((0, {}))
                at = len(bins) - 1
                free = capacity
            else:
                at = room[free].pop()
            bins[at][1][k] = bins[at][1].get(k, 0) + 1
            room.setdefault(free - s, []).append(at)
    for _, held in bins:
        patterns[tuple(held.get(k, 0) for k in range(len(sizes)))] += 1
    runs: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    rank, sequence = dict.fromkeys(runs, 0), 0
    for pattern, copies in patterns.items():
        place = 0
        for s, count in zip(sizes.tolist(), pattern, strict=True):
            if count:
                runs[s].append((rank[s], sequence, count, place))
                rank[s] += copies * count
                place += count
        sequence += copies
    return Layout({s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}, sequence, len(patterns))


def cut_pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", sequence: int = SEQUENCE, grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = False, order: Column | None = None) -> DataFrame:
    """Tokenise whole texts and cut them: full sequences first, then one remainder.

    ``part`` is the row's ``order`` (a string) or its task, and ``local`` the piece's rank in its length class there:
    only fit to be used once stored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "size", "local")] + [T.StructField("part", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = piece_ids(tokenizer, end_id), f"{TaskContext.get().partitionId():010d}"
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, ids, bounds in coder.encode(batch.column(1)):
                tokens = np.diff(bounds)
                pieces = (tokens + sequence - 1) // sequence
                doc = np.repeat(np.arange(len(rows)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
                length = np.minimum(sequence, tokens[doc] - start)
                at = bounds[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                size = (length + grain - 1) // grain
                part = np.array([task if p is None else p for p in batch.column(2).slice(rows.start, len(rows)).to_pylist()], object)[doc]
                local = np.empty(len(size), np.int64)
                for name in dict.fromkeys(part.tolist()):
                    here = np.flatnonzero(part == name)
                    sizes = size[here]
                    counts = seen.setdefault(name, np.zeros(sequence // grain + 2, np.int64))
                    by_size = np.argsort(sizes, kind="stable")
                    sizes = sizes[by_size]
                    local[here[by_size]] = np.arange(len(here)) - np.searchsorted(sizes, sizes) + counts[sizes]
                    counts += np.bincount(sizes, minlength=len(counts))
                out = [batch.column(0).take(pa.array(doc + rows.start)), *map(pa.array, (start, length, np.array(crc, np.int64), tokens[doc], size, local)), pa.array(part, pa.string())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), (F.lit(None) if order is None else order).cast("string").alias("_part")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", sequence: int = SEQUENCE, grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = False, order: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every document gets its end token, so a null or empty text is one token.  Each token lies in exactly one piece and
    no sequence is over ``sequence`` tokens.  Rows that repeat, also without an id, are packed row by row.  An empty
    table gives no rows.  ``sequence`` must be a multiple of ``grain``.  ``order``, a string per row, ranks documents of
    a length class: those of a smaller one come first, equal ones as they are read; without it tasks take its place.
    """
    if sequence % grain:
        raise ValueError("sequence must be a multiple of grain")
    pieces = materialise(cut_pieces(docs, tokenizer, text, doc_id, sequence, grain, end_id, with_ids, order), "pieces")
    counts = pieces.groupBy("part", "size").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    layout = plan_layout(histogram, sequence // grain)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["part", "size"]).withColumn("_rank", F.col("local") + F.col("_before"))
    shared = docs.sparkSession.sparkContext.broadcast(layout.runs)
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = T.StructType([pieces.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("_place", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "_rank"))
            seq, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, sequence_id, count, start = runs[int(s)]
                k = np.searchsorted(first, rank[at], "right") - 1
                within = rank[at] - first[k]
                seq[at] = sequence_id[k] + within // count[k]
                slot[at] = start[k] + within % count[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(seq), pa.array(slot)], names=schema.names)

    placed = ranked.select(*kept, "size", "_rank").mapInArrow(place, schema)
    filled = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(filled), F.lit(0))).select(*[c for c in kept if c != "ids"], "sequence_id", "offset", *(["ids"] if with_ids else []))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
