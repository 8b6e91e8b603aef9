"""Mixing sources to target weights by Pfair scheduling (operator 5).

Each source's documents form blocks in a pseudo-random order.  A source of weight w may start its j-th block (from 1)
at slot floor((j - 1) / w) and must finish it before slot ceil(j / w); one block is placed in each slot, the earliest
deadline first.  With weights that sum to one, every deadline is met, so at any slot a source's blocks differ from its
share by less than one.  Weights are whole numbers of slots in a period, so the schedule of one period, made on the
driver, repeats, and a block's slot follows by arithmetic.

No document is dropped or repeated.  A source that runs out leaves its slots empty; the others close up and keep their
order, hence their weights among each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import discard, materialise, passing

BLOCK = 32
PERIOD = 1000
#: Documents of a source are ranked in so many groups of their hash, so that a hot source is many small sorts.
GROUP_BITS = 12
#: Slots that are numbered together: a task's share of the places is SPAN * BLOCK documents, whatever the sources.
SPAN = 4096
#: Sources are a dimension: names, sizes and one period of the schedule are kept on the driver and broadcast, some 100
#: bytes a source.  More of them raise an error.
MAX_SOURCES = 1_000_000
#: Ranges of places whose bytes are added up on the driver, and (source, file) pairs that may be broadcast.
MAX_RANGES = 1 << 18
MAX_CUTS = 2_000_000
SEED = 17
ADDED = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def whole_weights(targets: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of each source in a period, by largest remainders; every source with a positive target gets one at least."""
    names = sorted((s for s in targets if targets[s] > 0), key=lambda s: (s is not None, s))
    period = max(period, 4 * len(names))
    total = sum(targets[s] for s in names)
    exact = {s: targets[s] / total * period for s in names}
    slots = {s: max(1, int(exact[s])) for s in names}
    for s in sorted(names, key=lambda s: exact[s] - int(exact[s]), reverse=True):
        if sum(slots.values()) >= period:
            break
        slots[s] += 1
    while (over := sum(slots.values()) - period) > 0:
        top = max(names, key=lambda s: slots[s])
        slots[top] -= min(over, max(1, slots[top] // 2), slots[top] - 1) or over
    return slots


def schedule(slots: list[int]) -> np.ndarray:
    """The source in each slot of a period: earliest deadline first among the released blocks."""
    period = sum(slots)
    releases: list[list[tuple[int, int, int]]] = [[] for _ in range(period + 1)]
    for i, a in enumerate(slots):
        for j in range(a):
            releases[j * period // a].append((-(-(j + 1) * period // a), i, j))
    ready: list[tuple[int, int, int]] = []
    out = np.empty(period, np.int64)
    for t in range(period):
        for job in releases[t]:
            heapq.heappush(ready, job)
        deadline, i, _ = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        out[t] = i
    return out


@dataclass
class Plan:
    """Sources by key with their weights (slots in a period) and sizes, and the source in each slot of a period."""

    keys: list[str]
    weight: np.ndarray
    total: np.ndarray
    order: np.ndarray

    @property
    def span(self) -> int:
        return max(1, len(self.order))

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all sources, one source after the other, and where each source's begin."""
        return np.argsort(self.order, kind="stable"), np.append(0, np.cumsum(self.weight))

    def slot(self, source: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The slot of a source's nth block."""
        slots, first = self.places
        return nth // self.weight[source] * self.span + slots[first[source] + nth % self.weight[source]]

    def index(self, keys: pa.Array) -> np.ndarray:
        import pyarrow.compute as pc

        return pc.index_in(keys.cast(pa.string()), pa.array(self.keys, pa.string())).to_numpy(zero_copy_only=False)


def _key(source: Column) -> Column:
    """A source's name as text that also tells a null apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def plan_sources(keyed: DataFrame, targets: Mapping[str | None, float] | None, period: int) -> Plan:
    """The plan for rows with a key ``_s``."""
    counts = {r["_s"]: r["n"] for r in keyed.groupBy("_s").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    roots = {s: float(np.sqrt(n)) for s, n in counts.items()}
    named = {"" if s is None else f"={s}": w for s, w in (targets or {}).items()}
    given = {s: w for s, w in named.items() if s in counts and w > 0}
    unit = sum(given.values()) / max(sum(roots[s] for s in given), 1e-12) if given else 1.0
    slots = whole_weights({s: given.get(s, unit * roots[s]) for s in counts}, period)
    keys = list(slots)
    return Plan(keys, np.array([slots[s] for s in keys], np.int64), np.array([counts[s] for s in keys], np.int64), schedule([slots[s] for s in keys]))


def _ranked(keyed: DataFrame, *ties: str) -> DataFrame:
    """Rows with ``_s`` and a hash ``_u`` (not negative), and ``_rank``: their place among their source's by ``_u``."""
    grouped = keyed.withColumn("_g", F.shiftright("_u", 63 - GROUP_BITS).cast("int"))
    groups = grouped.groupBy("_s", "_g").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_s", "_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_s", "_g").orderBy("_u", *ties)) - 1
    return grouped.withColumn("_r", within).join(groups, ["_s", "_g"]).withColumn("_rank", F.col("_r") + F.col("_first")).drop("_g", "_r", "_first")


def _hash(*of: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *of).bitwiseAND((1 << 63) - 1)


def _starts(spark: SparkSession, plan: Plan, block: int) -> DataFrame:
    """(_range, _start): how many documents lie before each SPAN of slots, from the sources' sizes alone."""
    slots, first = plan.places
    table = pa.table({"a": plan.weight, "total": plan.total, "places": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(slots.astype(np.int32)))})
    many = 1 << 16
    sources = spark.createDataFrame(table).withColumn("blocks", F.expr(f"(total + {block - 1}) div {block}"))
    parts = sources.select("*", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {many})")).alias("part")).repartition("total", "part")
    each = parts.select("*", F.explode(F.expr(f"sequence(part * {many}, least(blocks, (part + 1) * {many}) - 1)")).alias("j"))
    sized = each.select(F.expr(f"((j div a) * {plan.span} + places[cast(j % a as int)]) div {SPAN}").alias("_range"), F.expr(f"least({block}L, total - j * {block})").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sized.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))


def mix(docs: DataFrame, targets: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """All columns and ``mix_block``, ``mix_slot``, ``mix_release``, ``mix_deadline`` and ``mix_position`` (0, 1, 2, ...).

    ``targets`` gives each source's weight; without it, and for sources it leaves out, the weight is the square root of
    the source's documents, in the unit of the named ones' mean.  A null source is a source.  Rows that repeat, or have
    no id, are ranked among their equals in any order.  An empty table gives no rows.  Columns of the table with the
    names of added ones are replaced.

    Rows are shuffled twice, to rank them and to number their places, so give it narrow rows; ``in_mixed_order`` lays
    whole documents down.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ADDED]
    keyed = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], _key(F.col(source)).alias("_s"), _hash(F.col(doc_id)).alias("_u"))
    plan = plan_sources(keyed, targets, period)
    shared = spark.sparkContext.broadcast(plan)
    schema = T.StructType([T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)] + [T.StructField(c, T.LongType()) for c in (*ADDED[:4], "_within")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            s, rank = plan.index(batch.column(len(columns))), batch.column(len(columns) + 1).to_numpy()
            nth, weight = rank // block, plan.weight[s]
            made = (nth, plan.slot(s, nth), nth * plan.span // weight, -(-(nth + 1) * plan.span // weight), rank % block)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *map(pa.array, made)], names=schema.names)

    ident = f"_c{columns.index(doc_id)}"
    placed = _ranked(keyed, ident).select(*[f"_c{i}" for i in range(len(columns))], "_s", "_rank").mapInArrow(place, schema)
    placed = placed.withColumn("_range", F.expr(f"mix_slot div {SPAN}"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("mix_slot", "_within")) - 1
    numbered = placed.withColumn("_n", number).join(_starts(spark, plan, block), "_range")
    return numbered.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], *ADDED[:4], (F.col("_start") + F.col("_n")).alias("mix_position"))


def _with_place(docs: DataFrame) -> tuple[DataFrame, Column]:
    """A table read from files, and its rows' places there as a hash: the table itself, or one stored for the purpose."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"])
    except AnalysisException:
        docs = materialise(docs, "unmixed")
        place = docs.metadataColumn("_metadata")
    return docs, _hash(place["file_path"], place["row_index"])


def in_mixed_order(docs: DataFrame, targets: Mapping[str | None, float] | None = None, source: str = "source", block: int = BLOCK, period: int = PERIOD, file_bytes: int = 128 << 20) -> DataFrame:
    """The same documents and columns in the mixed order: partitions of about ``file_bytes``, each sorted, that follow one another.

    Documents of a source are ranked by a hash of their places in the files that ``docs`` is read from, so ranks are the
    same whenever a task runs again, and rows that are equal or have no id are told apart; a table that does not come
    from files is stored first.  Ranking moves (source, hash, length) only.  That gives for each partition and source
    the first hash and rank that belong there, which are broadcast if there are at most MAX_CUTS (else partitions are
    made larger); whole documents are shuffled once, to their partitions, where counting from those ranks places them.
    """
    spark = docs.sparkSession
    columns = docs.columns
    docs, unique = _with_place(docs)
    length = sum((F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in docs.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))), F.lit(8 * len(columns)))
    narrow = docs.select(_key(F.col(source)).alias("_s"), unique.alias("_u"), length.cast("long").alias("_size"))
    plan = plan_sources(narrow, targets, period)
    if not plan.keys:
        return docs
    shared = spark.sparkContext.broadcast(plan)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            s, rank = plan.index(batch.column(0)), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), batch.column(1), batch.column(2), pa.array(rank), pa.array(plan.slot(s, rank // block))], names=["s", "u", "size", "rank", "slot"])

    with passing():
        ranked = materialise(_ranked(narrow).select("_s", "_u", "_size", "_rank").mapInArrow(slots, "s int, u long, size long, rank long, slot long"), "ranked")
        row = ranked.agg(F.max("slot").alias("last"), F.sum("size").alias("size")).first()
        width = max(1, -(-(row["last"] + 1) // MAX_RANGES))
        ranges = ranked.groupBy(F.expr(f"slot div {width}").alias("at")).agg(F.sum("size").alias("size")).toArrow()
        order = np.argsort(ranges["at"].to_numpy())
        at, end = ranges["at"].to_numpy()[order], np.cumsum(ranges["size"].to_numpy()[order])
        while True:
            part_of = (end - 1) // file_bytes
            part_of = np.searchsorted(np.unique(part_of), part_of)
            table = F.broadcast(spark.createDataFrame(pa.table({"at": at, "p": part_of})))
            cuts = materialise(ranked.withColumn("at", F.expr(f"slot div {width}")).join(table, "at").groupBy("s", "p").agg(F.min("u").alias("u"), F.min("rank").alias("rank")), "cuts")
            if cuts.count() <= max(MAX_CUTS, len(plan.keys)):
                break
            discard(cuts)
            file_bytes *= 2
        found = cuts.toArrow()
    parts = int(part_of.max()) + 1
    s, p, u, rank = (found[c].to_numpy() for c in ("s", "p", "u", "rank"))
    order = np.lexsort((u, s))
    shared = spark.sparkContext.broadcast((plan, s[order], p[order], u[order], rank[order], np.searchsorted(s[order], np.arange(len(plan.keys) + 1))))
    mine = [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)]
    long_ = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    routed, laid = T.StructType(mine + long_("_p", "_t", "_u")), T.StructType(mine + long_("_slot", "_rank"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, _, _, cut, _, bounds = shared.value
        for batch in batches:
            source, u = plan.index(batch.column(len(mine))), batch.column(len(mine) + 1).to_numpy()
            which = np.empty(len(u), np.int64)
            for i in np.unique(source):
                here = source == i
                a, b = bounds[i], bounds[i + 1]
                which[here] = a + np.searchsorted(cut[a:b], u[here], "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(mine)], pa.array(shared.value[2][which]), pa.array(which), batch.column(len(mine) + 1)], names=routed.names)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, source, _, _, first, _ = shared.value
        seen: dict[int, int] = {}
        for batch in batches:
            which = batch.column(len(mine) + 1).to_numpy()
            rank = first[which] + np.arange(len(which))
            starts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.zeros(0, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(which)], strict=True):
                rank[a:b] += seen.get(int(which[a]), 0) - a
                seen[int(which[a])] = seen.get(int(which[a]), 0) + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(mine)], pa.array(plan.slot(source[which], rank // block)), pa.array(rank)], names=laid.names)

    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], _key(F.col(source)).alias("_s"), unique.alias("_u"))
    dealt = rows.mapInArrow(route, routed).repartitionById(parts, F.col("_p").cast("int")).sortWithinPartitions("_t", "_u")
    placed = dealt.select(*[f.name for f in mine], "_p", "_t").mapInArrow(lay, laid).sortWithinPartitions("_slot", "_rank")
    return placed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def file_order(docs: DataFrame) -> Column | None:
    """A text that sorts the rows of a table like the files that Spark wrote it to, also beyond 99,999 of them, or none
    where rows do not come from files: numbers in a file's name and the place of the split, padded."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_name"])
    except AnalysisException:
        return None
    name = place["file_name"]
    number = lambda pattern: F.lpad(F.regexp_extract(name, pattern, 1), 12, "0")
    return F.concat_ws("@", number(r"^part-(\d+)"), number(r"[-.]c(\d+)\."), name, F.lpad(place["file_block_start"].cast("string"), 20, "0"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)
