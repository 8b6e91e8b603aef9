"""Connected components of a link table by alternating large and small stars, each round stored in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise

MAX_ROUNDS = 60
#: Nodes that a task holds before it sends their links on.
HELD = 1 << 18
#: A hub has more neighbours than this and than one in HUB_SHARE of all links; its links are dealt to tasks of about so
#: many.  There are at most 2 * HUB_SHARE hubs, so their list is bounded whatever the input.
HUB = 1024
HUB_SHARE = 1000
#: So many links at most (2 MB) are settled on the driver, whatever the input; rounds over few links are all overhead.
FEW = 1 << 17


class _Forest:
    """Nodes with the smallest node that links reach; a node that nothing smaller reaches is left out."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def link(self, batch: pa.RecordBatch) -> None:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.fromiter(self.parent, np.int64, len(self.parent))
        return nodes, np.fromiter((self.root(x) for x in self.parent), np.int64, len(self.parent))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by links of each node to the smallest node it reaches there, HELD nodes at a time."""
    forest = _Forest()

    def out() -> Iterator[pa.RecordBatch]:
        nodes, roots = forest.rows()
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], names=["u", "v"])

    for batch in batches:
        forest.link(batch)
        if len(forest.parent) > HELD:
            yield from out()
            forest.parent.clear()
    yield from out()


def join_dealt(rows: DataFrame, table: DataFrame, key: str, spread: str, n: int, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` (about ``n`` of them) joined with a table that has a row for each ``key``, without all rows of a hub in
    one task: those are dealt by a hash of ``spread``, and the hub's row of the table is repeated for each share.
    ``counts`` has the rows of each key as ``_n``, if they are known."""
    most = max(HUB, n // HUB_SHARE)
    counts = (rows.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts).filter(F.col("_n") > most).select(key, "_n").collect()
    if not counts:
        return rows.join(table, key)
    kind = rows.schema[key].dataType.simpleString()
    hubs = F.broadcast(rows.sparkSession.createDataFrame([(r[key], -(-r["_n"] // most)) for r in counts], f"{key} {kind}, _d long"))
    shares = lambda df: df.join(hubs, key, "left").withColumn("_d", F.coalesce("_d", F.lit(1)))
    dealt = shares(rows).withColumn("_s", F.pmod(F.xxhash64(spread), F.col("_d"))).drop("_d")
    return dealt.join(shares(table).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_d") - 1))).drop("_d"), [key, "_s"]).drop("_s")


def _with_least(edges: DataFrame, least: Column, n: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, ``least`` over the links of u, which tasks reduce before they are shuffled."""
    return join_dealt(edges, edges.groupBy("u").agg(least.alias("m")), "u", "v", n)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node.

    ``links`` has two integer columns; null ends, self-links and repeated links are ignored.  Rows for a component's
    smallest node are left out: a node that isn't in the result is its own component.  No table but the result stays.  Up to
    FEW links are settled on the driver, more of them by rounds over stored tables.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = materialise(edges.mapInArrow(_contract, "u long, v long").filter("u <> v").distinct(), "links")
    before, n = None, edges.count()
    if n <= FEW:
        forest = _Forest()
        for batch in edges.toArrow().to_batches():
            forest.link(batch)
        discard(edges)
        nodes, roots = forest.rows()
        return materialise(links.sparkSession.createDataFrame(pa.table({"node": nodes, "component": roots})), "components")
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_with_least(both, F.least(F.min("v"), F.col("u")), 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        placed = _with_least(large, F.min("v"), n)
        small = placed.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(placed.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, materialise(small, "links")
        discard(old, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
