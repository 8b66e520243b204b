"""Connected components on DataFrames, by alternating large-star and small-star steps.

Only built-in DataFrame operations, unless the caller lets every task contract its own edges to a
forest first, which saves rounds. Each round is written to the shared folder, so lineage stays
short and a lost executor costs one round at most; nothing is collected but two sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import discard, written

MAX_ROUNDS = 60
#: A node with over 1 / HOT of all edge ends is hot: there are fewer than HOT of them, whatever the data.
HOT = 2000
#: Edges from which hot nodes are looked for, and linked nodes that a contracting task holds.
MANY_EDGES, HELD_NODES = 5000, 250_000


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One star step over ``n`` edges (u, v), u > v: neighbours move to the least node of a neighbourhood.

    The least neighbours of hot nodes (fewer than HOT rows) are broadcast, so that the edges of a hot
    node stay where they are; all other nodes meet theirs by a shuffle.
    """
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "d")
    if n <= MANY_EDGES:
        joined = around.join(least.select("k", "m"), F.col("u") == F.col("k")).select("u", "v", "m")
        return _moved(joined, least, large)
    hot = F.col("d") * HOT > 2 * n
    by_hot = around.join(F.broadcast(least.where(hot).select("k", "m")), F.col("u") == F.col("k"), "left")
    by_key = by_hot.where("k is null").select("u", "v").join(least.where(~hot).select("k", "m"), F.col("u") == F.col("k"))
    joined = by_hot.where("k is not null").select("u", "v", "m").unionByName(by_key.select("u", "v", "m"))
    return _moved(joined, least, large)


def _moved(joined: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of stars with the connectivity of a task's edges (int64), in memory of bounded size."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x)) is not None:
            up[x] = z = up.get(y, y)
            x = z
        return x

    def forest() -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(u), top(v)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) >= HELD_NODES:
            yield forest()
            up.clear()
    yield forest()


def connected_components(edges: DataFrame, src: str, dst: str, contract: bool = False) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is its least node.

    Edges are undirected; loops, repeats and edges with a null end change nothing. Nodes
    that have no edge to another node are not returned. Node type: any orderable type; with
    ``contract`` (Python workers then take part) long.
    A hot node is met with map-side minima before each shuffle and a broadcast of bounded size after.
    """

    def kept(df: DataFrame, label: str) -> DataFrame:
        return written(df.mapInArrow(_contracted, "u long, v long") if contract else df, label, rows=20_000)

    now = kept(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        # sums of hashes tell two edge sets apart; the first round also shows if there are none
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        if contract and before is None:
            tasks, files = -(-state["n"] // HELD_NODES), len(now.inputFiles())
            if tasks < files:  # fewer tasks of bounded size contract more
                old, now = now, kept(now.coalesce(tasks), "edges")
                discard(old)
            if tasks == 1:
                break  # one task held all edges
        before, old = state, now
        now = kept(_star(_star(old, state["n"], large=True), state["n"], large=False), "stars")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
