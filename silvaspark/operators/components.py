"""Connected components over an edge table.

Alternating large-star and small-star steps: each step is one partial aggregation and one
equi-join, the edge count never grows beyond its start, and the number of rounds is logarithmic.
Every round is written to the shared folder, so lineage stays short and lost executors cost
only the round they were in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.runtime import written


#: Edges that one task may settle (32 MB), for callers that ask for it.
FEW_EDGES = 2_000_000


def _with_minimum(e: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the minimum of their end ``u``. The join is on the complement of ``u``, so both sides come to it through
    an exchange of its own, and the edges of a star's centre, which all have one key, can be split over tasks at run time."""
    a = e.select(F.bitwise_not("u").alias("k"), "u", "v")
    return a.join(low.select(F.bitwise_not("u").alias("k"), "m"), "k").select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_minimum(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_minimum(down, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v")


def _all_stars(e: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: no node has two smaller neighbours, or one of either kind.
    This takes one aggregation by node, where another round would only find that nothing moves."""
    ends = e.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(n).alias("down")) for c, n in (("u", 1), ("v", 0))))))
    seen = ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("least"))
    return seen.where("n > 1 or n = 1 and least = 0").isEmpty()


def _settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each): roots are joined to smaller ones and paths halved until nothing moves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up, up[up]):
            up = up[up]


def _in_one_task(e: DataFrame) -> DataFrame:
    def solve(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, component = _settled(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

    return e.select("u", "v").repartition(1).mapInArrow(solve, "node long, component long")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``edges(u, v)`` with BIGINT ends to ``(node, component)``.

    Up to ``few`` different edges, which are counted first, are settled in one task (16 bytes each) instead of rounds.

    ``component`` is the smallest node of the component. Self loops and repeated edges are
    ignored; rows with a null end are dropped; nodes without an edge to another node do not
    appear. An empty edge table gives an empty result.
    """
    e = written(
        edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
    )
    if few and 0 < e.count() <= few:
        return _in_one_task(e)
    rounds = 0
    while not _all_stars(e):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        e = written(_small_star(_large_star(e)).distinct(), "cc")
        rounds += 1
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
