"""Connected components by local forests and alternating large-star and small-star steps.

Every task first replaces its edges by a forest (each node pointing to the least node
of its tree), a million edges at a time, which needs no shuffle and flattens chains.
If what is left is at most ``ONE_TASK`` edges (16 bytes each, counted first), one task
does the same with all of them and that is the answer. More edges go through rounds of
star steps: each step is a grouped minimum (combined before the shuffle) and a join
back, so a node with very many neighbours is neither collected nor held in one task.
Each round is written to the shared folder, and the rounds end when the edges no longer
change. Both ways give the same roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, materialize, release

#: Edges that one task may take at a time, and at most at the end.
BLOCK, ONE_TASK = 1_000_000, 1_000_000


def _forest(pairs: np.ndarray) -> pa.RecordBatch:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): every node of a tree but its least, with its least; one forest for each BLOCK edges of a task."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1))
        n += len(batch)
        if n >= BLOCK:
            yield _forest(np.concatenate(held))
            held, n = [], 0
    if n:
        yield _forest(np.concatenate(held))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first())


def components(edges: DataFrame, *, flat: bool = False) -> DataFrame:
    """node, root for every node of the edges (a, b: bigint) that has another node; the root is the least node reachable. Materialised. ``flat``: the tasks' edges are forests already."""
    edges = edges.select("a", "b").filter("a <> b")
    now = materialize(edges if flat else edges.mapInArrow(forests, "a bigint, b bigint"), "edges")
    if counted(now) <= ONE_TASK:
        step = materialize(now.coalesce(1).mapInArrow(forests, "a bigint, b bigint"), "edges")
        release([now])
        now = step
    else:
        state = None
        while True:
            step = materialize(_small_star(_large_star(now)), "edges")
            release([now])
            was, now, state = state, step, _state(step)
            if state == was:
                break
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct()), "roots")
    release([now])
    return out
