"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x), and a score is an integer inner product,
so results are exact and ties are real. Queries and candidates are dealt over a grid
of cells of bounded size (a cell holds about ``CELL_QUERIES`` queries and
``CELL_VECTORS`` candidates); the scores of a cell come from matrix products over ``STEP`` candidates at a time. Every
pass sends a candidate to n_queries / CELL_QUERIES cells.

1. Every round scores everything and counts, for each query, how many scores fall
   into each of ``BINS`` bins of the interval that holds its k-th highest score; a
   cell counts its highest k scores only, which no lower ones can displace. Summed
   over all cells the histogram tells the bin of the k-th score, which is the next
   round's interval, until a bin is a single score.
2. The last pass keeps scores above the k-th, and of the scores equal to it the
   smallest ids, as many as are wanted, of each cell; ranks break ties by id.

Rows whose vector or id is null, or whose vector holds a null or non-finite
component, take no part. Vectors of unequal length are compared as if the shorter
ended in zeros. A score that doesn't fit 64 bits is an error. Repeated rows each take part; a query leaves out its own row only.
Fewer candidates than k give fewer rows, empty tables none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, release

#: Queries and candidates of a cell, candidates that it scores at a time, and bins of an interval.
CELL_QUERIES, CELL_VECTORS, STEP, BINS = 1024, 16_384, 2048, 4096


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    out = np.zeros((len(t), dim))
    for k, v in enumerate(t["v"]):
        own = np.frombuffer(v.as_buffer(), dtype=np.float64)
        out[k, : len(own)] = own
    return out


def _scores(q: pa.Table, c: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The integer scores of all queries with ``STEP`` candidates at a time, and the first one's place; a query's own row gets the least integer."""
    dim = max(1, *(max((len(v.as_buffer()) // 8 for v in t["v"]), default=0) for t in (q, c)))
    x, y = _matrix(q, dim), _matrix(c, dim)
    q_rows, c_rows = q["row"].to_numpy(), c["row"].to_numpy()
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * dim < 2**53
    for lo in range(0, len(y), STEP):
        s, own = x @ y[lo : lo + STEP].T, q_rows[:, None] == c_rows[None, lo : lo + STEP]
        if not exact:  # a double doesn't hold every partial sum; integers do, if the score fits at all
            if float(np.abs(s[~own]).max(initial=0)) >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("a score doesn't fit 64 bits")
            s = x.astype(np.int64) @ y[lo : lo + STEP].astype(np.int64).T
        s = s.astype(np.int64)
        s[own] = np.iinfo(np.int64).min
        yield lo, s


def _above(own: np.ndarray, low: int) -> np.ndarray:
    """own - low of numbers not below ``low``; the difference may need all 64 bits."""
    return own.view(np.uint64) - np.array([low], dtype=np.int64).view(np.uint64)


def _histogram(k: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        rows, bins, counts = [], [], []
        if len(q) and len(c):
            low, width, above = (q[n].to_numpy() for n in ("low", "width", "above"))
            best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
            for _, s in _scores(q, c):
                for i in range(len(q)):
                    own = s[i]
                    inside = own[(own >= low[i]) & (own > np.iinfo(np.int64).min)]
                    inside = np.concatenate([best[i], inside[_above(inside, low[i]) // np.uint64(width[i]) < BINS]])
                    want = k - int(above[i])
                    best[i] = np.partition(inside, len(inside) - want)[len(inside) - want :] if len(inside) > want else inside
            for i, row in enumerate(q["row"].to_pylist()):
                b, n = np.unique(_above(best[i], low[i]) // np.uint64(width[i]), return_counts=True)
                rows += [row] * len(b)
                bins.append(b.astype(np.int64))
                counts.append(n)
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"row": pa.array(rows, pa.int64()), "bin": flat(bins), "n": flat(counts)})

    return run


def _winners(k: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(q) and len(c):
            low, above, ids, own_rows = q["low"].to_numpy(), q["above"].to_numpy(), c["vec_id"].to_numpy(), c["row"].to_numpy()
            for lo, s in _scores(q, c):
                here, rows_here = ids[lo : lo + STEP], own_rows[lo : lo + STEP]
                order = np.lexsort((rows_here, here))
                for i, row in enumerate(q["row"].to_pylist()):
                    over = np.flatnonzero((s[i] > low[i]) & (s[i] > np.iinfo(np.int64).min))
                    same = order[s[i][order] == low[i]][: k - int(above[i])]
                    for j in np.concatenate([over, same]).tolist():
                        for column, value in zip(out, (row, int(here[j]), int(rows_here[j]), int(s[i][j])), strict=True):
                            column.append(value)
        return pa.table(dict(zip(("row", "vec_id", "other", "score"), (pa.array(x, pa.int64()) for x in out), strict=True)))

    return run


def _grid(queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int):
    """Both sides dealt over the cells (r, c), grouped by cell."""
    high, wide = max(1, math.ceil(n_queries / CELL_QUERIES)), max(8, math.ceil(n_vectors / CELL_VECTORS))
    q = queries.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(high))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(wide - 1).cast("bigint"))))
    v = vectors.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(wide))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(high - 1).cast("bigint"))))
    return q.groupBy("r", "c").cogroup(v.groupBy("r", "c"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that fits ``is_query`` (over the column ``vec_id``) its k highest scores among all other rows."""
    parts = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    own = vectors.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), parts.alias("x"))

    def pack(batches):
        for batch in batches:
            x = batch.column(1)
            flat = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            ends = (np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))]) * 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])], names=["vec_id", "v"])

    packed = own.mapInArrow(pack, "vec_id bigint, v binary").withColumn("row", F.monotonically_increasing_id())
    peak = own.agg(F.max(F.aggregate("x", F.lit(0.0), lambda n, c: n + c * c))).first()[0]
    rows = materialize(packed, "vectors")
    n_vectors, n_queries = rows.count(), rows.filter(is_query).count()
    # no product is larger than the square of the greatest norm, and none that counts than 64 bits hold
    bound = min(int((peak or 0.0) * (1 + 1e-9)) + 1, 2**63 - 1)
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    queries = rows.filter(is_query).select("row", "vec_id", "v", F.lit(-bound).cast("bigint").alias("low"), F.lit(width).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("above"))
    states = []
    while True:
        counts = _grid(queries, rows, n_queries, n_vectors).applyInArrow(_histogram(k), "row bigint, bin bigint, n bigint").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.withColumn("upto", upto).join(queries.select("row", "above"), "row").filter("above + upto - n < " + str(k))
        # the lowest bin that is still needed holds the k-th score, or the last one if there are fewer
        kth = ranked.groupBy("row").agg(F.min("bin").alias("bin"), F.max(F.col("above") + F.col("upto")).alias("total"), F.min_by("n", "bin").alias("n"))
        step = queries.join(kth, "row").select("row", "vec_id", "v", (F.col("low").cast("decimal(20,0)") + F.col("bin").cast("decimal(4,0)") * F.col("width").cast("decimal(19,0)")).cast("bigint").alias("low"), F.greatest(F.lit(1), F.expr(f"width div {BINS}")).alias("width"), (F.col("total") - F.col("n")).alias("above"))
        queries = materialize(step, "queries")
        states.append(queries)
        if width == 1:
            break
        width //= BINS
    best = _grid(queries, rows, n_queries, n_vectors).applyInArrow(_winners(k), "row bigint, vec_id bigint, other bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other"))
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
    out = ranked.join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
    release(states[:-1])
    return out
