"""Exact top-k inner-product search with vector-approximation files.

Each vector has a row in the approximation file: one byte a component, the cell of a grid whose ranges are those of
the components over all vectors. Blocks of cells meet groups of queries in tasks: the cells give each score up to a
gap that depends on the query alone, so the order of lower bounds is that of upper bounds, and what a block's kth
lower bound excludes is dropped. Exact vectors are not sent along. They are read, by row, for the candidates of the
best bounds first; then for those whose bound still reaches the kth exact score found. Components are integers,
floor(scale * x), and exact scores are integers too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_below, discard, materialize

#: Rows of a block and queries that meet it in one task, at most about.
BLOCK_ROWS, BLOCK_QUERIES = 100_000, 10_000
LEAST_BLOCKS = 24
CELLS = 256
#: Candidate rows, and queries, that are broadcast to the exact vectors; more are joined by a shuffle.
BROADCAST_PAIRS, BROADCAST_QUERIES = 500_000, 20_000


class VAFile:
    """Cells of vectors on a grid of CELLS steps a component. low, high: the components' ranges, by default those of
    the given vectors."""

    def __init__(self, exact: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
        self.low = (exact.min(axis=0) if low is None else low).astype(np.float64)
        high = (exact.max(axis=0) if high is None else high).astype(np.float64)
        self.width = np.maximum(1.0, np.ceil((high - self.low + 1) / CELLS))
        self.cells = np.clip((exact - self.low) // self.width, 0, CELLS - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries x vectors the upper bounds (the best corner of each cell), and by query the gap down to the
        lower bounds. Sums are in single precision; their rounding is part of the gap."""
        q = queries.astype(np.float64)
        step, base = q * self.width, (q @ self.low)
        reach = np.abs(q) @ (self.width - 1)
        slack = (len(self.low) + 4) * 2.0**-22 * (np.abs(step).sum(axis=1) * CELLS) + (len(self.low) + 4) * 2.0**-50 * (np.abs(q) @ np.abs(self.low))
        top = base + np.where(q > 0, q * (self.width - 1), 0).sum(axis=1) + slack
        kind = np.float32 if np.abs(step).sum(axis=1).max(initial=0) < 2.0**100 else np.float64
        return top[:, None] + (step.astype(kind) @ self.cells.T.astype(kind)), reach + 2 * slack

    def upper_bounds(self, queries: np.ndarray) -> np.ndarray:
        return self.bounds(queries)[0]


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components; an empty vector is usable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch, for each dimension its rows and their vectors."""
    dims = np.asarray(b.column("dim"))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _matrix(b.column("v").take(pa.array(at)), dim)


def ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each component, by place, over all rows: as many numbers as the longest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            for dim, _, v in _by_dim(b):
                a, z = v.min(axis=0), v.max(axis=0)
                n = min(dim, len(low))
                low, high = np.append(np.minimum(low[:n], a[:n]), (low if len(low) > dim else a)[n:]), np.append(np.maximum(high[:n], z[:n]), (high if len(high) > dim else z)[n:])
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["place", "low", "high"])

    found = rows.select("dim", "v").mapInArrow(run, "place bigint, low bigint, high bigint").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by("place")
    return np.asarray(found.column("low"), np.int64), np.asarray(found.column("high"), np.int64)


def _exact(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """pairs with the exact score of each: the vectors of their rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(b.num_rows, np.int64)
            for dim, at, v in _by_dim(b):
                score[at] = (v * _matrix(b.column("qv").take(pa.array(at)), dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("query", "query_id", "vec_id")), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    joined = rows.select("row", "id", "v", "dim").join(broadcast_below(pairs, BROADCAST_PAIRS), "row")
    joined = joined.join(broadcast_below(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("qv")), BROADCAST_QUERIES), "query")
    kind = rows.schema["id"].dataType.simpleString()
    return joined.select("query", "query_id", F.col("id").alias("vec_id"), "v", "qv", "dim").mapInArrow(run, f"query bigint, query_id {kind}, vec_id {kind}, score bigint")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query, other than rows of its own id, ties to
    smaller ids.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; a query meets the
    vectors of its own dimension. Repeated rows are candidates each, and repeated query rows count once. Other
    columns are not read. Empty tables give no rows. Scores that overflow a long wrap around.
    """

    def parts(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
        return df.select(F.col(id_col).alias("id"), F.when(usable(F.col(vector_col)), v).alias("v")).filter("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v"))

    numbered = F.monotonically_increasing_id()  # once written, a row keeps it
    rows, asked = materialize(parts(vectors).withColumn("row", numbered), "va-vectors"), materialize(parts(queries).dropDuplicates(["id", "v"]).withColumn("row", numbered), "va-queries")
    low, high = ranges(rows)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS), LEAST_BLOCKS)
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, v in _by_dim(b):
                cells = VAFile(v, low[:dim], high[:dim]).cells
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("row", "id", "dim")), pa.array([x.tobytes() for x in cells], pa.binary())], names=["row", "id", "dim", "cells"])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = right.column("dim")[0].as_py()
            file = VAFile(np.empty((0, dim)), low[:dim], high[:dim])
            file.cells = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
            row, ids, own = left.column("row").to_numpy(), left.column("id").to_numpy(), right.column("id").to_numpy()
            query, exact = right.column("row").to_numpy(), _matrix(right.column("v"), dim)
            step = max(1, 4_000_000 // len(ids))
            for s in range(0, len(query), step):
                top, gap = file.bounds(exact[s : s + step])
                top[own[s : s + step][:, None] == ids] = -np.inf
                least = np.partition(top, -k, axis=1)[:, -k] - gap if len(ids) > k else np.full(len(gap), -np.finfo(np.float64).max)
                i, j = np.nonzero(top >= np.maximum(least, -np.finfo(np.float64).max)[:, None])
                out.append((query[s + i], row[j], top[i, j], gap[i]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
        return pa.Table.from_arrays([pa.array(x) for x in cols], names=["query", "row", "top", "gap"])

    # Each block of cells meets each group of queries in a task.
    kind = rows.schema["id"].dataType.simpleString()
    cells = rows.mapInArrow(quantise, f"row bigint, id {kind}, dim int, cells binary")
    left = cells.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = left.groupBy("dim", "b", "g").cogroup(right.groupBy("dim", "b", "g")).applyInArrow(scan, "query bigint, row bigint, top double, gap double")
    # Of all blocks: the kth lower bound of a query excludes more.
    whole = Window.partitionBy("query")
    ranked = near.withColumn("n", F.row_number().over(whole.orderBy(F.desc("top"), "row"))).withColumn("kth", F.max(F.when(F.col("n") == k, F.col("top"))).over(whole))
    near = materialize(ranked.filter("kth is null or top >= kth - gap").drop("kth", "gap"), "va-candidates")
    first = near.filter(F.col("n") <= 2 * k)
    some = materialize(_exact(first.select("query", "row"), rows, asked), "va-first")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    floor = some.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query", F.col("score").alias("floor"))
    rest = near.filter(F.col("n") > 2 * k).join(floor, "query").filter("top >= floor").select("query", "row")
    rest = materialize(rest, "va-rest")
    every = some.union(_exact(rest, rows, asked)) if not rest.isEmpty() else some
    out = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    discard(near)
    return out
