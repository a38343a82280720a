"""Consistent-hash sharding with virtual nodes and bounded loads, as DataFrame operations.

The ring has a power of two of cells. Keys fall into cells by hash and are taken in ring order; a key goes
to the shard of the next virtual node clockwise, and past those whose shard is full. Which keys go where
depends on the number of keys in each cell alone, so the driver gets one count a cell (their number is
bounded), and the rows are numbered within their cells by a window over small keys.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize

VIRTUAL_NODES = 128
#: Cells of the ring, as powers of two, and rows of a cell that are aimed at.
LEAST_CELLS, MOST_CELLS, CELL_ROWS = 12, 20, 20_000
#: A cell of so many times the mean is numbered in parts of about so many rows.
HOT, PART_ROWS = 8, 5_000


def ring(shards: int, bits: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, in ring order."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}", 42) >> (64 - bits), s) for s in range(shards) for v in range(virtual_nodes))


def even_capacities(total: int, shards: int) -> list[int]:
    """Rows that each shard may take: counts at most one apart that add up to all rows."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def place(counts: list[tuple[int, int, int]], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """counts: (cell, part, rows) in ring order. Returns runs (cell, part, first, end, shard, slot of the
    first): rows numbered first to end - 1 of a cell go to a shard."""
    load, out, at = [0] * len(capacity), [], 0
    for cell, part, rows in counts:
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        first, k = 0, at
        while first < rows:
            shard = nodes[k % len(nodes)][1]
            take = min(rows - first, capacity[shard] - load[shard])
            if take:
                out.append((cell, part, first, first + take, shard, load[shard]))
                load[shard] += take
                first += take
            k += 1
            if k > at + len(nodes) * 2:
                raise ValueError("the capacities are less than the rows")
    return out


def assign(rows: DataFrame, key: list[str | Column], shards: int, capacity: list[int] | None = None, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """rows' columns with shard (int) and slot (long, gapless from 0 in each shard).

    Every row is placed once. Equal capacities (counts at most one apart) unless others are given. The
    key decides where a row starts on the ring; nulls are keys like others; rows whose key and columns
    are equal are interchangeable. A cell crowded by equal keys is numbered in parts. A column named
    shard or slot is renamed input_<name>. Empty input gives empty output.
    """
    rows = rows.withColumnsRenamed({c: f"input_{c}" for c in rows.columns if c.lower() in ("shard", "slot")})
    at, cell, part, tie, n, first, end, start = fresh([*rows.columns, "shard", "slot"], "at", "cell", "part", "tie", "n", "first", "end", "start")
    # Once written, rows keep their ties: a cell's parts are the same in every scan.
    keyed = materialize(rows.withColumns({at: F.xxhash64(*key), tie: F.xxhash64(F.monotonically_increasing_id())}), "shard-keys")
    total = keyed.count()
    bits = min(MOST_CELLS, max(LEAST_CELLS, (total // CELL_ROWS).bit_length()))
    keyed = keyed.withColumn(cell, F.shiftrightunsigned(at, 64 - bits))
    counts = {(r[cell], 0): r["count"] for r in keyed.groupBy(cell).count().toLocalIterator()}
    hot = [(c, -(-n_ // PART_ROWS)) for (c, _), n_ in counts.items() if n_ > max(HOT * (total / (1 << bits)) + 1000, PART_ROWS)]
    if hot:
        parts = rows.sparkSession.createDataFrame(hot, f"{cell} long, {part} int")  # of at most 2**MOST_CELLS / HOT cells
        keyed = keyed.join(F.broadcast(parts), cell, "left").withColumn(part, F.coalesce(F.pmod(F.col(tie), F.col(part)), F.lit(0)).cast("int"))
        counts = {(r[cell], r[part]): r["count"] for r in keyed.groupBy(cell, part).count().toLocalIterator()}
    else:
        keyed = keyed.withColumn(part, F.lit(0))
    runs = place([(c, p, k) for (c, p), k in sorted(counts.items())], ring(shards, bits, virtual_nodes), capacity or even_capacities(total, shards))
    plan = rows.sparkSession.createDataFrame(runs, f"{cell} long, {part} int, {first} long, {end} long, shard int, {start} long")
    number = F.row_number().over(Window.partitionBy(cell, part).orderBy(at, *(F.col(f"`{c}`") for c in rows.columns), tie)) - 1
    numbered = keyed.withColumn(n, number)
    placed = numbered.join(F.broadcast(plan), [cell, part]).filter((F.col(n) >= F.col(first)) & (F.col(n) < F.col(end)))  # a run a cell, and one for each shard that fills
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), "shard", (F.col(start) + F.col(n) - F.col(first)).cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots within each file."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
