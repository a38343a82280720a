"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted. A task packs its share of the pieces, longest first: a piece goes
to the open bin that it fits best, or opens the bin size of least cost per token it may come to hold. The
packing is made once for each largest size that may be opened freely, and the cheapest one stays. In the
end each bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITIES = (1024, 4096, 16384)
#: Documents that one task packs, at most about.
GROUP_ROWS = 50_000
#: Cost of a sequence: its length, a fixed share, and attention's growth with the length.
FIXED_COST, ATTENTION_SCALE = 32.0, 65536.0


def byte_tokens(text: Column) -> Column:
    """Length in byte-level tokens with an end mark; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def cost(length: int) -> float:
    return FIXED_COST + length * (1 + length / ATTENTION_SCALE)


def pack(lengths: np.ndarray, capacities: tuple[int, ...], free: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Bins of pieces no longer than the largest capacity: (bin of each piece, its capacity by bin, cost).

    free: the largest capacity that is opened for a piece that fits a smaller one too.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    rest = int(lengths.sum())
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    room: list[int] = []
    size: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(open_, (n, -1))
        if at < len(open_):
            r, b = open_.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            c = min((c for c in fits if c <= free or c == fits[0]), key=lambda c: (cost(c) / min(c, rest), c))
            r, b = c, len(size)
            size.append(c)
            room.append(c)
        bins[i] = b
        room[b] = r - n
        rest -= n
        if r > n:
            insort(open_, (r - n, b))
    used = np.array(size, np.int64) - np.array(room, np.int64)
    caps = np.sort(np.asarray(capacities))
    shrunk = caps[np.searchsorted(caps, used)] if len(used) else used
    return bins, shrunk, float(sum(cost(int(c)) for c in shrunk))


def best_pack(lengths: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, float]:
    return min((pack(lengths, capacities, c) for c in capacities), key=lambda x: x[2])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, position, used, capacity.

    A document longer than the largest capacity is cut into pieces of that length and a rest; nothing is
    cut or dropped otherwise. start: the piece's first token in its document; position: in its bin.
    tokens: a document's length, byte-level tokens unless given; null and values below 1 count as 1.
    Groups are even shares of the rows, whatever their ids, so repeated rows are packed each.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    capacities = tuple(sorted(set(capacities)))
    n = F.greatest(F.coalesce(tokens if tokens is not None else byte_tokens(F.col(text_col)), F.lit(1)).cast("long"), F.lit(1))
    lens = materialize(docs.select(F.col(id_col).alias("doc_id"), n.alias("n")), "pack-lengths")
    top = capacities[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.column("n").to_numpy()
        count = -(-n // top)
        doc = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * top
        length = np.minimum(n[doc] - start, top)
        bins, caps, _ = best_pack(length, capacities)
        order = np.argsort(bins, kind="stable")
        doc, piece, start, length, bins = (x[order] for x in (doc, piece, start, length, bins))
        used = np.bincount(bins, weights=length, minlength=len(caps)).astype(np.int64)
        before = np.cumsum(length) - length
        position = before - (np.cumsum(used) - used)[bins]
        group = TaskContext.get().partitionId() << 32
        cols = [table.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, bins + group, position, used[bins], caps[bins]))]
        yield from pa.Table.from_arrays(cols, names=["doc_id", "piece", "start", "n_tokens", "bin_id", "position", "used", "capacity"]).to_batches(100_000)

    kind = docs.schema[id_col].dataType.simpleString()
    groups = max(1, -(-lens.count() // group_rows))
    return lens.repartition(groups).mapInArrow(run, f"doc_id {kind}, piece int, start long, n_tokens long, bin_id long, position long, used long, capacity long")
