"""Betweenness over call edges from a bounded set of sources, and the chokepoints it shows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

SAMPLES, TOP_PERCENT = 100, 5.0
#: Up to so many edges, of those that the sources reach, are sent to each task; more are searched level by level.
TASK_EDGES = 1_000_000


def _from_source(n: int, begin: np.ndarray, to: np.ndarray, s: int) -> np.ndarray:
    """Dependencies of all nodes on a source (Brandes 2001), level by level."""
    dist, sigma = np.full(n, -1), np.zeros(n)
    dist[s], sigma[s] = 0, 1
    levels, frontier = [], np.array([s])
    while len(frontier):
        m = begin[frontier + 1] - begin[frontier]
        v = np.repeat(frontier, m)
        w = to[np.repeat(begin[frontier] - np.cumsum(m) + m, m) + np.arange(len(v))]
        new = np.unique(w[dist[w] < 0])
        dist[new] = dist[frontier[0]] + 1
        down = dist[w] == dist[frontier[0]] + 1
        v, w = v[down], w[down]
        np.add.at(sigma, w, sigma[v])
        levels.append((v, w))
        frontier = new
    delta = np.zeros(n)
    for v, w in reversed(levels):
        np.add.at(delta, v, sigma[v] / sigma[w] * (1 + delta[w]))
    delta[s] = 0
    return delta


#: Decimals in which scores are compared: sums of fractions in another order differ beyond them.
DIGITS = 6


def _reachable(calls: DataFrame, sources: DataFrame, entered: DataFrame) -> tuple[DataFrame, int]:
    """The edges that the sources may reach, each once, and their number: edges of nodes that are no source and that no
    edge leads to fall away, round by round, while that takes a tenth of the edges. What is left holds every path from a
    source. entered: the nodes that edges lead to."""
    n = calls.count()
    while True:
        kept = materialize(calls.join(entered.select(F.col("id").alias("a")).union(sources.select("id")), "a", "left_semi"), "reachable-calls")
        m = kept.count()
        if m >= 0.9 * n:
            break
        calls, n, entered = kept, m, kept.select(F.col("b").alias("id")).distinct()
    # Parallel edges don't change what is reached, so only what is left is made different.
    once = materialize(kept.distinct(), "reachable-once")
    return once, once.count()


def _by_tasks(calls: DataFrame, names: list[str], tasks: int) -> DataFrame:
    """(id, score) where each task has all edges, a bounded table, and takes its share of the sources."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ends = [table.column(c).to_numpy() for c in ("a", "b")]
        ids, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = at[: table.num_rows], at[table.num_rows :]
        order = np.argsort(a, kind="stable")
        begin, to = np.searchsorted(a[order], np.arange(len(ids) + 1)), b[order]
        total = np.zeros(len(ids))
        for s in names[int(key[0].as_py()) :: tasks]:
            i = int(np.searchsorted(ids, s))
            if i < len(ids) and ids[i] == s:
                total += _from_source(len(ids), begin, to, i)
        return pa.table({"id": pa.array(ids, pa.string()), "score": total})

    dealt = calls.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return dealt.groupBy("task").applyInArrow(run, "id string, score double").groupBy("id").agg(F.sum("score").alias("score"))


def _by_levels(calls: DataFrame, names: list[str]) -> DataFrame:
    """(id, score) by joins, level by level, for all sources at once: a node of a level is one row, which has the
    number of shortest paths from each source as a column (none: 0), so a level sends one row an edge, not one a source
    and edge."""
    spark, k = calls.sparkSession, range(len(names))
    start = spark.createDataFrame([(x, *(float(i == j) for j in k)) for i, x in enumerate(names)], ", ".join(["id string", *(f"n{i} double" for i in k)]))
    any_path = F.greatest(*(F.col(f"n{i}") for i in k), F.lit(0.0)) > 0
    levels, seen = [materialize(start, "level")], None
    while True:
        last = levels[-1]
        # seen: of each node the sources that have met it, as 1.
        met = last.select("id", *(F.signum(f"n{i}").alias(f"m{i}") for i in k))
        seen = met if seen is None else seen.unionByName(met)
        seen = materialize(seen.groupBy("id").agg(*(F.max(f"m{i}").alias(f"m{i}") for i in k)), "level-seen")
        stepped = last.join(calls, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in k))
        new = stepped.join(seen, "id", "left").select("id", *(F.when(F.coalesce(f"m{i}", F.lit(0.0)) == 0, F.col(f"n{i}")).otherwise(0.0).alias(f"n{i}") for i in k)).filter(any_path)
        new = materialize(new, "level")
        if new.isEmpty():
            break
        levels.append(new)
    total, delta = None, None
    for level in reversed(levels[1:]):  # the sources themselves don't count
        if delta is None:
            delta = level.select("id", *(F.lit(0.0).alias(f"d{i}") for i in k))
        else:
            below = deeper.join(delta, "id").select(F.col("id").alias("b"), *(F.when(F.col(f"n{i}") > 0, (1 + F.col(f"d{i}")) / F.col(f"n{i}")).otherwise(0.0).alias(f"x{i}") for i in k))
            up = below.join(calls, "b").groupBy(F.col("a").alias("id")).agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in k))
            delta = level.join(up, "id", "left").select("id", *((F.col(f"n{i}") * F.coalesce(f"x{i}", F.lit(0.0))).alias(f"d{i}") for i in k))
        delta, deeper = materialize(delta, "level-delta"), level
        one = delta.select("id", sum((F.col(f"d{i}") for i in k), F.lit(0.0)).alias("score"))
        total = one if total is None else total.unionByName(one)
    if total is None:
        return spark.createDataFrame([], "id string, score double")
    return total.groupBy("id").agg(F.sum("score").alias("score"))


def bridge_scores(edges: DataFrame, samples: int = SAMPLES, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, score) of every end of a call edge: directed, not normalised, ends not counted; sources are the
    first `samples` nodes in the order of their ids. Parallel edges count once. Edges that no source reaches fall away
    first; of what is left, up to task_edges go to the tasks, which take a source each."""
    calls = edges.filter("kind = 'calls'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    ends = calls.select(F.col("a").alias("id"), F.lit(False).alias("entered")).union(calls.select("b", F.lit(True)))
    ids = materialize(ends.groupBy("id").agg(F.bool_or("entered").alias("entered")), "call-ends")
    names = [r["id"] for r in ids.orderBy("id").limit(samples).select("id").collect()]
    near, n = _reachable(calls, edges.sparkSession.createDataFrame([(x,) for x in names], "id string"), ids.filter("entered").select("id"))
    tasks = max(1, min(len(names), edges.sparkSession.sparkContext.defaultParallelism))
    scores = _by_tasks(near, names, tasks) if n <= task_edges else _by_levels(near, names)
    # Written, so that their size is known: where few nodes are bridges, all the others need not be moved to meet them.
    scores = materialize(scores.filter("score <> 0"), "bridge-scores")
    return ids.select("id").join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def chokepoints(edges: DataFrame, nodes: DataFrame, samples: int = SAMPLES, top_percent: float = TOP_PERCENT) -> DataFrame:
    """(id, score, is_chokepoint): positive scores, and whether they reach that at place floor(n * (1 - top%))
    of all positive scores in ascending order."""
    scores = materialize(bridge_scores(edges, samples).withColumn("score", F.round("score", DIGITS)).filter("score > 0"), "bridge")
    n = scores.count()
    if not n:
        return scores.withColumn("is_chokepoint", F.lit(False))
    place = max(0, min(n - 1, int(n * (1 - top_percent / 100))))
    # The place from the top is small by definition, so a top-k finds the threshold without a global window.
    least = scores.orderBy(F.desc("score")).limit(n - place).agg(F.min("score").alias("least"))
    return scores.join(least).select("id", "score", (F.col("score") >= F.col("least")).alias("is_chokepoint"))


def top_bridges(edges: DataFrame, n: int = 10, samples: int = SAMPLES) -> DataFrame:
    """(id, score) of the n highest positive scores, ties to the lesser id."""
    return bridge_scores(edges, samples).withColumn("score", F.round("score", DIGITS)).filter("score > 0").orderBy(F.desc("score"), "id").limit(n)


