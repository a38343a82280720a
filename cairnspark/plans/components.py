"""Strongly connected components of dependency edges."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .impact import steps

#: Graphs of at most so many edges, after trimming, are decomposed by one task; larger ones by rounds of joins.
LOCAL_EDGES = 2_000_000


def _decompose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of their component, by Kosaraju's two searches with stacks of their own."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    n, a, b = len(nodes), ends[: len(a)], ends[len(a) :]

    def rows(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.argsort(x, kind="stable")
        return np.searchsorted(x[order], np.arange(n + 1)).tolist(), y[order].tolist()

    begin, to = rows(a, b)
    done, finished, at = [False] * n, [], begin[:-1].copy()
    for root in range(n):
        if done[root]:
            continue
        done[root], path = True, [root]
        while path:
            v = path[-1]
            if at[v] < begin[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not done[w]:
                    done[w] = True
                    path.append(w)
            else:
                finished.append(path.pop())
    begin, to = rows(b, a)
    label = [-1] * n
    for root in reversed(finished):
        if label[root] >= 0:
            continue
        own, todo = [], [root]
        label[root] = root
        while todo:
            v = todo.pop()
            own.append(v)
            for w in to[begin[v] : begin[v + 1]]:
                if label[w] < 0:
                    label[w] = root
                    todo.append(w)
        least = min(own)
        for v in own:
            label[v] = least + n  # marked as final by n
    return nodes, nodes[np.array(label, np.int64) - n] if n else nodes


#: Rounds of single steps before chains are jumped over.
STEPS = 12


def _spread(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """(id, color): the least start that reaches each node over pairs (a, b); start: (id, color).

    A round is a step. If the colors haven't settled after some rounds, nodes with one edge in get a jump along these:
    to the node behind the chain so far, with the least start within it. Jumps double each round, so a chain of any
    length takes as many rounds as its length has binary digits.
    """
    best, jumps, n = start, None, 0
    while True:
        pushed = best.join(pairs, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "color")
        if n >= STEPS:
            if jumps is None:
                single = pairs.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"), F.min("a").alias("p")).filter("n = 1")
                jumps = single.join(start, "id", "left").select("id", "p", F.col("color").alias("m"))
            else:
                far = jumps.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("m").alias("mq"))
                jumps = jumps.join(far, "p", "left").select("id", F.coalesce("q", "p").alias("p"), F.least("m", "mq").alias("m"))  # least passes over nulls
            jumps = materialize(jumps, "scc-jumps")
            met = jumps.join(best.select(F.col("id").alias("p"), "color"), "p", "left").select("id", F.least("m", "color").alias("color")).filter("color is not null")
            pushed = pushed.unionByName(met)
        new = materialize(best.unionByName(pushed).groupBy("id").agg(F.min("color").alias("color")), "scc-color")
        if new.join(best, ["id", "color"], "left_anti").isEmpty():
            return new
        best, n = new, n + 1


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of every end of a dependency edge; component: its least member.

    Nodes without edges in or without edges out are components of their own and are trimmed away until
    none is left. Up to local_edges the rest is decomposed by one task; beyond that, nodes take the least
    color that reaches them forward, and those that reach their color's root within it are a component.
    """
    pairs = materialize(steps(edges).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a <> b").distinct(), "scc-edges")
    every = steps(edges).select(F.col("from_id").alias("id")).union(steps(edges).select("to_id")).distinct()
    size = pairs.count()
    while True:  # trim
        core = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        core = materialize(core, "scc-core")
        now = core.count()
        pairs = core
        if now == size or now <= local_edges:
            size = now
            break
        size = now
    found = None
    if size <= local_edges:

        def run(g: pd.DataFrame) -> pd.DataFrame:
            ids, least = _decompose(g["a"].to_numpy(object), g["b"].to_numpy(object))
            return pd.DataFrame({"id": ids, "component": least})

        found = pairs.groupBy(F.lit(0).alias("all")).applyInPandas(run, "id string, component string") if size else None
    else:
        while size:
            ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
            color = _spread(pairs, ids.withColumn("color", F.col("id")))
            ca, cb = color.select(F.col("id").alias("a"), F.col("color").alias("ca")), color.select(F.col("id").alias("b"), F.col("color").alias("cb"))
            within = materialize(pairs.join(ca, "a").join(cb, "b").filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")), "scc-within")
            roots = color.filter("id = color").select("id", F.col("id").alias("color"))
            reached = _spread(within, roots)
            part = reached.select("id", F.col("color").alias("component"))
            found = part if found is None else found.unionByName(part)
            gone = part.select("id")
            pairs = materialize(pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "scc-rest")
            size = pairs.count()
    if found is None:
        return every.withColumn("component", F.col("id"))
    found = materialize(found, "scc")
    return every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members): components of more than one node, largest first."""
    g = strong_components(edges).groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members"))
    return g.filter("size > 1").orderBy(F.desc("size"), "component")


def core_of(edges: DataFrame, node: str) -> DataFrame:
    """(id, component): members of a node's component, if it has more than one."""
    scc = materialize(strong_components(edges), "scc-all")
    own = scc.filter(F.col("id") == node).select("component")
    mine = scc.join(own, "component").select("id", "component")
    more = mine.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return mine.join(more.select("component"), "component", "left_semi").select("id", "component")


def largest_core(domain_pairs: DataFrame) -> DataFrame:
    """(id): the largest cyclic core of domain edges (from_domain, to_domain), the first of equals."""
    e = domain_pairs.select(F.col("from_domain").alias("from_id"), F.col("to_domain").alias("to_id"), F.lit("calls").alias("kind"), F.lit("exact").alias("confidence"))
    return cycles(e).limit(1).select(F.explode("members").alias("id"))


