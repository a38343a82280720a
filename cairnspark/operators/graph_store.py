"""A graph that is stored: tables in partitions by a hash of the path, of which a mutation rewrites those it touches.

Edges are stored twice, by the path of either end, so the edges that lead to a file are found without a look at the
others. A mutation reads the touched partitions, applies the rules of graph_tables to them, and puts the result in their
place by dynamic partition overwrite; partitions that come out empty are deleted. For lookups of single nodes the edges
can also be kept in buckets sorted by one end (see save_lookup).
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_of_id
from ..model import EDGES, FILES, NODES, REFS
from ..storage import materialize, shared_dir
from . import graph_tables

#: Partitions of a table, unless told otherwise.
PARTS = 256


class GraphStore(NamedTuple):
    spark: SparkSession
    root: str
    parts: int = PARTS


#: What a table's rows are dealt by: the path of a file or node, or that in an end's id.
_KEYS = {"files": "path", "nodes": "path", "refs": "from_id", "edges": "from_id", "edges_in": "to_id"}
_EDGE = ["from_id", "to_id", "kind"]


def _part(store: GraphStore, table: str) -> Column:
    key = F.coalesce(F.col(_KEYS[table]), F.lit(""))
    return F.pmod(F.xxhash64(key if _KEYS[table] == "path" else path_of_id(key)), F.lit(store.parts)).cast("int").alias("part")


def _folder(store: GraphStore, table: str) -> str:
    return f"{store.root}/{table}"


def _dealt(rows: DataFrame, order: str) -> DataFrame:
    """Rows by partition, sorted. A partition of many rows, as of a path that many nodes have, is several tasks' and
    several files'; small ones share a task."""
    return rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", order)


def create(store: GraphStore, nodes: DataFrame, edges: DataFrame, refs: DataFrame | None = None, files: DataFrame | None = None) -> GraphStore:
    """Write the tables, replacing what is there. Absent ones are empty."""
    spark = store.spark
    tables = {"nodes": nodes, "edges": edges, "edges_in": edges, "refs": spark.createDataFrame([], REFS) if refs is None else refs, "files": spark.createDataFrame([], FILES) if files is None else files}
    for name, df in tables.items():
        order = _KEYS[name]
        _dealt(df.select("*", _part(store, name)), order).write.mode("overwrite").partitionBy("part").parquet(_folder(store, name))
    return store


def table(store: GraphStore, name: str, schema=None) -> DataFrame:
    """A table's rows with their partition (part)."""
    schema = schema or {"nodes": NODES, "edges": EDGES, "edges_in": EDGES, "refs": REFS, "files": FILES}[name]
    try:
        stored = store.spark.read.parquet(_folder(store, name))
        return stored.select(*[c for c in stored.columns if c != "part"], F.col("part").cast("int").alias("part"))
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return store.spark.createDataFrame([], schema).withColumn("part", F.lit(0))


def _numbers(df: DataFrame) -> list[int]:
    """Partition numbers in df, at most as many as a table has."""
    return sorted(r["part"] for r in df.select("part").distinct().collect())


def _within(df: DataFrame, parts: list[int]) -> DataFrame:
    """The rows of these partitions: other folders aren't listed nor read."""
    return df.filter(F.col("part").isin(parts)) if parts else df.limit(0)


def _put(store: GraphStore, name: str, parts: list[int], rows: DataFrame) -> list[int]:
    """Make rows all that these partitions hold. Returns the partitions."""
    if not parts:
        return []
    folder = _folder(store, name)
    out = materialize(rows.drop("part").select("*", _part(store, name)), f"store-{name}")
    left = _numbers(out)
    if stray := set(left) - set(parts):
        raise ValueError(f"rows of partitions {sorted(stray)} of {name} are out of place")
    if left:
        _dealt(out, _KEYS[name]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    context = store.spark.sparkContext
    for p in set(parts) - set(left):
        at = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/part={p}")
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return parts


def _put_edges(store: GraphStore, gone: DataFrame, new: DataFrame) -> dict[str, list[int]]:
    """Take edges (from_id, to_id, kind) out of both tables of edges and put new ones in."""
    gone, new = materialize(gone.select(_EDGE).distinct(), "edges-gone"), materialize(new, "edges-new")
    touched = {}
    for name in ("edges", "edges_in"):
        parts = _numbers(gone.select(_part(store, name)).union(new.select(_part(store, name))))
        own = _within(table(store, name), parts)
        kept = own.join(gone, _EDGE, "left_anti").join(new.select(_EDGE), _EDGE, "left_anti").select(own.columns).drop("part")
        touched[name] = _put(store, name, parts, kept.unionByName(new))
    return touched


def replace_files(store: GraphStore, paths: DataFrame, new_nodes: DataFrame, new_refs: DataFrame, new_contains: DataFrame, order: str = "ord") -> dict[str, list[int]]:
    """As graph_tables.replace_files, on the store; returns the rewritten partitions of each table.

    A new node whose id another file has already is left out, so the ids of all nodes are looked at, and of the
    other columns the touched partitions alone."""
    # What is given may be made from the store itself, so it is written before anything is put in place.
    paths = materialize(paths.select("path").distinct(), "store-paths")
    new_nodes, new_refs, new_contains = (materialize(x, "store-given") for x in (new_nodes, new_refs, new_contains))
    nodes, refs, edges = (table(store, n) for n in ("nodes", "refs", "edges"))
    parts = _numbers(paths.select(_part(store, "nodes")).union(new_nodes.select(_part(store, "nodes"))))
    elsewhere = nodes.filter(~F.col("part").isin(parts)).select("id").join(new_nodes.select("id").distinct(), "id", "left_semi")
    by_from = _numbers(paths.select(F.col("path").alias("from_id")).select(_part(store, "refs")).union(new_refs.select(_part(store, "refs"))))
    own = _within(edges.filter("kind = 'contains'"), by_from)
    n, r, _ = graph_tables.replace_files(_within(nodes, parts).drop("part"), _within(refs, by_from).drop("part"), own.drop("part"), paths, new_nodes.join(elsewhere, "id", "left_anti"), new_refs, new_contains, order)
    gone = own.withColumn("path", path_of_id(F.col("from_id"))).join(paths, "path", "left_semi")
    last = new_contains.groupBy(_EDGE).agg(F.max_by("confidence", order).alias("confidence"))
    return {"nodes": _put(store, "nodes", parts, n), "refs": _put(store, "refs", by_from, r)} | _put_edges(store, gone, last)


def delete_files(store: GraphStore, paths: DataFrame) -> dict[str, list[int]]:
    """As graph_tables.delete_files, on the store; returns the rewritten partitions of each table."""
    paths = materialize(paths.select("path").distinct(), "store-paths")
    parts = _numbers(paths.select(_part(store, "nodes")))
    gone = materialize(_within(table(store, "nodes"), parts).join(paths, "path", "left_semi").select("id"), "store-gone")
    out = _within(table(store, "edges"), _numbers(gone.select(F.col("id").alias("from_id")).select(_part(store, "edges")))).join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    into = _within(table(store, "edges_in"), _numbers(gone.select(F.col("id").alias("to_id")).select(_part(store, "edges_in")))).join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    touched = _put_edges(store, out.select(_EDGE).union(into.select(_EDGE)), table(store, "edges").drop("part").limit(0))
    by_from = _numbers(gone.select(F.col("id").alias("from_id")).select(_part(store, "refs")))
    refs = _within(table(store, "refs"), by_from).join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    touched["refs"] = _put(store, "refs", by_from, refs)
    for name in ("nodes", "files"):
        n = _numbers(paths.select(_part(store, name)))
        touched[name] = _put(store, name, n, _within(table(store, name), n).join(paths, "path", "left_anti"))
    return touched


def upsert_files(store: GraphStore, rows: DataFrame) -> list[int]:
    rows = materialize(rows, "store-given")
    parts = _numbers(rows.select(_part(store, "files")))
    return _put(store, "files", parts, graph_tables.upsert_files(_within(table(store, "files"), parts).drop("part"), rows))


def put_changed(store: GraphStore, nodes: DataFrame, edges: DataFrame) -> dict[str, list[int]]:
    """Make these all nodes and edges, as after replace_resolved or replace_knowledge; a partition whose rows are the
    same as before, by number and digest, is left as it is. Returns the rewritten partitions."""
    touched = {}
    nodes, edges = materialize(nodes, "store-given"), materialize(edges, "store-given")
    for name, df in (("nodes", nodes), ("edges", edges), ("edges_in", edges)):
        old = table(store, name)
        new = materialize(df.select(*[c for c in old.columns if c != "part"], _part(store, name)), f"store-new-{name}")
        row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in old.columns if c != "part"])
        digest = [F.count("*").alias("n"), F.bit_xor(row).alias("x")]
        a, b = old.groupBy("part").agg(*digest), new.groupBy("part").agg(*digest)
        parts = _numbers(a.join(b, ["part", "n", "x"], "left_anti").select("part").union(b.join(a, ["part", "n", "x"], "left_anti").select("part")))
        touched[name] = _put(store, name, parts, _within(new, parts))
    return touched


def callers_of(store: GraphStore, targets: DataFrame) -> DataFrame:
    """(target, id): distinct nodes that call each target (id), from the partitions that the targets' edges are in."""
    t = targets.select(F.col("id").alias("to_id")).distinct()
    e = _within(table(store, "edges_in").filter("kind = 'calls'"), _numbers(t.select(_part(store, "edges_in"))))
    return e.join(t, "to_id").select(F.col("to_id").alias("target"), F.col("from_id").alias("id")).distinct()


def save_lookup(edges: DataFrame, direction: str = "up", buckets: int = 64) -> DataFrame:
    """The edges in buckets sorted by the end that a walk comes from (to_id upwards, from_id downwards), as a table.

    A filter on that end reads one bucket; a join on it, as in a step of impact, sends the walk's nodes to the
    buckets and leaves the edges where they are.
    """
    spark, near = edges.sparkSession, "to_id" if direction == "up" else "from_id"
    name = f"lookup_{direction}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{name}"
    edges.repartition(buckets, near).write.bucketBy(buckets, near).sortBy(near).option("path", path).saveAsTable(name)
    return spark.table(name)
