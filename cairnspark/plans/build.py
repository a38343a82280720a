"""The incremental build of the graph store: parse what has changed, replace its rows, resolve all references again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, FILES, NODES, REFS
from ..operators import graph_tables as gt
from ..sources import code
from ..storage import materialize
from .resolve import resolve


@dataclass
class Store:
    """The tables of the graph store."""

    files: DataFrame
    nodes: DataFrame
    refs: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(*(spark.createDataFrame([], s) for s in (FILES, NODES, REFS, EDGES)))


def under_scope(path: Column, scope: str) -> Column:
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def build(store: Store, sources: DataFrame, scope: str = "", module: str = "") -> tuple[Store, dict[str, int]]:
    """The store after a build over sources (path, size, mtime_ns, content), and how many files were parsed,
    unchanged, deleted and failed.

    Equal size and time, or else an equal hash, leave a file unchanged; a touched one only gets its new time. A file
    that can't be read is marked failed and keeps its rows. A scope restricts the build to a subtree: files outside it
    are neither read nor deleted. A whole build over a store that knows read files but holds no nodes reads all files
    anew. References are resolved only if something was parsed or deleted.
    """
    known = store.files
    scanned = sources.filter(under_scope(F.col("path"), scope)).withColumn("sha256", F.sha2("content", 256))
    actions = gt.changes(known.filter(under_scope(F.col("path"), scope)), scanned)
    if not scope and store.nodes.isEmpty() and not known.filter("status <> 'failed'").isEmpty():
        actions = actions.withColumn("action", F.when(F.col("action") == "unchanged", "parse").otherwise(F.col("action")))
    actions = materialize(actions, "build-actions")
    facts = code.parse_files(scanned.join(actions.filter("action = 'parse'"), "path", "left_semi"))
    facts = materialize(facts, "build-facts")
    bad = facts.filter("status = 'failed'")
    good = facts.filter("status <> 'failed'")
    count = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    failed = bad.count()
    done = {"parsed": count.get("parse", 0) - failed, "unchanged": count.get("unchanged", 0), "deleted": count.get("deleted", 0), "failed": failed}

    files, nodes, refs, edges = gt.delete_files(known, store.nodes, store.refs, store.edges, actions.filter("action = 'deleted'").select("path"))
    new_nodes, contains, new_refs, meta = code.tables(good)
    first = F.lit(0)
    nodes, refs, edges = gt.replace_files(nodes, refs, edges, good.select("path"), new_nodes.withColumn("ord", first), new_refs.withColumn("ord", first), contains.withColumn("ord", first))
    stat = scanned.select("path", "sha256", "size", "mtime_ns")
    fresh = meta.unionByName(bad.select("path", "language", "status", "package", "imports")).join(stat, "path").select([f.name for f in FILES])
    touched = files.drop("size", "mtime_ns").join(actions.filter("action = 'unchanged'"), "path", "left_semi").join(stat.drop("sha256"), "path").select([f.name for f in FILES])
    files = gt.upsert_files(files, fresh.unionByName(touched))
    after = Store(materialize(files, "build-files"), materialize(nodes, "build-nodes"), materialize(refs, "build-refs"), materialize(edges, "build-edges"))
    if not done["parsed"] and not done["deleted"]:
        return after, done
    resolved, outside = resolve(after.nodes, after.files, after.refs, module)
    nodes, edges = gt.replace_resolved(after.nodes, after.edges, resolved, outside)
    return Store(after.files, materialize(nodes.select(after.nodes.columns), "build-nodes"), after.refs, materialize(edges, "build-edges")), done
