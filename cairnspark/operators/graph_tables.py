"""Mutations of the graph tables, as plans that return the new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_of_id
from .logs import last_by_key


def upsert_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    return files.join(rows.select("path"), "path", "left_anti").select(files.columns).unionByName(rows.select(files.columns))


def replace_files(nodes: DataFrame, refs: DataFrame, edges: DataFrame, paths: DataFrame, new_nodes: DataFrame, new_refs: DataFrame, new_contains: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables with all nodes, refs and contains edges of the paths replaced. Of repeated node ids the first by
    `order` counts, of repeated edges the last; new rows have that column."""
    p = paths.select("path").distinct()
    own = lambda df, c: df.withColumn("path", path_of_id(F.col(c))).join(p, "path", "left_anti").select(df.columns)
    kept_nodes = nodes.join(p, "path", "left_anti").select(nodes.columns)
    taken = new_nodes.withColumn("_o", F.col(order))
    first = last_by_key(taken, ["id"], ["_o"]).join(kept_nodes.select("id"), "id", "left_anti")
    contains, rest = edges.filter("kind = 'contains'"), edges.filter("kind <> 'contains'")
    last = new_contains.groupBy("from_id", "to_id", "kind").agg(F.max_by("confidence", order).alias("confidence"))
    return (
        kept_nodes.unionByName(first.select(nodes.columns)),
        own(refs, "from_id").unionByName(new_refs.select(refs.columns)),
        rest.unionByName(own(contains, "from_id")).unionByName(last.select(edges.columns)),
    )


def delete_files(files: DataFrame, nodes: DataFrame, refs: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables without the files, their nodes and refs, and the edges at either end of these nodes."""
    p = paths.select("path").distinct()
    gone = nodes.join(p, "path", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(edges.columns)
    return files.join(p, "path", "left_anti").select(files.columns), nodes.join(p, "path", "left_anti").select(nodes.columns), refs.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(refs.columns), left


def replace_resolved(nodes: DataFrame, edges: DataFrame, new_edges: DataFrame, externals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with all resolved edges and external nodes replaced; contains and documents edges stay."""
    kept = edges.filter("kind in ('contains', 'documents')")
    return nodes.filter("kind <> 'external'").unionByName(externals, allowMissingColumns=True).dropDuplicates(["id"]), kept.unionByName(new_edges.select(edges.columns)).dropDuplicates(["from_id", "to_id", "kind"])


def replace_knowledge(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with skill and convention nodes and documents edges replaced."""
    return nodes.filter("kind not in ('skill', 'convention')").unionByName(new_nodes, allowMissingColumns=True), edges.filter("kind <> 'documents'").unionByName(new_documents.select(edges.columns)).dropDuplicates(["from_id", "to_id", "kind"])


def upsert_concepts(concepts: DataFrame, rows: DataFrame) -> DataFrame:
    """Concepts with those of the same name replaced; their file links are another table and stay."""
    return concepts.join(rows.select("name"), "name", "left_anti").select(concepts.columns).unionByName(rows.select(concepts.columns))


def replace_concepts(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and their file links after both are replaced as a whole: a name once (the last description by order
    of text), and no link of a concept that there is not."""
    one = rows.groupBy("name").agg(*(F.max(c).alias(c) for c in rows.columns if c != "name")).select(rows.columns) if len(rows.columns) > 1 else rows.distinct()
    return one, links.select("concept", "path").distinct().join(one.select(F.col("name").alias("concept")), "concept", "left_semi")


def knowledge(concept_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skill nodes and documents edges of concepts and their files."""
    nodes = concept_files.select("concept").distinct().select(F.concat(F.lit("skill::"), "concept").alias("id"), F.lit("skill").alias("kind"), F.col("concept").alias("name"))
    edges = concept_files.select(F.concat(F.lit("skill::"), "concept").alias("from_id"), F.col("path").alias("to_id"), F.lit("documents").alias("kind"), F.lit("exact").alias("confidence")).distinct()
    return nodes, edges


def changes(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, action): deleted where only known; unchanged where size and time, or else the hash, agree;
    else parse. known and scanned: (path, size, mtime_ns, sha256)."""
    k = known.select("path", *(F.col(c).alias(f"k_{c}") for c in ("size", "mtime_ns", "sha256")))
    j = k.join(scanned.select("path", "size", "mtime_ns", "sha256"), "path", "full_outer")
    same = ((F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime_ns"))) | (F.col("sha256") == F.col("k_sha256"))
    return j.select("path", F.when(F.col("size").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("parse").alias("action"))


def status(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, failed files, nodes, edges."""
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failed"))
    return f.join(nodes.agg(F.count("*").alias("nodes"))).join(edges.agg(F.count("*").alias("edges")))


def concept_freshness(concept_files: DataFrame, concepts: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status): new without files, stale if the hash of a file is not the recorded one, else up-to-date.
    recorded and current: (path, sha256); a missing one counts as ''."""
    j = concept_files.join(recorded.select("path", F.col("sha256").alias("r")), "path", "left").join(current.select("path", F.col("sha256").alias("c")), "path", "left")
    stale = j.groupBy("concept").agg(F.bool_or(F.coalesce("r", F.lit("")) != F.coalesce("c", F.lit(""))).alias("stale"))
    return concepts.select("name").join(stale, F.col("name") == F.col("concept"), "left").select("name", F.when(F.col("stale").isNull(), "new").when(F.col("stale"), "stale").otherwise("up-to-date").alias("status"))


def uncovered_files(files: DataFrame, concepts: DataFrame, concept_files: DataFrame) -> DataFrame:
    """Files of no concept but the architecture; none while there are no concepts."""
    covered = concept_files.filter("concept <> 'architecture'").select("path")
    return files.join(covered, "path", "left_anti").join(concepts.select(F.lit(1).alias("one")).limit(1)).drop("one")
