"""Scans of the graph and note stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import STRUCTURAL


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("from_id", "to_id", "kind")


def ordered_refs(refs: DataFrame) -> DataFrame:
    return refs.orderBy("from_id", "line", "kind", "name", "recv")


def dependency_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("kind").isin(*STRUCTURAL))


def decoded_files(files: DataFrame) -> DataFrame:
    """files with imports, stored as JSON text, as an array."""
    return files.withColumn("imports", F.coalesce(F.from_json("imports", "array<string>"), F.array().cast("array<string>")))


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    """One row (value): '' where the key is missing."""
    return metadata.filter(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def concepts_with_files(concepts: DataFrame, concept_files: DataFrame) -> DataFrame:
    """Concepts with their paths, sorted; a concept without files has none."""
    paths = concept_files.groupBy("concept").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return concepts.join(paths, concepts["name"] == paths["concept"], "left").drop("concept").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
