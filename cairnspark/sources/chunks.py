"""Shared note chunks: one JSON document of observations a file, and of an author one file or, if large, several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CHUNK_RECORD, zero_values

_SCHEMA = f"observations array<{CHUNK_RECORD.simpleString()}>"


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all chunk-*.jsonl.gz of a folder, sorted by sync id."""
    return read_chunk(spark, f"{folder}/chunk-*.jsonl.gz").orderBy("sync_id")


def read_chunk(spark: SparkSession, *paths: str) -> DataFrame:
    docs = spark.read.schema(_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(list(paths))
    return zero_values(docs.select(F.inline("observations")))


def parse_chunks(texts: DataFrame, column: str = "text") -> DataFrame:
    """Records of chunk documents held as text."""
    return zero_values(texts.select(F.inline(F.from_json(column, _SCHEMA)["observations"])))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Notes of the older store: a JSON array of objects, or a folder of such files. A task holds the array of a file."""
    kind = "id string, topic string, content string, source string, created_at string"
    return zero_values(spark.read.schema(kind).option("multiLine", True).json(path))
