"""Schemas and enumerations of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(ddl: str) -> T.StructType:
    """Of `name type, ...`; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


NODES = _schema("id string, kind string, name string, path string, line int, end_line int, language string, params string, return_type string, exported boolean")
EDGES = _schema("from_id string, to_id string, kind string, confidence string")
REFS = _schema("from_id string, kind string, name string, line int, recv string")
FILES = _schema("path string, sha256 string, language string, status string, package string, imports array<string>, size bigint, mtime_ns bigint")
CONCEPTS = _schema("name string, description string, content string")
CONCEPT_FILES = _schema("concept string, path string")
NOTES = _schema(
    "id string, topic_key string, scope string, project string, title string, content string, type string, source string, revision int, created_at timestamp, updated_at timestamp, author string, sync_id string, imported boolean, deleted_at timestamp"
)
RELATIONS = _schema("id string, from_id string, to_id string, relation_type string, created_at timestamp")
SESSIONS = _schema("id string, project string, started_at timestamp, ended_at timestamp, summary string")
CHUNK_RECORD = _schema(
    "sync_id string, topic_key string, scope string, project string, title string, content string, type string, source string, author string, revision int, created_at string, updated_at string"
)
LOG = _schema(
    "timestamp timestamp, provider string, model string, sub_agent string, event string, skill string, tool string, error string, stage string, outcome string, session_id string, feature string, input_tokens int, output_tokens int, latency_ms bigint, "
    "cost_usd double, tool_calls_count int, found boolean, duration_ms bigint, ok boolean, result_bytes int, zero_result boolean, parsed int, unchanged int, deleted int, failed int"
)

# The enumerations of the data model.
NODE_KINDS = ("file", "class", "function", "test", "external", "skill", "convention", "graphql_operation", "graphql_fragment", "graphql_type")
EDGE_KINDS = ("contains", "imports", "extends", "implements", "calls", "tested_by", "overrides", "documents", "spreads", "on_type")
CONFIDENCES = ("exact", "high", "medium", "low")
NOTE_TYPES = ("architecture", "bug-pattern", "decision", "gotcha", "reference", "skill", "testing")
RELATION_TYPES = ("supersedes", "conflicts_with", "related", "documents", "documents_auto")
#: Edges of these kinds are structure, not dependencies.
STRUCTURAL = ("contains", "documents")


def zero_values(df: DataFrame) -> DataFrame:
    """Nulls replaced by the zero value of their type: a field that a record leaves out counts as that."""
    zero: dict[str, Column] = {}
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, T.StringType):
            zero[f.name] = F.coalesce(f.name, F.lit(""))
        elif isinstance(kind, T.BooleanType):
            zero[f.name] = F.coalesce(f.name, F.lit(False))
        elif isinstance(kind, T.NumericType):
            zero[f.name] = F.coalesce(f.name, F.lit(0).cast(kind))
    return df.withColumns(zero)


def invalid(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not of an enumeration; null and '' count as absent."""
    return df.filter((F.coalesce(column, F.lit("")) != "") & ~F.col(column).isin(*allowed))
