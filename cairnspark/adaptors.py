"""The driver's tables as the engine's inputs. A table's columns are given as expressions that Spark SQL and
other SQL engines read alike, so that the queries and the SQL that checks them start from the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .storage import shared_dir, stamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: events as log entries: two kinds of rows for most event types, by parity of the id.
LOG = {
    "ord": "event_id",
    "event": "CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'mcp_call' ELSE '' END WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'hook' ELSE 'prompt' END WHEN 'purchase' THEN 'graph_refresh' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'gate_attempt' ELSE 'tdd_stage' END ELSE 'violation' END",
    "provider": "'p' || CAST(user_id % 4 AS STRING)",
    "model": "'m' || CAST(user_id % 3 AS STRING)",
    "tool": "CASE WHEN user_id % 7 = 0 THEN 'mem_search' ELSE 't' || CAST(user_id % 7 AS STRING) END",
    "stage": "CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'red' ELSE 'green' END WHEN event_id % 3 = 0 THEN 'mark' WHEN event_id % 3 = 1 THEN 'review' ELSE 'begin' END",
    "outcome": "CASE WHEN event_id % 5 = 0 THEN 'secret-guard' WHEN event_id % 5 = 1 THEN 'edit-without-context' ELSE 'o' || CAST(event_id % 5 AS STRING) END",
    "session_id": "CASE WHEN user_id % 5 = 0 THEN '' ELSE 's' || CAST(user_id AS STRING) END",
    "feature": "CASE WHEN user_id % 20 = 0 THEN '' ELSE 'f' || CAST(user_id % 20 AS STRING) END",
    "input_tokens": "CAST(floor(coalesce(value, 0) * 10) AS INT)",
    "output_tokens": "CAST(floor(coalesce(value, 0)) AS INT)",
    "latency_ms": "CAST(floor(coalesce(value, 0) * 3) AS BIGINT)",
    "cost_usd": "CAST(floor(coalesce(value, 0)) AS DOUBLE) / 1024",
    "duration_ms": "CAST(floor(coalesce(value, 0) * 7) AS BIGINT)",
    "ok": "event_id % 3 <> 0",
    "result_bytes": "CAST(floor(coalesce(value, 0) * 100) AS INT)",
    "zero_result": "event_id % 4 = 0",
    "parsed": "CAST(event_id % 100 AS INT)",
    "deleted": "CAST(event_id % 10 AS INT)",
    "failed": "CAST(event_id % 3 AS INT)",
}
#: documents as notes.
NOTES = {
    "id": "'doc-' || CAST(doc_id AS STRING)",
    "topic_key": "CASE doc_id % 8 WHEN 0 THEN 'architecture' WHEN 1 THEN 'bug-pattern' WHEN 2 THEN 'decision' WHEN 3 THEN 'gotcha' WHEN 4 THEN 'reference' WHEN 5 THEN 'skill' WHEN 6 THEN 'testing' ELSE 'misc' END || '/' || source || '-' || CAST(doc_id AS STRING)",
    "scope": "CASE WHEN doc_id % 7 = 0 THEN 'personal' ELSE 'project' END",
    "project": "''",
    "title": "substr(text, 1, 40)",
    "content": "text",
    "type": "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 8 = 5 THEN 'skill' ELSE 'decision' END",
    "source": "source",
    "revision": "CAST(1 + doc_id % 4 AS INT)",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id",
    "updated_at": "TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id * 37 % 1009)",
    "author": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a' || CAST(doc_id % 3 AS STRING) END",
    "sync_id": "'obs-' || CAST(doc_id AS STRING)",
    "imported": "doc_id % 2 = 0",
    "deleted_at": "CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END",
}

_NATION_PATH = "'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING)"
#: Graph nodes: (table expression, id, kind, name, path, line, end_line, language, exported).
NODE_PARTS = [
    ("nation", _NATION_PATH, "'file'", "n_name", _NATION_PATH, "0", "0", "'java'", "false"),
    ("(SELECT DISTINCT p_brand FROM part)", "'m/' || p_brand", "'file'", "p_brand", "'m/' || p_brand", "0", "0", "'go'", "false"),
    ("region", "'skill::' || r_name", "'skill'", "r_name", "''", "0", "0", "''", "false"),
    ("supplier JOIN nation ON s_nationkey = n_nationkey", "'supplier:' || CAST(s_suppkey AS STRING)", "'class'", "s_name", _NATION_PATH, "1", "40", "'java'", "true"),
    ("customer JOIN nation ON c_nationkey = n_nationkey", "'customer:' || CAST(c_custkey AS STRING)", "CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'class' END", "c_name", _NATION_PATH, "1", "20", "'java'", "true"),
    ("part", "'part:' || CAST(p_partkey AS STRING)", "'function'", "p_name", "'m/' || p_brand", "p_size", "CAST(p_size + p_partkey % 23 AS INT)", "'go'", "p_partkey % 2 = 0"),
    ("orders", "'order:' || CAST(o_orderkey AS STRING)", "CASE WHEN o_orderkey % 301 = 0 THEN 'test' ELSE 'function' END", "'order' || CAST(o_orderkey AS STRING)", "'o/' || o_orderpriority", "1", "CAST(1 + o_orderkey % 9 AS INT)", "'python'", "false"),
]
#: Graph edges: (table expression, from, to, kind, confidence).
EDGE_PARTS = [
    ("supplier JOIN nation ON s_nationkey = n_nationkey", _NATION_PATH, "'supplier:' || CAST(s_suppkey AS STRING)", "contains", "exact"),
    ("customer JOIN nation ON c_nationkey = n_nationkey", _NATION_PATH, "'customer:' || CAST(c_custkey AS STRING)", "contains", "exact"),
    ("part", "'m/' || p_brand", "'part:' || CAST(p_partkey AS STRING)", "contains", "exact"),
    ("region JOIN nation ON n_regionkey = r_regionkey", "'skill::' || r_name", _NATION_PATH, "documents", "exact"),
    ("lineitem", "'order:' || CAST(l_orderkey AS STRING)", "'part:' || CAST(l_partkey AS STRING)", "calls", "high"),
    ("lineitem", "'part:' || CAST(l_partkey AS STRING)", "'supplier:' || CAST(l_suppkey AS STRING)", "calls", "medium"),
    ("supplier", "'supplier:' || CAST(s_suppkey AS STRING)", "'supplier:' || CAST(s_suppkey * 7 % (SELECT count(*) FROM supplier) + 1 AS STRING)", "calls", "low"),
    ("customer", "'customer:' || CAST(c_custkey AS STRING)", "'customer:' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)", "extends", "high"),
    ("customer", "'customer:' || CAST(c_custkey AS STRING)", "'supplier:' || CAST(c_custkey % (SELECT count(*) FROM supplier) + 1 AS STRING)", "implements", "high"),
    ("supplier", "'supplier:' || CAST(s_suppkey AS STRING)", "'customer:' || CAST(s_suppkey * 10 AS STRING)", "tested_by", "medium"),
    ("orders", "'order:' || CAST(o_orderkey AS STRING)", "'customer:' || CAST(o_custkey AS STRING)", "overrides", "low"),
]
#: Rows of an edge part that count.
EDGE_FILTERS = {6: "s_suppkey % 4 <> 0", 7: "c_custkey % 3 <> 0 AND c_custkey > 1", 8: "c_custkey % 5 = 0", 9: "s_suppkey % 2 = 0", 10: "o_orderkey % 3 = 0"}


def _columns(parts: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in parts.items())


LOG_SQL = f"log AS (SELECT {_columns(LOG)} FROM events)"
NOTES_SQL = f"notes AS (SELECT {_columns(NOTES)} FROM documents)"
NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT {i} AS id, {k} AS kind, {n} AS name, {p} AS path, {a} AS line, {z} AS end_line, {lang} AS language, {x} AS exported FROM {t}" for t, i, k, n, p, a, z, lang, x in NODE_PARTS) + ")"
EDGES_SQL = "edges AS (" + " UNION ALL ".join(f"SELECT DISTINCT {a} AS from_id, {b} AS to_id, '{k}' AS kind, '{c}' AS confidence FROM {t}" + (f" WHERE {EDGE_FILTERS[i]}" if i in EDGE_FILTERS else "") for i, (t, a, b, k, c) in enumerate(EDGE_PARTS)) + ")"
#: Every nation file's package; brands have none.
FILES_SQL = "files AS (SELECT " + _NATION_PATH + " AS path, 'geo.r' || CAST(n_regionkey AS STRING) AS package, n_nationkey * 1000 AS size FROM nation)"
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}, {FILES_SQL}"


def _views(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...]) -> DataFrame:
    """A query over the driver's tables, which are named in it by path, so that no session-wide view is made."""
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 parquet.`{sf_dir}/{n}.parquet` AS {n}", sql)
    return spark.sql(sql)


_ALL = ("nation", "region", "supplier", "customer", "part", "orders", "lineitem", "events", "documents")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {c}" for c, e in LOG.items()))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {c}" for c, e in NOTES.items()))


#: Graph tables written so far, by the session's application, the driver's folder and the stamps of its tables.
_STORES: dict[tuple, str] = {}
#: The driver's tables that a graph is made of.
_GRAPH = ("nation", "region", "supplier", "customer", "part", "orders", "lineitem")


def _stored(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """A graph table from the store: built from the driver's tables on first use in a session and whenever these
    have changed, else read."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in _GRAPH))
    if key in _STORES:
        try:
            return spark.read.parquet(_STORES[key])
        except AnalysisException:  # somebody has emptied the folder: built anew
            pass
    path = f"{shared_dir(spark)}/graph-{name}-{uuid.uuid4().hex}"
    _views(spark, sf_dir, sql, _ALL).write.parquet(path)
    _STORES[key] = path
    return spark.read.parquet(path)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "nodes", f"WITH {NODES_SQL} SELECT *, '' AS params, '' AS return_type FROM nodes")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "edges", f"WITH {EDGES_SQL} SELECT * FROM edges")


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "files", f"WITH {FILES_SQL} SELECT * FROM files")


def one_target(spark: SparkSession, node_id: str) -> DataFrame:
    return spark.range(1).select(F.lit(node_id).alias("id"))
