"""Streams over the event table: each query runs its stream in two parts, with a restart or a replay in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adaptors import LOG_SQL, log, table
from ..model import LOG
from ..sources import line_source
from ..sources import logs as log_files
from ..storage import materialize, shared_dir
from ..streaming import logs as streams
from ..streaming import state


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def in_two_runs(parts: list[DataFrame], stream) -> DataFrame:
    """The rows of stream(rows) over files of each part in turn: a query reads what there is and ends, and the next
    one goes on from its checkpoint. Batches are written by number, so one that runs twice counts once."""
    spark = parts[0].sparkSession
    source, out, checkpoint = (_folder(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    for part in parts:
        part.write.mode("append").parquet(source)
        rows = stream(spark.readStream.schema(part.schema).parquet(source))
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(rows.columns)


def _session_rows(s, d):
    e = table(s, d, "events")
    action = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'note' END")
    acts = e.select(F.expr("'p' || CAST(user_id % 50 AS STRING)").alias("project"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), action.alias("action"), F.expr("CASE WHEN event_type NOT IN ('signup', 'purchase') THEN 'e' || CAST(event_id AS STRING) END").alias("text"))
    half = F.expr("timestamp '2024-01-16 00:00:00'")
    out = in_two_runs([acts.filter(F.col("at") < half), acts.filter(F.col("at") >= half)], state.session_stream)
    return state.sessions_so_far(out).select("project", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "summary")


_SESSIONS = """WITH acts AS (SELECT 'p' || CAST(user_id % 50 AS STRING) AS project, ts AS t, event_id AS ord, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'note' END AS action FROM events),
bounds AS (SELECT *, lead(t) OVER w AS ended_at, lead(ord) OVER w AS end_ord FROM acts WHERE action <> 'note' WINDOW w AS (PARTITION BY project ORDER BY t, ord)),
spans AS (SELECT project, t AS started_at, ord AS s, ended_at, end_ord FROM bounds WHERE action = 'start'),
inside AS (SELECT p.project, p.s, n.t, n.ord, row_number() OVER (PARTITION BY p.project, p.s ORDER BY n.t DESC, CAST(n.ord AS STRING) DESC) AS k FROM spans p JOIN acts n ON n.action = 'note' AND n.project = p.project AND (n.t, n.ord) > (p.started_at, p.s) AND (n.t, n.ord) < (p.ended_at, p.end_ord)),
said AS (SELECT project, s, CAST(count(*) AS STRING) || ' observation(s): ' || string_agg('e' || CAST(ord AS STRING), '; ' ORDER BY k) AS text FROM inside WHERE k <= 10 GROUP BY 1, 2)
SELECT p.project, p.started_at, p.ended_at, CASE WHEN p.ended_at IS NULL THEN '' ELSE coalesce(text, '(no observations recorded)') END AS summary FROM spans p LEFT JOIN said q ON q.project = p.project AND q.s = p.s"""


def _alert_rows(s, d):
    e = table(s, d, "events").select(F.expr("'p' || CAST(user_id % 20 AS STRING)").alias("project"), F.dayofmonth("ts").cast("long").alias("run"), F.col("event_type").alias("rule_id"), (F.col("user_id") % 20).alias("u"))
    found = e.groupBy("project", "run", "rule_id", "u").agg(F.count("*").alias("evidence"))
    said = found.select("project", "run", "rule_id", "evidence", F.concat(F.col("evidence").cast("string"), F.lit(" time(s)")).alias("message"), F.lit(False).alias("dismiss"))
    dismissed = found.filter("run = 10 and rule_id = 'click' and u % 3 = 0").select("project", "run", "rule_id", F.lit(0).cast("long").alias("evidence"), F.lit("").alias("message"), F.lit(True).alias("dismiss"))
    rows = said.unionByName(dismissed)
    out = in_two_runs([rows.filter("run <= 12"), rows.filter("run > 12")], lambda r: state.alert_stream(r, 99))
    return out.select("project", "run", "rule_id", "evidence", "message")


_ALERTS = """WITH f AS (SELECT 'p' || CAST(user_id % 20 AS STRING) AS project, CAST(day(ts) AS BIGINT) AS run, event_type AS rule_id, user_id % 20 AS u, count(*) AS evidence FROM events GROUP BY ALL),
g AS (SELECT *, coalesce(max(evidence) OVER (PARTITION BY project, rule_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shown FROM f),
gone AS (SELECT project, rule_id FROM f WHERE run = 10 AND rule_id = 'click' AND u % 3 = 0)
SELECT project, run, rule_id, evidence, CAST(evidence AS STRING) || ' time(s)' AS message FROM g WHERE evidence > shown AND NOT (run >= 10 AND (project, rule_id) IN (SELECT project, rule_id FROM gone))"""


def _timed_log(s, d) -> DataFrame:
    ts = table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("timestamp"))
    own = log(s, d).select("ord", *[c for c in LOG.names if c in ("event", "provider", "cost_usd", "duration_ms")])
    return own.join(ts, "ord").drop("ord")


def _windows(s, d):
    folder, name = _folder(s, "windows"), f"windows_{uuid.uuid4().hex}"
    _timed_log(s, d).repartition(4).write.json(folder)
    found = streams.windowed_usage(streams.log_stream(s, folder, 2), late="60 days")
    found.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", _folder(s, "stream-state")).start().awaitTermination()
    return s.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "provider", "calls", F.round("cost_usd", 4).alias("cost_usd"))


_TIMED = "log AS (SELECT ts, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'mcp_call' ELSE '' END WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'hook' ELSE 'prompt' END WHEN 'purchase' THEN 'graph_refresh' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'gate_attempt' ELSE 'tdd_stage' END ELSE 'violation' END AS event, 'p' || CAST(user_id % 4 AS STRING) AS provider, CAST(floor(coalesce(value, 0)) AS DOUBLE) / 1024 AS cost_usd FROM events)"
_WINDOWS = f"WITH {_TIMED} SELECT date_trunc('hour', ts) AS hour, provider, count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM log WHERE event = '' GROUP BY 1, 2"


def _appended(s, d):
    """The log through a stream into a log folder, all batches a second time from a lost checkpoint, and read back."""
    source, out = _folder(s, "append-in"), _folder(s, "append-out")
    _timed_log(s, d).repartition(3).write.json(source)
    for _ in range(2):
        streams.append_log(streams.log_stream(s, source, 1), out, _folder(s, "append-state"), once=True).awaitTermination()
    return log_files.read_log(s, f"{out}/batch=*").groupBy("event", "provider").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


_APPENDED = f"WITH {_TIMED} SELECT event, provider, count(*) AS n, round(sum(cost_usd), 4) AS cost_usd FROM log GROUP BY 1, 2"


def _refreshed(s, d):
    """Changed files as a stream whose refresh appends to a table; the stream runs again from a lost checkpoint, and
    the ledger lets no batch through twice."""
    source, out, ledger = _folder(s, "refresh-in"), _folder(s, "refresh-out"), _folder(s, "ledger")
    orders = table(s, d, "orders").select(F.concat(F.lit("o/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("n"))
    orders.repartition(3, "path").write.parquet(source)
    for _ in range(2):
        changed = s.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(source)
        streams.refresh_stream(changed, lambda rows: rows.select("path").write.mode("append").parquet(out), _folder(s, "refresh-state"), ledger, once=True).awaitTermination()
    return s.read.parquet(out).groupBy("path").agg(F.count("*").alias("times"))


def _followed(s, d):
    """The log in four files that are written to their half, read by a stream, written on, and read on from there."""
    import pyarrow as pa
    from pyarrow import fs

    folder, out, checkpoint = _folder(s, "grown"), _folder(s, "grown-out"), _folder(s, "stream-state")
    rows = _timed_log(s, d).select(F.to_json(F.struct("event", "provider", "duration_ms")).alias("value"), (F.monotonically_increasing_id() % 4).alias("file"), F.when(F.rand(5) < 0.5, 0).otherwise(1).alias("half"))
    rows = rows.repartition(4, "file").sortWithinPartitions("file", "half")

    def write(half: int):
        def run(batches):
            system, root = fs.FileSystem.from_uri(folder)
            system.create_dir(root, recursive=True)
            texts: dict[int, list[str]] = {}
            for b in batches:
                for f, t, h in zip(*(b.column(c).to_pylist() for c in ("file", "value", "half"))):
                    if h <= half:
                        texts.setdefault(f, []).append(t)
            for f, lines in texts.items():
                with system.open_output_stream(f"{root}/log-{f}.jsonl", compression=None) as o:
                    o.write(("\n".join(lines) + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)])], ["n"])

        return run

    rows = materialize(rows, "grown-rows").repartition(4, "file").sortWithinPartitions("file", "half", "value")
    for half in (0, 1):
        rows.mapInArrow(write(half), "n long").collect()
        lines = line_source.read_lines(s, folder, stream=True, suffix=".jsonl")
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        line_source.log_entries(lines).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).groupBy("event", "provider").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"))


_FOLLOWED = f"WITH {LOG_SQL} SELECT event, provider, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM log GROUP BY 1, 2"

QUERIES = {
    "log_followed": (_followed, _FOLLOWED),
    "session_stream": (_session_rows, _SESSIONS),
    "alert_stream": (_alert_rows, _ALERTS),
    "usage_windows": (_windows, _WINDOWS),
    "log_appended": (_appended, _APPENDED),
    "refresh_ledger": (_refreshed, "SELECT 'o/' || CAST(o_custkey AS STRING) AS path, CAST(1 AS BIGINT) AS times FROM orders GROUP BY 1"),
}
