"""Queries over events as log entries, and over line items as model usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adaptors import LOG_SQL, log, table
from ..functions.cost import estimate_cost
from ..operators import logs, rules
from ..sources.logs import last_rows

L = f"WITH {LOG_SQL} "
_ROUND = 6


def _r(df, *cols):
    return df.withColumns({c: F.round(c, _ROUND) for c in cols})


def _usage_rows(spark, sf):
    """Line items as model calls."""
    return table(spark, sf, "lineitem").select(
        F.lit("").alias("event"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("provider"), F.col("l_quantity").cast("int").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"), F.floor("l_extendedprice").cast("double").alias("cost_usd"), F.col("l_suppkey").alias("latency_ms")
    )


def _unused(spark, sf):
    tools = spark.range(10).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tool"))
    return logs.unused_tools(log(spark, sf), tools)


def _compare(spark, sf):
    rows = log(spark, sf)
    return _r(logs.compare(rows.filter("ord % 4 < 2"), rows.filter("ord % 4 >= 2")), "token_delta_pct", "cost_delta_pct", "baseline_cost", "candidate_cost")


def _cost(spark, sf):
    rates = spark.createDataFrame([("p1", "m0", 0.8, 4.0), ("p2", "m1", 3.0, 15.0), ("p3", "m2", 15.0, 75.0)], "provider string, model string, input_usd double, output_usd double")
    priced = estimate_cost(log(spark, sf).filter("event = ''"), rates)
    return _r(priced.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("estimated_usd").alias("usd")), "usd")


def _medians(spark, sf):
    rows = log(spark, sf).filter("event = ''").select(F.concat(F.lit("c"), (F.col("ord") % 3).cast("string")).alias("condition"), "input_tokens", "latency_ms")
    return logs.medians(rows, ["input_tokens", "latency_ms"])


def _deltas(spark, sf):
    rows = log(spark, sf).filter("event = ''").select(F.concat(F.lit("c"), (F.col("ord") % 3).cast("string")).alias("condition"), F.col("input_tokens").cast("double").alias("input_tokens"), F.col("latency_ms").cast("double").alias("latency_ms"))
    return logs.median_deltas(rows, ["input_tokens", "latency_ms"], "c0", "c1").select("metric", "base", "other")


def _rules(spark, sf):
    return rules.evaluate(rules.evidence(log(spark, sf), needs=2, uncovered=12, pending=1)).select("rule_id", "evidence")


def _shown(spark, sf):
    state = spark.createDataFrame([("secret-guard", 1, True), ("learn-stale", 12, False), ("gate-friction", 1, False)], "rule_id string, last_shown bigint, dismissed boolean")
    return rules.to_show(rules.evaluate(rules.evidence(log(spark, sf), 2, 12, 1)), state, 2)[0].select("rule_id", "evidence")


_EVIDENCE = """
v AS (SELECT count(*) FILTER (outcome = 'edit-without-context') AS edits, count(*) FILTER (outcome = 'secret-guard') AS secrets FROM log WHERE event = 'violation'),
g AS (SELECT outcome, count(*) AS n FROM log WHERE event = 'gate_attempt' AND NOT ok GROUP BY outcome),
d AS (SELECT n AS failures FROM g ORDER BY n DESC, outcome LIMIT 1),
s AS (SELECT count(*) AS searches, count(*) FILTER (zero_result) AS zero FROM log WHERE event = 'mcp_call' AND tool = 'mem_search'),
r AS (SELECT 'crystallize-ready' AS rule_id, 2 AS evidence UNION ALL SELECT 'learn-stale', 12 UNION ALL SELECT 'skill-pending', 1
  UNION ALL SELECT 'edit-without-context', edits FROM v WHERE edits >= 3 UNION ALL SELECT 'secret-guard', secrets FROM v WHERE secrets >= 3
  UNION ALL SELECT 'gate-friction', failures FROM d WHERE failures >= 3 UNION ALL SELECT 'mem-search-zero', zero FROM s WHERE searches >= 5 AND zero / searches >= 0.5)"""

QUERIES = {
    "usage_by_provider": (
        lambda s, d: _r(logs.usage(_usage_rows(s, d)), "avg_latency_ms"),
        "SELECT l_returnflag || '/' || l_linestatus AS provider, count(*) AS calls, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber) AS BIGINT) AS output_tokens, sum(CAST(floor(l_extendedprice) AS DOUBLE)) AS cost_usd, CAST(sum(l_suppkey) AS BIGINT) AS latency_ms, round(sum(l_suppkey) / count(*), 6) AS avg_latency_ms FROM lineitem GROUP BY 1",
    ),
    "usage_totals": (lambda s, d: logs.usage_totals(_usage_rows(s, d)), "SELECT count(*) AS calls, sum(CAST(floor(l_extendedprice) AS DOUBLE)) AS cost_usd FROM lineitem"),
    "log_usage": (
        lambda s, d: _r(logs.usage(log(s, d)), "cost_usd", "avg_latency_ms"),
        L + "SELECT provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, round(sum(latency_ms) / count(*), 6) AS avg_latency_ms FROM log WHERE event = '' GROUP BY provider",
    ),
    "tool_insights": (
        lambda s, d: _r(logs.tool_insights(log(s, d)), "zero_pct"),
        L + "SELECT tool, count(*) AS calls, count(*) FILTER (zero_result) AS zero_results, CAST(sum(result_bytes) AS BIGINT) AS bytes, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, round(100.0 * count(*) FILTER (zero_result) / count(*), 6) AS zero_pct, CAST(sum(result_bytes) // count(*) AS BIGINT) AS avg_bytes, CAST(sum(duration_ms) // count(*) AS BIGINT) AS avg_ms FROM log WHERE event = 'mcp_call' GROUP BY tool",
    ),
    "unused_tools": (_unused, L + "SELECT 't' || CAST(i AS STRING) AS tool FROM range(10) r(i) WHERE 't' || CAST(i AS STRING) NOT IN (SELECT tool FROM log WHERE event = 'mcp_call')"),
    "refreshes": (lambda s, d: logs.refreshes(log(s, d)), L + "SELECT count(*) AS refreshes, CAST(sum(failed) AS BIGINT) AS failed_files, max_by(parsed, ord) AS last_parsed, max_by(deleted, ord) AS last_deleted FROM log WHERE event = 'graph_refresh'"),
    "hook_percentiles": (lambda s, d: logs.hooks(log(s, d)), L + "SELECT count(*) AS calls, count(*) FILTER (NOT ok) AS failures, CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_ms FROM log WHERE event = 'hook'"),
    "violations": (lambda s, d: logs.violations(log(s, d)), L + "SELECT outcome, count(*) AS n FROM log WHERE event = 'violation' GROUP BY outcome"),
    "gate_failures": (lambda s, d: logs.gate_failures(log(s, d)), L + "SELECT outcome, count(*) AS n FROM log WHERE event = 'gate_attempt' AND NOT ok GROUP BY outcome"),
    "prompts": (lambda s, d: logs.prompts(log(s, d)), L + "SELECT count(*) AS prompts, count(DISTINCT nullif(session_id, '')) AS sessions FROM log WHERE event = 'prompt'"),
    "feature_funnel": (
        lambda s, d: logs.funnel(log(s, d)),
        L
        + """, g AS (SELECT * FROM log WHERE feature <> '' AND (event = 'gate_attempt' OR event = 'tdd_stage' AND stage = 'mark')),
f AS (SELECT feature, string_agg(outcome || '=' || CAST(n AS STRING), ',' ORDER BY outcome) AS failures FROM (SELECT feature, outcome, count(*) AS n FROM g WHERE event = 'gate_attempt' AND NOT ok GROUP BY 1, 2) GROUP BY feature)
SELECT g.feature, count(*) FILTER (event = 'gate_attempt' AND stage = 'red') AS red_attempts, count(*) FILTER (event = 'gate_attempt' AND stage = 'green') AS green_attempts, coalesce(any_value(f.failures), '') AS failures,
  coalesce(max_by(outcome, ord) FILTER (event = 'tdd_stage'), '') AS final_status FROM g LEFT JOIN f ON g.feature = f.feature GROUP BY g.feature""",
    ),
    "last_review": (lambda s, d: logs.last_review(log(s, d)), L + "SELECT max_by(stage, ord) AS review_stage, max_by(outcome, ord) AS review_outcome FROM log WHERE event = 'tdd_stage' AND stage IN ('review', 'branch-review')"),
    "compare_runs": (
        _compare,
        L
        + """, t AS (SELECT ord % 4 < 2 AS b, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, sum(cost_usd) AS cost FROM log WHERE event = '' GROUP BY 1)
SELECT b.calls AS baseline_calls, b.tokens AS baseline_tokens, round(b.cost, 6) AS baseline_cost, c.calls AS candidate_calls, c.tokens AS candidate_tokens, round(c.cost, 6) AS candidate_cost,
  round((c.tokens - b.tokens) / b.tokens * 100, 6) AS token_delta_pct, round((c.cost - b.cost) / b.cost * 100, 6) AS cost_delta_pct FROM t b, t c WHERE b.b AND NOT c.b""",
    ),
    "cost_estimate": (
        _cost,
        L + "SELECT l.provider, l.model, count(*) AS calls, round(sum((coalesce(i, 0) * input_tokens + coalesce(o, 0) * output_tokens) / 1e6), 6) AS usd FROM log l LEFT JOIN (VALUES ('p1', 'm0', 0.8::DOUBLE, 4.0::DOUBLE), ('p2', 'm1', 3.0, 15.0), ('p3', 'm2', 15.0, 75.0)) r(provider, model, i, o) ON l.provider = r.provider AND l.model = r.model WHERE event = '' GROUP BY 1, 2",
    ),
    "condition_medians": (_medians, L + "SELECT 'c' || CAST(ord % 3 AS STRING) AS condition, quantile_cont(CAST(input_tokens AS DOUBLE), 0.5) AS input_tokens, quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS latency_ms FROM log WHERE event = '' GROUP BY 1"),
    "median_deltas": (
        _deltas,
        L + "SELECT metric, max(v) FILTER (c = 0) AS base, max(v) FILTER (c = 1) AS other FROM (SELECT ord % 3 AS c, 'input_tokens' AS metric, quantile_cont(CAST(input_tokens AS DOUBLE), 0.5) AS v FROM log WHERE event = '' GROUP BY 1 UNION ALL SELECT ord % 3, 'latency_ms', quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) FROM log WHERE event = '' GROUP BY 1) GROUP BY metric",
    ),
    "log_tail": (lambda s, d: last_rows(log(s, d), 40).select("ord", "event", "outcome"), L + "SELECT ord, event, outcome FROM log ORDER BY ord DESC LIMIT 40"),
    "alert_rules": (_rules, L + "," + _EVIDENCE + " SELECT rule_id, CAST(evidence AS BIGINT) AS evidence FROM r"),
    "alerts_shown": (_shown, L + "," + _EVIDENCE + " SELECT rule_id, CAST(evidence AS BIGINT) AS evidence FROM r WHERE rule_id <> 'secret-guard' AND NOT (rule_id = 'learn-stale' AND evidence <= 12) AND NOT (rule_id = 'gate-friction' AND evidence <= 1) ORDER BY evidence DESC, rule_id LIMIT 2"),
}
