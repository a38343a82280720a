"""Analytics of the event log. Every function takes a log with zero values for absent fields and `ord`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def usage(log: DataFrame) -> DataFrame:
    """By provider: calls, tokens, cost and latency of model calls (rows without event), with the mean latency."""
    return (
        log.filter("event = ''")
        .groupBy("provider")
        .agg(
            F.count("*").alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("latency_ms").alias("latency_ms"),
            _ratio(F.sum("latency_ms"), F.count("*")).alias("avg_latency_ms"),
        )
    )


def usage_totals(log: DataFrame) -> DataFrame:
    """One row: calls and cost of all model calls."""
    return log.filter("event = ''").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def tool_insights(log: DataFrame) -> DataFrame:
    """By tool: calls, zero results, bytes and time, the share of zero results and whole-number means."""
    got = log.filter("event = 'mcp_call'").groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("zero_result").alias("zero_results"), F.sum("result_bytes").alias("bytes"), F.sum("duration_ms").alias("duration_ms"))
    return got.withColumns({"zero_pct": 100.0 * F.col("zero_results") / F.col("calls"), "avg_bytes": F.expr("bytes div calls"), "avg_ms": F.expr("duration_ms div calls")})


def unused_tools(log: DataFrame, tools: DataFrame) -> DataFrame:
    """Registered tools that were never called."""
    return tools.select("tool").join(log.filter("event = 'mcp_call'").select("tool"), "tool", "left_anti")


def refreshes(log: DataFrame) -> DataFrame:
    """One row: refreshes, failed files in all, and parsed and deleted files of the last one in file order."""
    last = [F.coalesce(F.max_by(c, "ord"), F.lit(0)).alias(f"last_{c}") for c in ("parsed", "deleted")]
    return log.filter("event = 'graph_refresh'").agg(F.count("*").alias("refreshes"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_files"), *last)


def percentile(column: str, p: float) -> Column:
    """Nearest rank: the value at ceil(p% of n); 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by {column})"), F.lit(0))


def hooks(log: DataFrame) -> DataFrame:
    """One row: hook calls, failures (ok not true) and nearest-rank percentiles of their time."""
    shares = [percentile("duration_ms", p).cast("bigint").alias(f"p{p}_ms") for p in (50, 95)]
    return log.filter("event = 'hook'").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), *shares)


def violations(log: DataFrame) -> DataFrame:
    return log.filter("event = 'violation'").groupBy("outcome").agg(F.count("*").alias("n"))


def gate_failures(log: DataFrame) -> DataFrame:
    return log.filter("event = 'gate_attempt' and not ok").groupBy("outcome").agg(F.count("*").alias("n"))


def prompts(log: DataFrame) -> DataFrame:
    """One row: prompts and the different sessions they name."""
    return log.filter("event = 'prompt'").agg(F.count("*").alias("prompts"), F.count_distinct(F.nullif("session_id", F.lit(""))).alias("sessions"))


def funnel(log: DataFrame) -> DataFrame:
    """By feature: red and green attempts, failures by reason (JSON text of a sorted map) and the last mark."""
    rows = log.filter("feature <> '' and (event = 'gate_attempt' or event = 'tdd_stage' and stage = 'mark')")
    gate = F.col("event") == "gate_attempt"
    counts = rows.groupBy("feature").agg(
        F.count_if(gate & (F.col("stage") == "red")).alias("red_attempts"),
        F.count_if(gate & (F.col("stage") == "green")).alias("green_attempts"),
        F.coalesce(F.max_by("outcome", F.when(~gate, F.col("ord"))), F.lit("")).alias("final_status"),
    )
    failed = rows.filter(gate & ~F.col("ok")).groupBy("feature", "outcome").agg(F.count("*").alias("n"))
    pairs = failed.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("outcome", "n"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat(x["outcome"], F.lit("="), x["n"].cast("string"))), ",")
    return counts.join(pairs, "feature", "left").select("feature", "red_attempts", "green_attempts", F.coalesce(text, F.lit("")).alias("failures"), "final_status")


def last_review(log: DataFrame) -> DataFrame:
    """One row: stage and outcome of the last review in file order, '' without one."""
    rows = log.filter("event = 'tdd_stage' and stage in ('review', 'branch-review')")
    return rows.agg(*(F.coalesce(F.max_by(c, "ord"), F.lit("")).alias(f"review_{c}") for c in ("stage", "outcome")))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: calls, tokens and cost of model calls in two logs and the changes in percent, 0 on a base of 0."""

    def totals(log: DataFrame, name: str) -> DataFrame:
        tokens = F.coalesce(F.sum(F.col("input_tokens").cast("bigint") + F.col("output_tokens")), F.lit(0))
        return log.filter("event = ''").agg(F.count("*").alias(f"{name}_calls"), tokens.alias(f"{name}_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias(f"{name}_cost"))

    both = totals(baseline, "baseline").join(totals(candidate, "candidate"))  # one row each

    def delta(what: str) -> Column:
        b, c = F.col(f"baseline_{what}"), F.col(f"candidate_{what}")
        return F.when(b > 0, (c - b) / b * 100).otherwise(0.0)

    return both.withColumns({"token_delta_pct": delta("tokens"), "cost_delta_pct": delta("cost")})


def medians(results: DataFrame, metrics: list[str], condition: str = "condition") -> DataFrame:
    """By condition the median of each metric, the mean of the middle two for even counts."""
    return results.groupBy(condition).agg(*(F.expr(f"percentile({m}, 0.5)").alias(m) for m in metrics))


def median_deltas(results: DataFrame, metrics: list[str], base: str, other: str, condition: str = "condition") -> DataFrame:
    """(metric, base, other, delta): medians of two conditions and the change, 'n/a' on a base of 0."""
    two = medians(results.filter(F.col(condition).isin(base, other)), metrics, condition).unpivot(condition, metrics, "metric", "v")
    wide = two.groupBy("metric").agg(F.max(F.when(F.col(condition) == base, F.col("v"))).alias("base"), F.max(F.when(F.col(condition) == other, F.col("v"))).alias("other"))
    return wide.withColumn("delta", F.when((F.coalesce("base", F.lit(0.0)) == 0) | F.col("other").isNull(), "n/a").otherwise(F.format_string("%+.0f%%", F.try_divide(F.col("other") - F.col("base"), F.col("base")) * 100)))


def session_rows(steps: DataFrame, key: str = "session") -> DataFrame:
    """(key, tool_calls, results, last_result) of ordered transcript steps."""
    return steps.groupBy(key).agg(F.count_if(F.col("kind") == "tool_use").alias("tool_calls"), F.count_if(F.col("kind") == "tool_result").alias("results"), F.max_by("id", F.when(F.col("kind") == "tool_result", F.col("ord"))).alias("last_result"))


def edits_without_context(steps: DataFrame, edits: DataFrame, context_tools: list[str], key: str = "session") -> DataFrame:
    """(key, file, warned): edited files of sessions in which no result of a context tool named the file's
    base name. A result counts if its call came earlier. steps: (key, ord, kind, id, name, input)."""
    calls = steps.filter((F.col("kind") == "tool_use") & F.col("name").isin(*context_tools)).select(key, "id", F.col("ord").alias("called"))
    results = steps.filter("kind = 'tool_result'").join(calls, [key, "id"]).filter("ord >= called").select(key, "input")
    named = edits.withColumn("base", F.substring_index("file", "/", -1)).join(results, key).filter(F.col("input").contains(F.col("base"))).select(key, "file").distinct().withColumn("named", F.lit(True))
    return edits.join(named, [key, "file"], "left").select(key, "file", F.col("named").isNull().alias("warned"))


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order, for first-wins duplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
