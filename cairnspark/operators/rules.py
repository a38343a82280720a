"""Alert rules over one row of evidence, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import logs

# Thresholds of the rules.
LEAST_EVIDENCE, LEAST_SEARCHES, LEAST_ZERO_RATE, LEAST_UNCOVERED = 3, 5, 0.5, 10


def evidence(log: DataFrame, needs: int = 0, uncovered: int = 0, pending: int = 0) -> DataFrame:
    """One row of what the rules read: counts of the log and three counts from elsewhere."""
    v = log.filter("event = 'violation'").agg(F.count_if(F.col("outcome") == "edit-without-context").alias("edits"), F.count_if(F.col("outcome") == "secret-guard").alias("secrets"))
    g = dominant_failure(logs.gate_failures(log))
    s = log.filter("event = 'mcp_call' and tool = 'mem_search'").agg(F.count("*").alias("searches"), F.count_if("zero_result").alias("zero"))
    given = [F.lit(x).cast("bigint").alias(n) for x, n in ((needs, "needs"), (uncovered, "uncovered"), (pending, "pending"))]
    return v.join(g).join(s).select("*", *given)  # one row each


def dominant_failure(failures: DataFrame) -> DataFrame:
    """One row (reason, failures): the most frequent reason, the lesser of equals; '' and 0 without any."""
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("outcome").alias("outcome")))
    return failures.agg(top.alias("t")).select(F.coalesce("t.outcome", F.lit("")).alias("reason"), F.coalesce(-F.col("t.n"), F.lit(0)).alias("failures"))


def evaluate(one: DataFrame) -> DataFrame:
    """(rule_id, evidence, message) of the rules that fire, most evidence first."""
    rules = [
        ("crystallize-ready", "needs >= 1", "needs", "concat(needs, ' note cluster(s) are ready to become skills')"),
        ("learn-stale", f"uncovered >= {LEAST_UNCOVERED}", "uncovered", "concat(uncovered, ' file(s) belong to no concept')"),
        ("skill-pending", "pending >= 1", "pending", "concat(pending, ' skill record(s) of others await approval')"),
        ("edit-without-context", f"edits >= {LEAST_EVIDENCE}", "edits", "concat(edits, ' edit(s) without a look at their context')"),
        ("secret-guard", f"secrets >= {LEAST_EVIDENCE}", "secrets", "concat(secrets, ' attempt(s) on secret files were blocked')"),
        ("gate-friction", f"failures >= {LEAST_EVIDENCE}", "failures", "concat('the gate failed with ', reason, ' ', failures, ' time(s)')"),
        ("mem-search-zero", f"searches >= {LEAST_SEARCHES} and zero / searches >= {LEAST_ZERO_RATE}", "zero", "concat(zero, ' of ', searches, ' searches found nothing')"),
    ]
    rows = ", ".join(f"struct('{r}' as rule_id, {c} as fires, cast({e} as bigint) as evidence, {m} as message)" for r, c, e, m in rules)
    return one.select(F.expr(f"inline(array({rows}))")).filter("fires").drop("fires").orderBy(F.desc("evidence"), "rule_id")


def to_show(suggestions: DataFrame, state: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The suggestions to show, and the new state (rule_id, last_shown, dismissed). Shown is what isn't
    dismissed and has more evidence than when last shown, as many as the budget allows, in order."""
    j = suggestions.join(state, "rule_id", "left").withColumns({"last_shown": F.coalesce("last_shown", F.lit(0)), "dismissed": F.coalesce("dismissed", F.lit(False))})
    open_ = j.filter("not dismissed and evidence > last_shown")
    # There are seven rules, so one task numbers them.
    show = open_.withColumn("n", F.row_number().over(Window.orderBy(F.desc("evidence"), "rule_id"))).filter(F.col("n") <= budget)
    after = state.join(show.select("rule_id", "evidence"), "rule_id", "full_outer").select("rule_id", F.coalesce(F.col("evidence"), F.col("last_shown")).alias("last_shown"), F.coalesce("dismissed", F.lit(False)).alias("dismissed"))
    return show.select("rule_id", "evidence", "message"), after


def read_state(text: DataFrame, column: str = "state") -> DataFrame:
    """(rule_id, last_shown, dismissed) of a JSON text {"rules": {id: {...}}}."""
    kind = "rules map<string,struct<last_shown_evidence:bigint,dismissed:boolean>>"
    return text.select(F.explode(F.from_json(column, kind)["rules"]).alias("rule_id", "s")).select("rule_id", F.coalesce("s.last_shown_evidence", F.lit(0)).alias("last_shown"), F.coalesce("s.dismissed", F.lit(False)).alias("dismissed"))


def write_state(state: DataFrame) -> DataFrame:
    """One row (state): the JSON text that read_state reads."""
    entry = F.struct("rule_id", F.struct(F.col("last_shown").alias("last_shown_evidence"), "dismissed").alias("v"))
    return state.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rules"))).alias("state"))
