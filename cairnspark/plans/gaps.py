"""Untested public functions, ranked by risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from ..functions.text import complexity
from ..operators.coverage import symbol_coverage
from ..operators.graph_joins import fan_in, not_trivial
from ..storage import materialize
from .impact import reached


def test_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): test nodes, what they directly contain, and what lies in test files."""
    inside = edges.filter("kind = 'contains'").join(nodes.filter("kind = 'test'").select(F.col("id").alias("from_id")), "from_id").select(F.col("to_id").alias("id"))
    return nodes.filter((F.col("kind") == "test") | F.coalesce(is_test_path(F.col("path")), F.lit(False))).select("id").union(inside).distinct()


def tested(nodes: DataFrame, edges: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(id): nodes with a test of their own or of their parent, or called by test code. calls: the edges of which calls
    are asked, if not of all."""
    own = edges.filter("kind = 'tested_by'").select(F.col("from_id").alias("id"))
    parent = edges.filter("kind = 'contains'").join(own.withColumnRenamed("id", "from_id").distinct(), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    called = (edges if calls is None else calls).filter("kind = 'calls'").join(test_code(nodes, edges).withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    return own.union(parent).union(called).distinct()


def untested_gaps(nodes: DataFrame, edges: DataFrame, min_lines: int = 4, depth: int = 2, top: int = 0, profile: DataFrame | None = None, criticality: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(id, fan_in, blast, span, covered, score) of exported functions without tests, riskiest first.

    Left out: test code, spans below min_lines, short functions that call nothing. With a coverage profile
    fully covered ones go and others weigh by what is uncovered; without data of their own, or without a
    profile, linked tests decide (covered -1). criticality: (id, weight). within: (path).
    """
    span = F.col("end_line") - F.col("line") + 1
    c = nodes.filter("kind = 'function' and exported and line <> 0").withColumn("span", span).filter(F.col("span") >= min_lines)
    c = not_trivial(c, edges).join(test_code(nodes, edges), "id", "left_anti")
    if within is not None:
        c = c.join(within.select("path").distinct(), "path", "left_semi")
    # Few calls lead to them: what is asked of callers is asked of these calls alone.
    c = materialize(c, "gap-candidates")
    calls = edges.filter("kind = 'calls'").join(c.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "kind")
    calls = materialize(calls.distinct(), "gap-calls")
    has = tested(nodes, edges, calls).withColumn("tested", F.lit(True))
    c = c.join(has, "id", "left").select("id", "path", "line", "end_line", "span", F.coalesce("tested", F.lit(False)).alias("tested"))
    if profile is not None:
        c = c.join(symbol_coverage(c.select("id", "path", "line", "end_line"), profile), "id", "left")
        c = c.filter((F.col("ratio") < 1) | (F.col("ratio").isNull() & ~F.col("tested")))
    else:
        c = c.filter("not tested").withColumn("ratio", F.lit(None).cast("double"))
    blast = reached(nodes, edges, c.select("id"), depth).select(F.col("source").alias("id"), F.col("n").alias("blast"))
    j = c.join(fan_in(calls), "id", "left").join(blast, "id", "left")
    weight = F.lit(1.0)
    if criticality is not None:
        j, weight = j.join(criticality.select("id", "weight"), "id", "left"), F.coalesce("weight", F.lit(1.0))
    callers, reach = F.coalesce("fan_in", F.lit(0)), F.coalesce("blast", F.lit(0))
    score = (1 - F.coalesce("ratio", F.lit(0.0))) * (callers + 1) * reach * weight * complexity(F.col("span"))
    out = j.select("id", callers.alias("fan_in"), reach.alias("blast"), "span", F.coalesce("ratio", F.lit(-1.0)).alias("covered"), score.alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(top) if top else out
