"""Queries over reports that are written from parts, orders and line items, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adaptors import table
from ..functions import text
from ..operators import coverage as cov
from ..operators import logs
from ..sources import files, reports


def _batch(key: str, keys: int):
    """Reports are written in batches of so many keys that follow each other: a text doesn't grow with the table."""
    return F.floor(F.col(key) / keys).alias("batch")


def _lines(s, d):
    """Line items as coverage lines: a part is a file."""
    return table(s, d, "lineitem").select(F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") != "N").alias("covered"))


_COV = "WITH lines AS (SELECT 'src/p' || CAST(l_partkey AS STRING) || '.go' AS file, l_linenumber AS line, l_returnflag <> 'N' AS covered FROM lineitem), prof AS (SELECT file, line, bool_or(covered) AS covered FROM lines GROUP BY 1, 2) "


def _symbols(s, d):
    p = table(s, d, "part")
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("root/src/p"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), F.lit(1).alias("line"), (F.lit(1) + F.col("p_size") % 4).cast("int").alias("end_line"))


def _go(s, d):
    p = table(s, d, "part")
    row = F.concat(F.lit("example.org/m/"), "p_brand", F.lit(".go:"), F.col("p_size").cast("string"), F.lit(".2,"), (F.col("p_size") + F.col("p_partkey") % 5).cast("string"), F.lit(".9 3 "), (F.col("p_partkey") % 3).cast("string"))
    texts = p.groupBy(F.col("p_brand").alias("path"), _batch("p_partkey", 50_000)).agg(F.concat(F.lit("mode: set\n"), F.array_join(F.collect_list(row), "\n")).alias("text"))
    return cov.merge(reports.go_profile(texts, "example.org/m")).groupBy("file").agg(F.count("*").alias("known"), F.count_if("covered").alias("covered"))


_GO = "WITH l AS (SELECT p_brand || '.go' AS file, unnest(range(p_size, CAST(p_size + p_partkey % 5 + 1 AS INT))) AS line, p_partkey % 3 > 0 AS c FROM part), m AS (SELECT file, line, bool_or(c) AS c FROM l GROUP BY 1, 2) SELECT file, count(*) AS known, count(*) FILTER (c) AS covered FROM m GROUP BY 1"


def _xml_lines(s, d, line):
    p = table(s, d, "part")
    return p.groupBy("p_brand", _batch("p_partkey", 50_000)).agg(F.array_join(F.collect_list(F.format_string(line, "p_size", (F.col("p_partkey") % 3).cast("int"))), "").alias("rows"))


def _cobertura(s, d):
    t = _xml_lines(s, d, '<line number="%d" hits="%d"/>').select(F.col("p_brand").alias("path"), F.concat(F.lit('<?xml version="1.0"?><coverage><packages><package name="a"><classes><class filename="'), "p_brand", F.lit('.py"><lines>'), "rows", F.lit("</lines></class></classes></package></packages></coverage>")).alias("text"))
    return reports.cobertura(t).groupBy("file").agg(F.count("*").alias("known"), F.count_if("covered").alias("covered"))


def _jacoco(s, d):
    t = _xml_lines(s, d, '<line nr="%d" mi="0" ci="%d"/>').select(F.col("p_brand").alias("path"), F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//JACOCO//DTD" "r.dtd"><report name="x"><package name="org/x"><sourcefile name="'), "p_brand", F.lit('.java">'), "rows", F.lit("</sourcefile></package></report>")).alias("text"))
    return reports.jacoco(t).groupBy("file").agg(F.count("*").alias("known"), F.count_if("covered").alias("covered"))


def _istanbul(s, d):
    p = table(s, d, "part")
    span = F.format_string('"%d":{"start":{"line":%d},"end":{"line":%d}}', "p_partkey", "p_size", (F.col("p_size") + F.col("p_partkey") % 2).cast("int"))
    hit = F.format_string('"%d":%d', "p_partkey", (F.col("p_partkey") % 3).cast("int"))
    g = p.groupBy("p_brand", _batch("p_partkey", 50_000)).agg(F.array_join(F.collect_list(span), ",").alias("m"), F.array_join(F.collect_list(hit), ",").alias("h"))
    t = g.select(F.col("p_brand").alias("path"), F.concat(F.lit('{"/repo/'), "p_brand", F.lit('.ts":{"path":"/repo/'), "p_brand", F.lit('.ts","statementMap":{'), "m", F.lit('},"s":{'), "h", F.lit("}}}")).alias("text"))
    return reports.istanbul(t, "/repo").groupBy("file").agg(F.count("*").alias("known"), F.count_if("covered").alias("covered"))


def _xml_sql(file: str) -> str:
    return f"SELECT {file} AS file, count(*) AS known, count(*) FILTER (p_partkey % 3 > 0) AS covered FROM part GROUP BY 1"


def _formats(s, d):
    heads = F.element_at(F.array(F.lit("mode: set\nx"), F.lit('<?xml?><coverage line-rate="1">'), F.lit("<!DOCTYPE JACOCO><report>"), F.lit('  {"a":1}'), F.lit("nothing")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(s, d, "documents").groupBy(reports.detect_format(heads).alias("format")).agg(F.count("*").alias("n"))


def _cases(s, d):
    """Orders as test cases: the status by the order's."""
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("org.x.T"), (F.col("o_custkey") % 50).cast("string")).alias("class"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 11 == 0, "fail").when(F.col("o_orderkey") % 13 == 0, "error").when(F.col("o_orderkey") % 17 == 0, "skipped").otherwise("pass").alias("status"), F.col("o_orderkey").alias("key"))


_STATUS = "CASE WHEN o_orderkey % 11 = 0 THEN 'fail' WHEN o_orderkey % 13 = 0 THEN 'error' WHEN o_orderkey % 17 = 0 THEN 'skipped' ELSE 'pass' END"


def _junit(s, d):
    c = _cases(s, d)
    mark = F.when(F.col("status") == "fail", "<failure/>").when(F.col("status") == "error", '<error message="m">trace</error>').when(F.col("status") == "skipped", "<skipped/>").otherwise("")
    one = F.concat(F.lit('<testcase classname="'), "class", F.lit('" name="'), "name", F.lit('">'), mark, F.lit("</testcase>"))
    t = c.groupBy(F.col("class").alias("path"), _batch("key", 100_000)).agg(F.array_join(F.collect_list(one), "").alias("rows"))
    body = F.concat(F.lit("<testsuite name='a'><testsuite name='b'>"), "rows", F.lit("</testsuite></testsuite>"))
    whole = F.when(F.col("path") < "org.x.T3", F.concat(F.lit("<?xml version='1.0'?><testsuites>"), body, F.lit("</testsuites>"))).otherwise(body)
    return reports.junit(t.select("path", whole.alias("text"))).groupBy("class", "status").agg(F.count("*").alias("n"))


def _mutants(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("k"), (F.col("l_suppkey") % 9).cast("string")).alias("tool"), F.col("l_partkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.lit("").alias("description"), (F.col("l_quantity") > 20).alias("killed"))


def _go_mutants(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    row = F.concat(F.when(F.col("l_quantity") > 20, "FAIL").otherwise("PASS"), F.lit(' "src/p'), F.col("l_partkey").cast("string"), F.lit(".go."), F.col("l_linenumber").cast("string"), F.lit('" with checksum abc'))
    t = l.groupBy((F.col("l_suppkey") % 9).cast("string").alias("path"), _batch("l_orderkey", 5_000)).agg(F.array_join(F.collect_list(row), "\n").alias("text"))
    return cov.mutation_score(reports.go_mutants(t), "path").withColumn("score", F.round("score", 6))


def _ts_mutants(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    row = F.format_string('{"mutatorName":"M","status":"%s","location":{"start":{"line":%d}}}', F.when(F.col("l_quantity") > 20, "Killed").when(F.col("l_quantity") > 15, "Timeout").otherwise("NoCoverage"), "l_linenumber")
    t = l.groupBy((F.col("l_suppkey") % 9).cast("string").alias("path"), _batch("l_orderkey", 5_000)).agg(F.array_join(F.collect_list(row), ",").alias("m")).select("path", F.concat(F.lit('{"files":{"a.ts":{"mutants":['), "m", F.lit("]}}}")).alias("text"))
    return cov.mutation_score(reports.typescript_mutants(t), "path").withColumn("score", F.round("score", 6))


def _matched(s, d):
    return cov.match_paths(_symbols(s, d).select("path"), _lines(s, d).select("file").distinct())


def _red(s, d):
    c = _cases(s, d)
    new = s.range(0, 50).select(F.concat(F.lit("test/org/x/T"), F.col("id").cast("string"), F.lit(".java")).alias("file"))
    return cov.cases_of_files(c, new).groupBy("file").agg(F.count("*").alias("cases"), F.bool_or(F.col("status").isin("fail", "error")).alias("red"))


def _scenarios(s, d):
    n = table(s, d, "conversations")
    t = n.groupBy(F.col("conv_id").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("  @s"), x.cast("string"), F.lit(" @slow\n  Scenario: turn "), x.cast("string"))), "\n").alias("text"))
    return files.scenarios(t).select("path", "tag", "title")


def _missing(s, d):
    n = table(s, d, "conversations")
    return cov.missing_scenarios(n.select(F.concat(F.lit(" @s"), "turn").alias("tag")), n.filter("role = 'user' and turn < 3").select(F.concat(F.lit("s"), "turn").alias("tag")))


def _steps(s, d):
    """Conversations as transcripts: even turns call a tool, odd turns answer the call before."""
    n = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    even = F.col("turn") % 2 == 0
    return n.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.when(even, "tool_use").otherwise("tool_result").alias("kind"), F.floor(F.col("turn") / 2).cast("string").alias("id"), F.when(F.col("conv_id") % 2 == 0, "get_context").otherwise("other").alias("name"), F.concat(F.lit("see "), (F.col("conv_id") % 5).cast("string"), F.lit(".go")).alias("input"))


def _edits(s, d):
    e = table(s, d, "conversations").select(F.col("conv_id").alias("session")).distinct().select("session", F.explode(F.array(F.lit("a/1.go"), F.lit("a/4.go"))).alias("file"))
    return logs.edits_without_context(_steps(s, d), e, ["get_context"])


_TOP = "SELECT conv_id, turn FROM conversations GROUP BY 1, 2"

QUERIES = {
    "coverage_merge": (lambda s, d: cov.merge(_lines(s, d)), _COV + "SELECT file, line, covered FROM prof"),
    "coverage_overall": (lambda s, d: cov.coverage_gate(cov.merge(_lines(s, d)), 0.5).withColumn("ratio", F.round("ratio", 6)), _COV + "SELECT count(*) FILTER (covered) AS covered, count(*) AS known, round(avg(CAST(covered AS INT)), 6) AS ratio, avg(CAST(covered AS INT)) >= 0.5 AS passed FROM prof"),
    "coverage_of_symbols": (
        lambda s, d: cov.symbol_coverage(_symbols(s, d), cov.merge(_lines(s, d))).withColumn("ratio", F.round("ratio", 6)),
        _COV + "SELECT 'part:' || CAST(p_partkey AS STRING) AS id, round(avg(CAST(covered AS INT)), 6) AS ratio FROM part JOIN prof ON file = 'src/p' || CAST(p_partkey AS STRING) || '.go' AND line BETWEEN 1 AND 1 + p_size % 4 GROUP BY 1",
    ),
    "coverage_path_match": (_matched, _COV + "SELECT DISTINCT 'root/' || file AS path, file FROM prof JOIN part ON file = 'src/p' || CAST(p_partkey AS STRING) || '.go'"),
    "read_go_coverage": (_go, _GO),
    "read_cobertura": (_cobertura, _xml_sql("p_brand || '.py'")),
    "read_jacoco": (_jacoco, _xml_sql("'org/x/' || p_brand || '.java'")),
    "read_istanbul": (_istanbul, "SELECT p_brand || '.ts' AS file, CAST(sum(1 + p_partkey % 2) AS BIGINT) AS known, CAST(sum(CASE WHEN p_partkey % 3 > 0 THEN 1 + p_partkey % 2 ELSE 0 END) AS BIGINT) AS covered FROM part GROUP BY 1"),
    "coverage_formats": (_formats, "SELECT CASE doc_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'cobertura' WHEN 2 THEN 'jacoco' WHEN 3 THEN 'istanbul' ELSE '' END AS format, count(*) AS n FROM documents GROUP BY 1"),
    "read_junit": (_junit, f"SELECT 'org.x.T' || CAST(o_custkey % 50 AS STRING) AS class, {_STATUS} AS status, count(*) AS n FROM orders GROUP BY 1, 2"),
    "mutation_scores": (lambda s, d: cov.mutation_score(_mutants(s, d)).withColumn("score", F.round("score", 6)), "SELECT 'k' || CAST(l_suppkey % 9 AS STRING) AS tool, count(*) AS total, count(*) FILTER (l_quantity > 20) AS killed, round(avg(CAST(l_quantity > 20 AS INT)), 6) AS score FROM lineitem GROUP BY 1"),
    "mutation_gate": (lambda s, d: cov.mutation_gate(cov.mutation_score(_mutants(s, d)), 0.6).select("tool", "passed"), "SELECT 'k' || CAST(l_suppkey % 9 AS STRING) AS tool, avg(CAST(l_quantity > 20 AS INT)) >= 0.6 AS passed FROM lineitem GROUP BY 1"),
    "read_go_mutants": (_go_mutants, "SELECT CAST(l_suppkey % 9 AS STRING) AS path, count(*) AS total, count(*) FILTER (l_quantity > 20) AS killed, round(avg(CAST(l_quantity > 20 AS INT)), 6) AS score FROM lineitem GROUP BY 1"),
    "read_typescript_mutants": (_ts_mutants, "SELECT CAST(l_suppkey % 9 AS STRING) AS path, count(*) AS total, count(*) FILTER (l_quantity > 15) AS killed, round(avg(CAST(l_quantity > 15 AS INT)), 6) AS score FROM lineitem GROUP BY 1"),
    "test_cases_of_files": (
        _red,
        f"SELECT 'test/org/x/T' || CAST(o_custkey % 50 AS STRING) || '.java' AS file, count(*) AS cases, bool_or({_STATUS} IN ('fail', 'error')) AS red FROM orders GROUP BY 1",
    ),
    "scenarios": (_scenarios, "SELECT DISTINCT conv_id AS path, '@s' || CAST(turn AS STRING) AS tag, 'turn ' || CAST(turn AS STRING) AS title FROM (SELECT conv_id, turn FROM conversations)"),
    "missing_scenarios": (_missing, "SELECT DISTINCT 's' || CAST(turn AS STRING) AS tag FROM conversations WHERE turn NOT IN (SELECT turn FROM conversations WHERE role = 'user' AND turn < 3)"),
    "edits_without_context": (_edits, f"WITH t AS ({_TOP}), named AS (SELECT DISTINCT r.conv_id FROM t r JOIN t c ON c.conv_id = r.conv_id AND c.turn % 2 = 0 AND r.turn % 2 = 1 AND c.turn // 2 = r.turn // 2 AND r.turn >= c.turn WHERE r.conv_id % 2 = 0) SELECT DISTINCT conv_id AS session, f AS file, NOT (conv_id IN (SELECT conv_id FROM named) AND f = 'a/' || CAST(conv_id % 5 AS STRING) || '.go') AS warned FROM conversations, (VALUES ('a/1.go'), ('a/4.go')) x(f)"),
    "session_rows": (lambda s, d: logs.session_rows(_steps(s, d)).select("session", "tool_calls", "results"), f"SELECT conv_id AS session, count(*) FILTER (turn % 2 = 0) AS tool_calls, count(*) FILTER (turn % 2 = 1) AS results FROM ({_TOP}) GROUP BY 1"),
    "run_summary": (
        lambda s, d: cov.run_summary(table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "pending").otherwise("blocked").alias("status"))),
        "SELECT count(*) FILTER (o_orderstatus = 'F') AS pass, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS blocked FROM orders",
    ),
    "complexity_factors": (lambda s, d: table(s, d, "part").select("p_partkey", F.round(text.complexity(F.col("p_size") * 2 - 10), 6).alias("factor")), "SELECT p_partkey, round(1 + least(greatest(p_size * 2 - 10, 0), 60) / 60.0::DOUBLE, 6) AS factor FROM part"),
}
