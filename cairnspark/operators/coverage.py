"""Coverage, test and mutation rows: folds, joins to symbols, scores and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(lines: DataFrame) -> DataFrame:
    """(file, line, covered) of one or more profiles: a line covered anywhere is covered."""
    return lines.groupBy("file", "line").agg(F.bool_or("covered").alias("covered"))


def overall(profile: DataFrame) -> DataFrame:
    """One row: covered and known lines and their ratio, 0 without lines."""
    return profile.agg(F.count_if("covered").alias("covered"), F.count("*").alias("known"), F.coalesce(F.avg(F.col("covered").cast("double")), F.lit(0.0)).alias("ratio"))


def coverage_gate(profile: DataFrame, least: float) -> DataFrame:
    return overall(profile).withColumn("passed", F.col("ratio") >= least)


def _endings(path: Column) -> Column:
    """A path and what is left of it without its first segments, one after the other."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def match_paths(paths: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, file): for each path the equal report file, or else the longest one that is a suffix of it, or
    of which it is, at a segment's start; the lesser of equally long ones.

    Endings meet by equality: those of a path the files that are one, and a path the endings of files, of which each
    names its best file alone. So paths and files of one frequent base name don't meet each other.
    """
    a, b = paths.select("path").distinct(), keys.select("file").distinct()
    order = lambda path: F.struct((path != F.col("file")).alias("x"), (-F.length("file")).alias("n"), F.col("file").alias("file"))
    shorter = a.select("path", F.explode(_endings(F.col("path"))).alias("file")).join(b, "file").groupBy("path").agg(F.min(order(F.col("path"))).alias("b"))
    ending = b.select("file", F.explode(_endings(F.col("file"))).alias("path")).groupBy("path").agg(F.min(order(F.col("path"))).alias("b"))
    both = shorter.unionByName(ending.join(a, "path", "left_semi"))
    return both.groupBy("path").agg(F.min("b").alias("b")).select("path", "b.file")


def symbol_coverage(symbols: DataFrame, profile: DataFrame) -> DataFrame:
    """(id, ratio) of symbols (id, path, line, end_line) with known lines in their span."""
    files = match_paths(symbols.select("path"), profile.select("file"))
    j = symbols.join(files, "path").join(profile.withColumnRenamed("line", "at"), "file").filter("at between line and end_line")
    return j.groupBy("id").agg(F.avg(F.col("covered").cast("double")).alias("ratio"))


def mutation_score(mutants: DataFrame, by: str = "tool") -> DataFrame:
    return mutants.groupBy(by).agg(F.count("*").alias("total"), F.count_if("killed").alias("killed"), F.avg(F.col("killed").cast("double")).alias("score"))


def survivors(mutants: DataFrame) -> DataFrame:
    return mutants.filter("not killed").drop("killed")


def mutation_gate(scores: DataFrame, threshold: float, skipped: Column | None = None) -> DataFrame:
    """scores with passed; a skipped run passes."""
    ok = F.col("score") >= threshold
    return scores.withColumn("passed", ok if skipped is None else skipped | ok)


def cases_of_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(file, class, name, status): cases whose class, dots as slashes, ends the file's path without its
    extension at a segment's start. Joined on what the path ends in."""
    stem = F.regexp_replace("file", r"\.[^./]*$", "")
    a = files.select("file", F.explode(_endings(stem)).alias("cp")).distinct()
    return a.join(cases.select("class", "name", "status", F.replace("class", F.lit("."), F.lit("/")).alias("cp")), "cp").select("file", "class", "name", "status")


def red_gate(cases: DataFrame, new_files: DataFrame, suite_passed: bool) -> DataFrame:
    """One row (ok, green): new tests must fail. A passing suite is not red; a new file with cases none of
    which failed or erred is green, and one without cases counts as red."""
    if suite_passed:
        return new_files.agg(F.lit(False).alias("ok"), F.lit("").alias("green"))
    per = cases_of_files(cases, new_files).groupBy("file").agg(F.bool_or(F.col("status").isin("fail", "error")).alias("bad"))
    green = per.filter("not bad").agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("green"))
    return green.select((F.col("green") == "").alias("ok"), "green")


def missing_scenarios(required: DataFrame, covered: DataFrame) -> DataFrame:
    """Tags required and not covered, without white space and @."""
    from ..functions.text import tag

    return required.select(tag(F.col("tag")).alias("tag")).distinct().join(covered.select(tag(F.col("tag")).alias("tag")), "tag", "left_anti")


def run_summary(states: DataFrame) -> DataFrame:
    """One row: features passed, pending and blocked, of (feature, status)."""
    return states.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "pending", "blocked")))


def next_pending(states: DataFrame) -> DataFrame:
    """One row (feature, resumable): the first pending one by ord, '' without one."""
    return states.agg(F.coalesce(F.min_by("feature", F.when(F.col("status") == "pending", F.col("ord"))), F.lit("")).alias("feature"), F.coalesce(F.bool_or(F.col("status") == "pending"), F.lit(False)).alias("resumable"))


def gap_slots(notes: DataFrame, total: int = 8, decisions: int = 5) -> DataFrame:
    """The best notes of two types under a common limit: reserved slots, unused ones go to the other type.
    notes: (id, type, rank) with types decision and gotcha."""
    gotchas = total - decisions
    w = Window.partitionBy("type")
    counted = notes.withColumns({"pos": F.row_number().over(w.orderBy("rank", "id")), "own": F.count("*").over(w)})
    other = notes.groupBy().agg(F.count_if(F.col("type") == "decision").alias("nd"), F.count_if(F.col("type") == "gotcha").alias("ng"))
    d0 = F.least(F.col("nd"), F.lit(decisions))
    g0 = F.lit(gotchas) + F.lit(decisions) - d0
    d1 = F.when(F.col("ng") < g0, F.least(d0 + g0 - F.col("ng"), F.col("nd"))).otherwise(d0)
    slots = F.when(F.col("type") == "decision", d1).otherwise(F.least(F.col("ng"), g0))
    return counted.join(other).filter(F.col("pos") <= slots).select("id", "type", "rank")
