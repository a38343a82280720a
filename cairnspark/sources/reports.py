"""Coverage, test and mutation reports as texts, to rows. Every reader takes (key, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import numbered_lines

COVERAGE = "file string, line int, covered boolean"


def detect_format(text: Column) -> Column:
    """go, jacoco, cobertura, istanbul or '' by the first 512 characters."""
    head = F.ltrim(F.substring(text, 1, 512))
    return (
        F.when(head.startswith("mode:"), "go")
        .when(head.contains("<report") | head.contains("JACOCO"), "jacoco")
        .when(head.contains("<coverage"), "cobertura")
        .when(head.startswith("{"), "istanbul")
        .otherwise("")
    )


def go_profile(reports: DataFrame, module: str = "", key: str = "path", column: str = "text") -> DataFrame:
    """Lines of `file:line.col,line.col statements count`; the module's path is cut off files."""
    pattern = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$"
    rows = numbered_lines(reports, key, column).filter(F.col("value").rlike(pattern))
    part = [F.regexp_extract("value", pattern, i) for i in range(1, 6)]
    file = F.when(part[0].startswith(module + "/"), F.substring(part[0], len(module) + 2, 1 << 30)).otherwise(part[0]) if module else part[0]
    spans = rows.select(key, file.alias("file"), part[1].cast("int").alias("s"), part[2].cast("int").alias("e"), (part[4].cast("long") > 0).alias("covered"))
    return spans.filter("e >= s").select(key, "file", F.explode(F.sequence("s", "e")).alias("line"), "covered")


def cobertura(reports: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    line = "array<struct<_number:int,_hits:bigint>>"
    cls = f"array<struct<_filename:string,lines:struct<line:{line}>>>"
    schema = f"packages struct<package:array<struct<classes:struct<class:{cls}>>>>"
    doc = reports.select(key, F.from_xml(_body(column), schema).alias("d"))
    classes = doc.select(key, F.explode("d.packages.package").alias("p")).select(key, F.explode("p.classes.class").alias("c"))
    rows = classes.select(key, F.col("c._filename").alias("file"), F.explode("c.lines.line").alias("l"))
    return rows.select(key, "file", F.col("l._number").alias("line"), (F.col("l._hits") > 0).alias("covered"))


def jacoco(reports: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """Files are package/name; a line is covered if an instruction of it is."""
    file = "array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>"
    schema = f"package array<struct<_name:string,sourcefile:{file}>>"
    doc = reports.select(key, F.from_xml(_body(column), schema).alias("d"))
    files = doc.select(key, F.explode("d.package").alias("p")).select(key, F.col("p._name").alias("pkg"), F.explode("p.sourcefile").alias("f"))
    rows = files.select(key, F.when(F.col("pkg") == "", F.col("f._name")).otherwise(F.concat("pkg", F.lit("/"), "f._name")).alias("file"), F.explode("f.line").alias("l"))
    return rows.select(key, "file", F.col("l._nr").alias("line"), (F.col("l._ci") > 0).alias("covered"))


def istanbul(reports: DataFrame, root: str = "", key: str = "path", column: str = "text") -> DataFrame:
    """Lines of each statement's range, covered if it was hit; the root is cut off paths."""
    point = "struct<line:int>"
    schema = f"map<string,struct<path:string,statementMap:map<string,struct<start:{point},end:{point}>>,s:map<string,bigint>>>"
    files = reports.select(key, F.explode(F.from_json(column, schema)).alias("name", "f"))
    path = F.coalesce(F.nullif(F.col("f.path"), F.lit("")), F.col("name"))
    top = root.rstrip("/") + "/"
    file = F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path) if root else path
    parts = files.select(key, file.alias("file"), F.col("f.s").alias("hits"), F.explode("f.statementMap").alias("id", "r"))
    rows = parts.select(key, "file", F.explode(F.sequence(F.col("r.start.line"), F.greatest("r.start.line", "r.end.line"))).alias("line"), (F.coalesce(F.try_element_at("hits", "id"), F.lit(0)) > 0).alias("covered"))
    return rows


def load_coverage(reports: DataFrame, module: str = "", root: str = "", key: str = "path", column: str = "text") -> DataFrame:
    """Of reports of any known format, read by what they look like; others give no rows."""
    kind = detect_format(F.col(column))
    own = {k: reports.filter(kind == k) for k in ("go", "cobertura", "jacoco", "istanbul")}
    return go_profile(own["go"], module, key, column).unionByName(cobertura(own["cobertura"], key, column)).unionByName(jacoco(own["jacoco"], key, column)).unionByName(istanbul(own["istanbul"], root, key, column))


def _body(column: str) -> Column:
    """XML without its declaration and document type."""
    return F.regexp_replace(column, r"(?s)^\s*<\?xml.*?\?>|<!DOCTYPE[^>]*>", "")


#: A test case with its body, if it isn't closed in itself. Quoted values may hold angle brackets.
_CASE = r"""(?s)<testcase(?=[\s/>])[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+(?:(?<=/)>|>.*?</testcase\s*>)"""


def junit(reports: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """(key, class, name, status): cases of suites nested to any depth. Status: fail before error before skipped
    before pass. Cases don't nest, so each is cut out of the report and read by itself."""
    mark = "array<struct<_VALUE:string,_message:string>>"
    plain = F.regexp_replace(F.regexp_replace(_body(column), r"(?s)<!\[CDATA\[.*?\]\]>", "x"), r"(?s)<!--.*?-->", "")
    cases = reports.select(key, F.explode(F.regexp_extract_all(plain, F.lit(_CASE), F.lit(0))).alias("x"))
    out = cases.select(key, F.from_xml("x", f"_classname string, _name string, failure {mark}, error {mark}, skipped {mark}").alias("c"))
    status = F.when(F.col("c.failure").isNotNull(), "fail").when(F.col("c.error").isNotNull(), "error").when(F.col("c.skipped").isNotNull(), "skipped").otherwise("pass")
    return out.select(key, F.coalesce("c._classname", F.lit("")).alias("class"), F.coalesce("c._name", F.lit("")).alias("name"), status.alias("status"))


def fresh_reports(spark: SparkSession, glob: str, since_epoch_s: float, slack_s: float = 2.0) -> DataFrame:
    """(path, text, modified) of reports changed since a moment, less the slack of file clocks."""
    files = spark.read.format("binaryFile").load(glob)
    return files.filter(F.unix_micros("modificationTime") >= int((since_epoch_s - slack_s) * 1e6)).select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def newest_by_name(reports: DataFrame) -> DataFrame:
    """Of reports with the same file name the newest."""
    name = F.substring_index("path", "/", -1)
    return reports.groupBy(name.alias("name")).agg(F.max_by(F.struct(*reports.columns), F.struct("modified", "path")).alias("r")).select("r.*")


MUTANTS = "tool string, file string, line int, description string, killed boolean"


def go_mutants(outputs: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """Lines `PASS "file.n" with checksum ...` are surviving mutants, FAIL ones are killed."""
    # Fixed value: the tool's output format.
    pattern = r"^\s*(PASS|FAIL)\s+\"?([^\"]+?)\.\d+\"?\s+with checksum"
    rows = numbered_lines(outputs, key, column).filter(F.col("value").rlike(pattern))
    verdict, file = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    return rows.select(key, F.lit("go").alias("tool"), file.alias("file"), F.lit(None).cast("int").alias("line"), F.lit("surviving mutant").alias("description"), (verdict == "FAIL").alias("killed"))


def go_mutation_summary(outputs: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """(key, survived, killed, total) of the line `(n passed, m failed, ... total is t)`; outputs without it are left out."""
    # Fixed value: the tool's output format.
    pattern = r"\((\d+) passed, (\d+) failed,.*total is (\d+)\)"
    got = outputs.filter(F.col(column).rlike(pattern))
    return got.select(key, *(F.regexp_extract(column, pattern, i).cast("int").alias(n) for i, n in ((1, "survived"), (2, "killed"), (3, "total"))))


def python_mutants(outputs: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """Indented `name__mutmut_n: status` lines; whatever isn't killed is a gap."""
    pattern = r"^\s+(\S+__mutmut_\d+):\s+(\w+)\s*$"
    rows = numbered_lines(outputs, key, column).filter(F.col("value").rlike(pattern))
    name, status = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    return rows.select(key, F.lit("python").alias("tool"), F.regexp_replace(name, r"\.[^.]*$", "").alias("file"), F.lit(None).cast("int").alias("line"), name.alias("description"), (status == "killed").alias("killed"))


def java_mutants(reports: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    schema = "mutation array<struct<_detected:boolean,_status:string,sourceFile:string,mutatedClass:string,lineNumber:int,description:string>>"
    rows = reports.select(key, F.explode(F.from_xml(_body(column), schema)["mutation"]).alias("m"))
    return rows.select(key, F.lit("java").alias("tool"), F.col("m.sourceFile").alias("file"), F.col("m.lineNumber").alias("line"), F.col("m.description").alias("description"), F.coalesce("m._detected", F.lit(False)).alias("killed"))


def typescript_mutants(reports: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """Killed and Timeout count as killed, all else as survived."""
    schema = "files map<string,struct<mutants:array<struct<mutatorName:string,status:string,location:struct<start:struct<line:int>>>>>>"
    files = reports.select(key, F.explode(F.from_json(column, schema)["files"]).alias("file", "f"))
    rows = files.select(key, "file", F.explode("f.mutants").alias("m"))
    return rows.select(key, F.lit("typescript").alias("tool"), "file", F.col("m.location.start.line").alias("line"), F.col("m.mutatorName").alias("description"), F.col("m.status").isin("Killed", "Timeout").alias("killed"))
