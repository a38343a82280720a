"""Source files and small text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import extension

# Folders that are never sources.
SKIPPED = ("testdata", "fixtures", "__generated__")


def list_sources(spark: SparkSession, root: str, extensions: list[str], subpath: str = "", recursive: bool = True, excludes: list[str] | None = None) -> DataFrame:
    """(path, size, mtime_ns, content) of files below root with the extensions, by path. Hidden folders and
    SKIPPED are left out, and paths below an exclude."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    rel = F.expr("substring(p, position(t in p) + length(t))")
    out = files.select(F.col("path").alias("p"), top.alias("t"), "length", "modificationTime", "content").withColumn("path", rel)
    out = out.filter(extension(F.col("path")).isin(*extensions) & ~F.col("path").rlike(r"(?:^|/)(?:\.[^/]*|" + "|".join(SKIPPED) + r")/"))
    if subpath:
        out = out.filter(F.col("path").startswith(subpath.strip("/") + "/"))
    if not recursive:
        depth = len([x for x in subpath.split("/") if x]) + 1
        out = out.filter(F.size(F.split("path", "/")) == depth)
    for x in excludes or []:
        out = out.filter(~F.col("path").startswith(x.strip("/") + "/"))
    return out.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content").orderBy("path")


def numbered_lines(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, line from 1, value) of whole texts."""
    return texts.select(key, F.posexplode(F.split(column, "\n")).alias("n", "value")).select(key, (F.col("n") + 1).alias("line"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("value"))


def scenarios(features: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """(key, line, tag, title): each scenario whose tag, an @s and a number at the start of a line's tags,
    stands since the scenario before. Tags and scenarios without a partner are left out."""
    lines = numbered_lines(features, key, column).withColumn("v", F.trim("value"))
    tag = F.when(F.col("v").startswith("@"), F.nullif(F.regexp_extract("v", r"(@s\d+)", 1), F.lit("")))
    marked = lines.withColumns({"own": tag, "title": F.when(F.col("v").startswith("Scenario:"), F.trim(F.substring("v", 10, 1 << 30)))}).filter("own is not null or title is not null")
    paired = marked.withColumn("tag", F.lag("own").over(Window.partitionBy(key).orderBy("line")))
    return paired.filter("title is not null and tag is not null").select(key, "line", "tag", "title")


def front_matter(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with name and description from a leading --- block; '' where absent."""
    head = F.regexp_extract(column, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    return texts.withColumns({k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*\"?([^\r\n\"]*)", 1)) for k in ("name", "description")})


def provenance(texts: DataFrame, marker: str, column: str = "text") -> DataFrame:
    """texts with source_hash and label of a line that bears the marker; '' where absent."""
    has = F.col(column).contains(marker)
    found = {"source_hash": r"source-hash=([0-9a-f]+)", "label": r"label=([0-9A-Za-z-]+)"}
    return texts.withColumns({k: F.when(has, F.regexp_extract(column, p, 1)).otherwise("") for k, p in found.items()})


def marker_range(texts: DataFrame, key: str, opening: str, closing: str, column: str = "text") -> DataFrame:
    """(key, start_line, end_line) of the first opening marker and the first closing one after it."""
    lines = numbered_lines(texts, key, column)
    starts = lines.filter(F.col("value").contains(opening)).groupBy(key).agg(F.min("line").alias("start_line"))
    ends = lines.filter(F.col("value").contains(closing)).join(starts, key).filter("line >= start_line")
    return ends.groupBy(key).agg(F.min("start_line").alias("start_line"), F.min("line").alias("end_line"))


def transcript_steps(lines: DataFrame, key: str = "session", column: str = "text") -> DataFrame:
    """(key, ord, kind, id, name, input, is_error): content blocks of JSON message lines in order.
    lines: (key, line, text)."""
    block = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean,input:string>>"
    got = lines.select(key, "line", F.get_json_object(column, "$.message.content").alias("c")).filter("c is not null")
    steps = got.select(key, "line", F.posexplode(F.from_json("c", block)).alias("n", "b"))
    return steps.select(key, (F.col("line") * 1_000_000 + F.col("n")).alias("ord"), F.col("b.type").alias("kind"), F.coalesce("b.id", "b.tool_use_id").alias("id"), "b.name", "b.input", F.coalesce("b.is_error", F.lit(False)).alias("is_error"))
