"""Domain maps: files grouped by package or by topology, small domains merged, large ones split.

Files are grouped, counted and cut by plans. The driver decides on domains only: merging is an ordered,
mutating choice among them, made from one row a domain and one a pair of coupled domains.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import is_test_file
from ..storage import materialize
from .louvain import louvain

#: Fewer files than this are grouped by package even if they have weighted edges.
LEAST_FILES = 20


@dataclass(frozen=True)
class Limits:
    depth: int = 1
    min_files: int = 0
    min_standalone: int = 0
    max_files: int = 0
    max_bytes: int = 0


def _below(package: Column, root: str) -> Column:
    """Segments of a package below the root."""
    rest = F.when(package == root, "").when(package.startswith(root + "."), F.substring(package, len(root) + 2, 1 << 30)).otherwise(package) if root else package
    return F.filter(F.split(rest, r"\."), lambda s: s != "")


def package_root(files: DataFrame) -> str:
    """The dotted package that all files with one share: of the least and the largest as arrays."""
    p = F.split("package", r"\.")
    r = files.filter("coalesce(package, '') <> ''").agg(F.min(p).alias("a"), F.max(p).alias("b")).first()
    shared = []
    for x, y in zip(r["a"] or [], r["b"] or []):
        if x != y:
            break
        shared.append(x)
    return ".".join(shared)


def kebab(package: Column, root: str) -> Column:
    """The package below the root in lower case, dots and slashes as dashes; core for the root."""
    rest = F.regexp_replace(F.when(package.startswith(root), F.substring(package, len(root) + 1, 1 << 30)).otherwise(package), "^[./]+", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(rest), "[./]", "-"), F.lit("")), F.lit("core"))


def by_package(files: DataFrame, root: str, depth: int) -> DataFrame:
    """(path, domain, package): the root and `depth` segments below it; files without package are of the root."""
    parts = F.slice(_below(F.coalesce("package", F.lit("")), root), 1, max(1, depth))
    own = F.array_join(F.concat(F.array(F.lit(root)) if root else F.array().cast("array<string>"), parts), ".")
    return files.select("path", "size", F.coalesce("package", F.lit("")).alias("file_package"), own.alias("package")).withColumn("domain", kebab(F.col("package"), root))


def _norm(package: str) -> str:
    return package.replace("/", ".").replace("-", ".")


def same_subtree(source: str, other: str) -> bool:
    """Whether a package lies below the other's parent; a top-level package is its own parent."""
    parent = _norm(source).rpartition(".")[0] or _norm(source)
    return not parent or _norm(other) == parent or _norm(other).startswith(parent + ".")


def merge_small(grouped: DataFrame, edges: DataFrame, limits: Limits) -> DataFrame:
    """grouped with domains below min_files folded, in the order of names, into the domain of their subtree
    that most file edges (from_id, to_id) join them with, the larger and then the lesser of equals. Domains
    with min_standalone files that aren't tests stay, as do those without such a partner."""
    if limits.min_files <= 1:
        return grouped
    grouped = materialize(grouped, "domains")
    stats = grouped.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~is_test_file(F.col("path"))).alias("sources"), F.min("package").alias("package"))
    size, sources, package = {}, {}, {}
    for r in stats.toLocalIterator():
        size[r["domain"]], sources[r["domain"]], package[r["domain"]] = r["n"], r["sources"], r["package"]
    of = grouped.select("path", "domain")
    pairs = edges.join(of.select(F.col("path").alias("from_id"), F.col("domain").alias("a")), "from_id").join(of.select(F.col("path").alias("to_id"), F.col("domain").alias("b")), "to_id").filter("a <> b")
    coupling: dict[str, dict[str, int]] = {}
    for r in pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")).toLocalIterator():
        coupling.setdefault(r["a"], {})[r["b"]] = coupling.setdefault(r["b"], {})[r["a"]] = r["n"]
    into: dict[str, str] = {}
    first = dict(size)
    for d in sorted(first):
        if first[d] >= limits.min_files or (limits.min_standalone and sources[d] >= limits.min_standalone):
            continue
        options = [(-n, -size[c], c) for c, n in coupling.get(d, {}).items() if c not in into and same_subtree(package[d], package[c])]
        if options:
            target = min(options)[2]
            into[d] = target
            size[target] += size[d]
    if not into:
        return grouped
    final = {}
    for d in into:
        t = into[d]
        while t in into:
            t = into[t]
        final[d] = (d, t, package[t])
    moved = grouped.sparkSession.createDataFrame(list(final.values()), "domain string, target string, target_package string")
    j = grouped.join(moved, "domain", "left")
    return j.withColumns({"domain": F.coalesce("target", "domain"), "package": F.coalesce("target_package", "package")}).drop("target", "target_package")


def split_large(grouped: DataFrame, limits: Limits, levels: int = 32) -> DataFrame:
    """grouped with parent ('' or the domain that was split): domains over max_files or max_bytes are split by
    the next segment of their files' packages as long as that divides them, and then, if too many bytes, into
    runs of files in order of their paths."""
    out = grouped.withColumns({"parent": F.lit(""), "top": F.col("domain"), "whole": F.lit(False)})
    if not limits.max_files and not limits.max_bytes:
        return out.drop("top", "whole")
    w = Window.partitionBy("domain")
    over = F.lit(False)
    if limits.max_files:
        over = over | (F.count("*").over(w) > limits.max_files)
    if limits.max_bytes:
        over = over | (F.sum("size").over(w) > limits.max_bytes)
    for _ in range(levels):
        deeper = F.when(F.col("file_package").startswith(F.concat("package", F.lit("."))), F.substring_index(F.expr("substring(file_package, length(package) + 2)"), ".", 1)).otherwise("")
        seen = out.withColumns({"over": over, "seg": deeper}).withColumn("kinds", F.size(F.collect_set("seg").over(w)))
        cut = F.col("over") & (F.col("kinds") >= 2) & ~F.col("whole")
        name = F.when(cut & (F.col("seg") != ""), F.concat("domain", F.lit("-"), F.lower("seg"))).otherwise(F.col("domain"))
        nxt = seen.select("path", "size", "file_package", F.when(cut & (F.col("seg") != ""), F.concat("package", F.lit("."), "seg")).otherwise(F.col("package")).alias("package"), name.alias("domain"), F.when(cut, F.col("top")).otherwise(F.col("parent")).alias("parent"), "top", (F.col("whole") | (cut & (F.col("seg") == ""))).alias("whole"), cut.alias("cut"))
        nxt = materialize(nxt, "domains")
        done = nxt.filter("cut").isEmpty()
        out = nxt.drop("cut")
        if done:
            break
    if limits.max_bytes:
        out = batch_by_bytes(out, limits.max_bytes)
    return out.drop("top", "whole")


def batch_by_bytes(grouped: DataFrame, limit: int) -> DataFrame:
    """Domains with more bytes cut into numbered runs: a run ends where the next file would exceed the limit."""
    total = grouped.groupBy("domain").agg(F.sum("size").alias("total")).filter(F.col("total") > limit)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("path")
        batch, used, numbers = 1, 0, []
        for s in g["size"]:
            if used and used + s > limit:
                batch, used = batch + 1, 0
            used += s
            numbers.append(batch)
        if batch > 1:
            g["parent"] = g["parent"].where(g["parent"] != "", g["top"])
            g["domain"] = [f"{d}-{k}" for d, k in zip(g["domain"], numbers)]
        return g

    large = grouped.join(total.select("domain"), "domain", "left_semi").select(grouped.columns)
    return grouped.join(total.select("domain"), "domain", "left_anti").select(grouped.columns).unionByName(large.groupBy("domain").applyInPandas(run, grouped.schema))


def batch_by_count(grouped: DataFrame, limit: int) -> DataFrame:
    """Domains with more files cut into numbered runs of `limit` files in order of their paths."""
    if limit <= 0:
        return grouped
    w = Window.partitionBy("domain")
    n = F.floor((F.row_number().over(w.orderBy("path")) - 1) / limit) + 1
    numbered = grouped.withColumns({"_k": n, "_n": F.count("*").over(w)})
    big = F.col("_n") > limit
    return numbered.withColumns({"parent": F.when(big & (F.col("parent") == ""), F.col("domain")).otherwise(F.col("parent")), "domain": F.when(big, F.concat_ws("-", "domain", F.col("_k").cast("string"))).otherwise(F.col("domain"))}).drop("_k", "_n")


def domain_map(files: DataFrame, edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, domain, package, parent) by package depth. files: (path, package, size); edges: (from_id, to_id)."""
    root = package_root(files)
    return split_large(merge_small(by_package(files, root, limits.depth), edges, limits), limits).select("path", "domain", "package", "parent")


def clustered_domain_map(files: DataFrame, edges: DataFrame, weighted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """As domain_map, by communities over weighted file pairs (a, b, weight). With few files or no weights by
    package. Files without pairs are grouped by package; communities over max_files are divided again by their
    own pairs as long as that helps. A community is named by the package its files share."""
    if files.count() < LEAST_FILES or weighted.isEmpty():
        return domain_map(files, edges, limits)
    root = package_root(files)
    linked = weighted.select(F.col("a").alias("path")).union(weighted.select("b")).distinct()
    group = materialize(louvain(files.select(F.col("path").alias("id")).join(linked.withColumnRenamed("path", "id"), "id", "left_semi"), weighted), "communities")
    while limits.max_files:
        big = group.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") > limits.max_files).select("community")
        own = group.join(big, "community", "left_semi")
        inner = weighted.join(own.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(own.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb")
        if big.isEmpty():
            break
        parts = louvain(own.select("id"), inner.select("a", "b", "weight", "ca"), by="ca")
        finer = materialize(group.join(big, "community", "left_anti").select("id", "community").unionByName(parts.select("id", "community")), "communities")
        if finer.join(group, ["id", "community"], "left_anti").isEmpty():
            break
        group = finer
    j = files.join(group.withColumnRenamed("id", "path"), "path")
    p = F.split("package", r"\.")
    ends = j.filter("coalesce(package, '') <> ''").groupBy("community").agg(F.min(p).alias("a"), F.max(p).alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n")))["n"]
    names = ends.select("community", F.array_join(F.slice("a", 1, same), ".").alias("p"))
    named = names.withColumn("d", kebab(F.col("p"), root))
    k = F.row_number().over(Window.partitionBy("d").orderBy("community"))
    named = named.withColumn("k", k).withColumn("domain", F.when(F.col("k") == 1, F.col("d")).otherwise(F.concat_ws("-", "d", F.col("k").cast("string"))))
    by_group = j.join(named, "community", "left").select("path", "size", F.coalesce("package", F.lit("")).alias("file_package"), F.coalesce("p", F.lit("")).alias("package"), F.coalesce("domain", F.lit("core")).alias("domain"))
    loose = by_package(files.join(linked, "path", "left_anti"), root, limits.depth).select("path", "size", "file_package", "package", "domain")
    merged = merge_small(by_group.unionByName(loose), edges, limits)
    return batch_by_count(split_large(merged, limits), limits.max_files).select("path", "domain", "package", "parent")


def overview(domains: DataFrame, domain_pairs: DataFrame, max_bytes: int = 0, key_files: int = 3) -> DataFrame:
    """(name, description, key_files) for an overview: each domain's shortest paths, and only as many domains, in
    the order of their names, as fit the budget. domains: (name, description, path)."""
    w = Window.partitionBy("name").orderBy(F.length("path"), "path")
    short = domains.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= key_files)
    rows = short.groupBy("name", "description").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]), ", ").alias("key_files"))
    if not max_bytes:
        return rows.orderBy("name")
    # A running sum over domains, of which there are few; the list never becomes empty.
    size = F.octet_length("name") + F.octet_length("description") + F.octet_length("key_files") + 20
    fixed = domain_pairs.agg(F.coalesce(F.sum(F.octet_length("from_domain") + F.octet_length("to_domain") + 7), F.lit(0)).alias("fixed"))
    run = F.sum(size).over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).withColumn("k", F.row_number().over(Window.orderBy("name"))).join(fixed).filter((F.col("run") + F.col("fixed") <= max_bytes) | (F.col("k") == 1)).select("name", "description", "key_files").orderBy("name")
