"""Look-ups, filters, joins and aggregates over graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import domain, subsystem


def find(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name has the query in any case, by id."""
    return nodes.filter(F.lower("name").contains(query.lower())).orderBy("id")


def resolve_target(nodes: DataFrame, target: str) -> DataFrame:
    """(id, how) of what a target names: the node of that id, the only hit, a class of that very name, any
    node of it; the least id of several. No row: see suggestions."""
    hits = nodes.filter((F.col("id") == target) | F.lower("name").contains(target.lower()))
    one = hits.groupBy().agg(F.count_if(F.lower("name").contains(target.lower())).alias("n"))
    exact = F.col("name") == target
    rank = F.when(F.col("id") == target, 0).when(F.col("n") == 1, 1).when(exact & (F.col("kind") == "class"), 2).when(exact, 3)
    best = hits.join(one).withColumn("rank", rank).filter("rank is not null").agg(F.min(F.struct("rank", "id")).alias("b")).filter("b is not null")
    return best.select("b.id", F.element_at(F.array(*map(F.lit, ("id", "single", "class", "name"))), F.col("b.rank") + 1).alias("how"))


def suggestions(nodes: DataFrame, target: str, n: int = 3) -> DataFrame:
    return find(nodes, target).select("id", "name").limit(n)


def existing(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(nodes.select("id"), "id", "left_semi")


def callers(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id): distinct nodes that call each target (id)."""
    e = edges.filter("kind = 'calls'").join(targets.select(F.col("id").alias("to_id")).distinct(), "to_id")
    return e.select(F.col("to_id").alias("target"), F.col("from_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").select("target", "id")


def callees(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id): distinct nodes that each source (id) calls."""
    e = edges.filter("kind = 'calls'").join(sources.select(F.col("id").alias("from_id")).distinct(), "from_id")
    return e.select(F.col("from_id").alias("source"), F.col("to_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").select("source", "id")


def fan_in(edges: DataFrame) -> DataFrame:
    """(id, fan_in): different callers."""
    return edges.filter("kind = 'calls'").groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("fan_in"))


def not_trivial(nodes: DataFrame, edges: DataFrame, span: int = 4) -> DataFrame:
    """Nodes longer than the span or with a call of their own."""
    short = nodes.filter((F.col("end_line") - F.col("line") + 1 <= span)).select("id")
    idle = short.join(edges.filter("kind = 'calls'").select(F.col("from_id").alias("id")), "id", "left_anti")
    return nodes.join(idle, "id", "left_anti")


def without_logger_calls(refs: DataFrame) -> DataFrame:
    """Refs but calls of level methods on log or logger."""
    level = F.col("name").isin("error", "warn", "warning", "info", "debug", "trace", "fatal")
    return refs.filter(~((F.col("kind") == "calls") & F.lower(F.coalesce("recv", F.lit(""))).isin("log", "logger") & level))


def with_package(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return nodes.join(files.select("path", "package"), "path", "left")


def by_subsystem(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(subsystem, n) of hits (id, path), most first."""
    s = subsystem(F.col("package"), F.col("path"))
    return with_package(hits, files).groupBy(s.alias("subsystem")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subsystem")


def node_domains(nodes: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """(id, domain); external for external nodes."""
    d = F.when(F.col("kind") == "external", "external").otherwise(domain(F.col("package"), F.col("path"), depth))
    return with_package(nodes, files).select("id", d.alias("domain"))


def cross_domain(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """edges between different known domains, with from_domain and to_domain. Dependencies only."""
    a = domains.select(F.col("id").alias("from_id"), F.col("domain").alias("from_domain"))
    b = domains.select(F.col("id").alias("to_id"), F.col("domain").alias("to_domain"))
    j = edges.filter(~F.col("kind").isin("contains", "documents")).join(a, "from_id").join(b, "to_id")
    return j.filter("from_domain <> to_domain and from_domain <> 'external' and to_domain <> 'external'")


def domain_shares(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """(from_domain, to_domain, n, out, share) of all edges between domains."""
    return shares_of(cross_domain(edges, domains))


def shares_of(cross: DataFrame) -> DataFrame:
    """domain_shares of edges between domains."""
    n = cross.groupBy("from_domain", "to_domain").agg(F.count("*").alias("n"))
    out = F.sum("n").over(Window.partitionBy("from_domain"))
    return n.withColumn("out", out).withColumn("share", F.col("n") / F.col("out"))


def domain_edges(edges: DataFrame, file_domains: DataFrame) -> DataFrame:
    """(from_domain, to_domain) of file edges (from_id, to_id), each once and none to itself."""
    a, b = file_domains.select(F.col("path").alias("from_id"), F.col("domain").alias("from_domain")), file_domains.select(F.col("path").alias("to_id"), F.col("domain").alias("to_domain"))
    return edges.join(a, "from_id").join(b, "to_id").filter("from_domain <> to_domain").select("from_domain", "to_domain").distinct()


def boundary(edges: DataFrame, file_domains: DataFrame) -> DataFrame:
    """(domain, direction, other): what each domain uses and what uses it."""
    e = domain_edges(edges, file_domains)
    return e.select(F.col("from_domain").alias("domain"), F.lit("out").alias("direction"), F.col("to_domain").alias("other")).union(e.select("to_domain", F.lit("in"), "from_domain"))


def file_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight): pairs of files by imports, calls and inheritance edges between them, either way."""
    paths = nodes.filter("kind <> 'external' and path <> ''").select("id", "path")
    e = edges.filter(F.col("kind").isin("imports", "calls", "extends", "implements"))
    j = e.join(paths.select(F.col("id").alias("from_id"), F.col("path").alias("p")), "from_id").join(paths.select(F.col("id").alias("to_id"), F.col("path").alias("q")), "to_id")
    return j.filter("p <> q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("weight"))


def primary_language(nodes: DataFrame) -> DataFrame:
    """One row (language): the most frequent of functions, the lesser of equals; go without functions."""
    n = nodes.filter("kind = 'function'").groupBy("language").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.min_by("language", F.struct(-F.col("n"), F.col("language"))), F.lit("go")).alias("language"))


def domain_sizes(files: DataFrame, file_domains: DataFrame) -> DataFrame:
    """(domain, files, bytes, tokens): three bytes count as a token."""
    return files.join(file_domains, "path").groupBy("domain").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("tokens", F.expr("bytes div 3"))


def class_methods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, id): exported functions that each class contains."""
    m = nodes.filter("kind = 'function' and exported").select(F.col("id").alias("to_id"))
    return edges.filter("kind = 'contains'").join(m, "to_id").select(F.col("from_id").alias("class_id"), F.col("to_id").alias("id")).distinct()


def function_files(nodes: DataFrame, language: str = "typescript", within: DataFrame | None = None) -> DataFrame:
    """Paths of files of a language with functions, of given paths if any."""
    p = nodes.filter((F.col("kind") == "function") & (F.col("language") == language)).select("path").distinct()
    return p if within is None else p.join(within.select("path"), "path", "left_semi")


def skills_for(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id): skill and convention nodes that document each path."""
    e = edges.filter("kind = 'documents'").join(paths.select(F.col("path").alias("to_id")).distinct(), "to_id")
    return e.select(F.col("to_id").alias("path"), F.col("from_id").alias("id")).join(nodes.select("id"), "id", "left_semi").select("path", "id").distinct()


def domain_files(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Paths that the skill node of a name documents; unknown names are an error that lists the known ones."""
    skills = nodes.filter("kind = 'skill'")
    if skills.filter(F.col("name") == name).isEmpty():
        known = [r["name"] for r in skills.select("name").distinct().orderBy("name").limit(100).collect()]
        raise ValueError(f"no domain {name!r}; there are {', '.join(known)}")
    own = skills.filter(F.col("name") == name).select(F.col("id").alias("from_id"))
    return edges.filter("kind = 'documents'").join(own, "from_id").select(F.col("to_id").alias("path")).distinct()


def longest_prefix_class(tests: DataFrame, classes: DataFrame) -> DataFrame:
    """(base, name): for each base of a test's name the longest class name that begins it and after which a
    capital begins a new word. Prefixes are cut at each capital, and joined by equality."""
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.when(F.substring("base", i + 1, 1).rlike("[A-Z]"), F.substring("base", 1, i))), lambda x: x.isNotNull())
    j = tests.select("base").distinct().filter("length(base) > 0").select("base", F.explode(cuts).alias("name")).join(classes.select("name").distinct(), "name")
    return j.groupBy("base").agg(F.max_by("name", F.length("name")).alias("name"))


def overrides(nodes: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(from_id, to_id): methods of a class and those of a direct parent with the same bare name.
    inheritance: (from_id, to_id) of extends and implements edges. Methods are functions named Owner.name."""
    own = nodes.filter("kind = 'function' and name like '%.%'")
    m = own.select("id", F.concat("path", F.lit("::"), F.regexp_replace("name", r"\.[^.]*$", "")).alias("owner"), F.substring_index("name", ".", -1).alias("bare"))
    child = m.select(F.col("id").alias("c"), F.col("owner").alias("from_id"), "bare")
    parent = m.select(F.col("id").alias("p"), F.col("owner").alias("to_id"), "bare")
    return inheritance.join(child, "from_id").join(parent, ["to_id", "bare"]).select(F.col("c").alias("from_id"), F.col("p").alias("to_id")).distinct()
