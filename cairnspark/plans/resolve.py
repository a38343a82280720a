"""Symbol resolution: references and import lists to typed edges, one plan of joins per rule.

Candidates of all rules of a reference are united with the rule's priority; those of the best rule stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import path_of_id, test_sources
from ..functions.text import strip_test_suffix
from ..operators.graph_joins import longest_prefix_class, overrides, without_logger_calls

AMBIGUOUS = 5


def _classes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, path, package, fqn) of classes and test classes."""
    c = nodes.filter("kind in ('class', 'test')").join(files.select("path", "package"), "path", "left")
    package = F.coalesce("package", F.lit(""))
    return c.select("id", "name", "path", package.alias("package"), F.when(package == "", F.col("name")).otherwise(F.concat(package, F.lit("."), "name")).alias("fqn"), "kind")


def _by_fqn(classes: DataFrame) -> DataFrame:
    """(fqn, id, path): one class a full name, the least id."""
    return classes.groupBy("fqn").agg(F.min(F.struct("id", "path")).alias("c")).select("fqn", "c.id", "c.path")


def _edge(df: DataFrame, from_: str, to: str, kind: str | Column, confidence: str | Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.col(from_).alias("from_id"), F.col(to).alias("to_id"), lit(kind).alias("kind"), lit(confidence).alias("confidence"))


def import_edges(nodes: DataFrame, files: DataFrame, module: str = "") -> DataFrame:
    """File to file. Go: packages below the module path, to all their files. Others: wildcards to all classes'
    files of the package, full names to their class's file."""
    classes = _classes(nodes, files)
    imports = files.select("path", "language", F.explode_outer("imports").alias("i")).filter("i is not null")
    go, rest = imports.filter("language = 'go'"), imports.filter("language <> 'go' or language is null")
    rel = F.when(F.col("i") == module, "").when(F.col("i").startswith(module + "/"), F.substring("i", len(module) + 2, 1 << 30))
    own = files.select(F.col("path").alias("to_id"), F.coalesce("package", F.lit("")).alias("package"))
    a = go.withColumn("package", rel).filter("package is not null").join(own, "package") if module else None
    # A wildcard names each class's file of its package: as many edges as the product of the two, which are made
    # different from the start and moved by no shuffle. Files whose classes are of several packages are few.
    home = classes.select("package", F.col("path").alias("to_id")).distinct()
    several = home.groupBy("to_id").agg(F.count("*").alias("m")).filter("m > 1").select("to_id")
    wanted = rest.filter("i like '%.*'").select("path", F.regexp_replace("i", r"\.\*$", "").alias("package")).distinct()
    wild = _product(wanted, home.join(several, "to_id", "left_anti"), "package", "path").select("path", "to_id")
    named = rest.filter("i not like '%.*'").join(_by_fqn(classes).select(F.col("fqn").alias("i"), F.col("path").alias("to_id")), "i").select("path", "to_id")
    by_other = named if a is None else named.union(a.select("path", "to_id"))
    by_other = by_other.union(wanted.join(home.join(several, "to_id", "left_semi"), "package").select("path", "to_id")).distinct()
    # What a wildcard names already is left out, by the packages of the target.
    of_target = by_other.join(home.join(several, "to_id", "left_anti"), "to_id").join(wanted, ["path", "package"], "left_semi").select("path", "to_id")
    out = wild.union(by_other.join(of_target, ["path", "to_id"], "left_anti"))
    return _edge(out, "path", "to_id", "imports", "exact").filter("from_id <> to_id")


#: Tasks that share the rows of a key where two sides of few keys are joined.
SHARES = 64


def _product(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """The join of two sides on a key with many rows on both: the rows of the left one are dealt by a column, and each
    share of a key meets all of the right one."""
    share = F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int")
    dealt = lambda df, s: df.withColumn("share", s).repartition(SHARES, key, "share")  # noqa: E731  by number: few rows, but many come out
    return dealt(left, share).join(dealt(right, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), [key, "share"]).drop("share")


def _best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of the best rule of each reference, with n, how many that rule has."""
    w = Window.partitionBy(*keys)
    return candidates.withColumn("top", F.min("rule").over(w)).filter("rule = top").withColumn("n", F.count("*").over(w)).drop("top")


def _of_few(named: DataFrame) -> DataFrame:
    """Rows whose name AMBIGUOUS rows have at most: more candidates are none, so frequent names aren't joined."""
    many = named.groupBy("name").agg(F.count("*").alias("k")).filter(F.col("k") > AMBIGUOUS).select("name")
    return named.join(many, "name", "left_anti")


def _few_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, to_id) of different rows: AMBIGUOUS + 1 of each key at most, the least ones, found in shares of a key's rows
    before they meet."""
    some = lambda df, *more: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys, *more).orderBy("to_id"))).filter(F.col("k") <= AMBIGUOUS + 1).drop("k")
    return some(some(rows.withColumn("share", F.pmod(F.xxhash64("to_id"), F.lit(SHARES))), "share")).select(*keys, "to_id")


def resolve_classes(nodes: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence) of extends and implements references.

    A dotted name must be a full name. Else, by priority: a class of the file, of its package, an explicit
    import (external if unknown) — all exact; wildcard imports, then the name anywhere: high if there is one,
    low for each of several, of the name anywhere AMBIGUOUS at most.
    """
    classes = _classes(nodes, files)
    fqn = _by_fqn(classes).select("fqn", F.col("id").alias("to_id"))
    r = refs.filter("kind in ('extends', 'implements')").select("from_id", "kind", "name", path_of_id(F.col("from_id")).alias("path")).distinct()
    r = r.join(files.select("path", F.coalesce("package", F.lit("")).alias("package"), "imports"), "path", "left")
    dotted, plain = r.filter("contains(name, '.')"), r.filter("not contains(name, '.')")
    key = ["from_id", "kind", "name"]
    imports = plain.select(*key, F.explode("imports").alias("i"))
    explicit = imports.filter(F.col("i").endswith(F.concat(F.lit("."), "name"))).join(fqn.withColumnRenamed("fqn", "i"), "i", "left")
    rules = [
        dotted.join(fqn, F.col("name") == F.col("fqn")).select(*key, "to_id", F.lit(0).alias("rule")),
        plain.join(classes.groupBy("name", "path").agg(F.min("id").alias("to_id")), ["name", "path"]).select(*key, "to_id", F.lit(1).alias("rule")),
        plain.filter("package <> ''").withColumn("fqn", F.concat("package", F.lit("."), "name")).join(fqn, "fqn").select(*key, "to_id", F.lit(2).alias("rule")),
        explicit.groupBy(*key).agg(F.min(F.coalesce("to_id", F.concat(F.lit("external::"), "i"))).alias("to_id")).select(*key, "to_id", F.lit(3).alias("rule")),
        imports.filter("i like '%.*'").withColumn("fqn", F.concat(F.regexp_replace("i", r"\*$", ""), "name")).join(fqn, "fqn").select(*key, "to_id", F.lit(4).alias("rule")).distinct(),
        plain.join(_of_few(classes.select("name", F.col("id").alias("to_id"))), "name").select(*key, "to_id", F.lit(5).alias("rule")),
    ]
    all_ = rules[0]
    for x in rules[1:]:
        all_ = all_.unionByName(x)
    got = _best(all_, key).filter(f"rule < 5 or n <= {AMBIGUOUS}")
    return _edge(got, "from_id", "to_id", F.col("kind"), F.when(F.col("rule") < 4, "exact").when(F.col("n") == 1, "high").otherwise("low")).filter("from_id <> to_id").distinct()


def resolve_calls(nodes: DataFrame, files: DataFrame, refs: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence) of call references by the called name.

    By priority: a method inherited by a class of the file (medium; the least id of several); visible ones, of
    the file, its package or its imports: one is high, up to AMBIGUOUS low, more none; else any: one is medium,
    up to AMBIGUOUS low. Calls of loggers are left out.
    """
    classes = _classes(nodes, files)
    m = nodes.filter("kind = 'function'").select(F.col("id").alias("to_id"), F.col("path").alias("at"), F.substring_index("name", ".", -1).alias("name"), F.when(F.col("name").contains("."), F.concat("path", F.lit("::"), F.regexp_replace("name", r"\.[^.]*$", ""))).alias("owner"))
    r = without_logger_calls(refs.filter("kind = 'calls'")).select("from_id", "name", path_of_id(F.col("from_id")).alias("path")).distinct()
    key = ["from_id", "name"]
    children = inheritance.join(nodes.select(F.col("id").alias("from_id"), "path"), "from_id").select("path", F.col("to_id").alias("owner")).distinct()
    inherited = r.join(children, "path").join(m, ["owner", "name"]).groupBy(*key).agg(F.min("to_id").alias("to_id")).withColumn("rule", F.lit(0))
    # What a file sees is itself, packages and files of imported classes: these meet the methods in them, and no list of
    # the files that a file sees is made. More than AMBIGUOUS are none, so of a name in a package one more will do.
    imports = files.select("path", F.explode("imports").alias("i"))
    package = files.select("path", F.lit("package").alias("of"), F.coalesce("package", F.lit("")).alias("where"))
    wild = imports.filter("i like '%.*'").select("path", F.lit("package").alias("of"), F.regexp_replace("i", r"\.\*$", "").alias("where"))
    named = imports.join(_by_fqn(classes).select(F.col("fqn").alias("i"), F.col("path").alias("where")), "i").select("path", F.lit("file").alias("of"), "where")
    own = files.select("path", F.lit("file").alias("of"), F.col("path").alias("where"))
    sees = own.union(package).union(wild).union(named).distinct()
    inside = m.select("name", F.lit("file").alias("of"), F.col("at").alias("where"), "to_id").distinct()
    packed = m.join(classes.select("package", F.col("path").alias("at")).distinct(), "at").select("name", F.lit("package").alias("of"), F.col("package").alias("where"), "to_id").distinct()
    places = _few_each(inside.union(packed), ["name", "of", "where"])
    visible = r.join(sees, "path").join(places, ["name", "of", "where"]).select(*key, "to_id").distinct().withColumn("rule", F.lit(1))
    few = _of_few(m.select("name", "to_id"))
    any_ = r.join(few, "name").select(*key, "to_id", F.lit(2).alias("rule"))
    got = _best(inherited.unionByName(visible).unionByName(any_), key).filter(f"rule = 0 or n <= {AMBIGUOUS}")
    confidence = F.when(F.col("rule") == 0, "medium").when(F.col("n") > 1, "low").when(F.col("rule") == 1, "high").otherwise("medium")
    return _edge(got, "from_id", "to_id", "calls", confidence).filter("from_id <> to_id").distinct()


def fragment_edges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Spreads to fragments by name, and fragments to the schema type that they are on."""
    named = lambda kind: nodes.filter(F.col("kind") == kind).groupBy("name").agg(F.max("id").alias("to_id"))
    spreads = refs.filter("kind = 'spreads'").select("from_id", "name").distinct().join(named("graphql_fragment"), "name")
    on = nodes.filter("kind = 'graphql_fragment'").select(F.col("id").alias("from_id"), F.col("return_type").alias("name")).join(named("graphql_type"), "name")
    return _edge(spreads, "from_id", "to_id", "spreads", "exact").union(_edge(on, "from_id", "to_id", "on_type", "exact")).filter("from_id <> to_id").distinct()


def test_edges(nodes: DataFrame, files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Classes to their tests: NameTest, NameTests, NameIT and TestName (high); TypeScript files to tests beside
    them (high); and, for test classes not linked so, the longest class whose name begins theirs, if the test
    imports its file or calls a method of it (medium). resolved: imports and calls edges."""
    classes, tests = nodes.filter("kind = 'class'").select(F.col("id").alias("from_id"), "name", "path"), nodes.filter("kind = 'test'").select(F.col("id").alias("to_id"), F.col("name").alias("test"), F.col("path").alias("test_path"))
    names = F.explode(F.array(*(F.concat(F.lit(a), "name", F.lit(b)) for a, b in (("", "Test"), ("", "Tests"), ("", "IT"), ("Test", "")))))
    exact = _edge(classes.select("from_id", names.alias("test")).join(tests, "test"), "from_id", "to_id", "tested_by", "high")
    beside = files.filter("language = 'typescript'").select(F.col("path").alias("to_id"), F.explode(test_sources(F.col("path"))).alias("from_id")).join(files.select(F.col("path").alias("from_id")), "from_id", "left_semi").filter("from_id <> to_id")
    high = exact.union(_edge(beside, "from_id", "to_id", "tested_by", "high")).distinct()
    loose = tests.join(high.select("to_id"), "to_id", "left_anti").withColumn("base", strip_test_suffix(F.col("test"))).filter("base is not null")
    near = loose.join(longest_prefix_class(loose, classes), "base").join(classes, "name")
    imports = resolved.filter("kind = 'imports'").select(F.col("from_id").alias("test_path"), F.col("to_id").alias("path")).distinct()
    owner = nodes.filter("kind = 'function' and contains(name, '.')").select("id", F.concat("path", F.lit("::"), F.regexp_replace("name", r"\.[^.]*$", "")).alias("owner"))
    calls = resolved.filter("kind = 'calls'").join(owner.select(F.col("id").alias("from_id"), F.col("owner").alias("t")), "from_id").join(owner.select(F.col("id").alias("to_id"), F.col("owner").alias("c")), "to_id").select(F.col("t").alias("to_id"), F.col("c").alias("from_id")).distinct()
    proven = near.join(imports, ["test_path", "path"], "left_semi").select("from_id", "to_id").union(near.join(calls, ["to_id", "from_id"], "left_semi").select("from_id", "to_id"))
    return high.union(_edge(proven.distinct(), "from_id", "to_id", "tested_by", "medium"))


def resolve(nodes: DataFrame, files: DataFrame, refs: DataFrame, module: str = "") -> tuple[DataFrame, DataFrame]:
    """All edges of references and imports, and nodes for external targets."""
    imports = import_edges(nodes, files, module)
    inherits = resolve_classes(nodes, files, refs)
    calls = resolve_calls(nodes, files, refs, inherits)
    over = _edge(overrides(nodes, inherits.select("from_id", "to_id")), "from_id", "to_id", "overrides", "high")
    all_ = imports.union(inherits).union(calls).union(fragment_edges(nodes, refs)).union(test_edges(nodes, files, imports.union(calls))).union(over).distinct()
    outside = all_.filter("to_id like 'external::%'").select(F.col("to_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return all_, outside.select("id", F.lit("external").alias("kind"), F.substring("id", 11, 1 << 30).alias("name"))
