"""Transitive closures over one kind of edge, and what hangs on them: traits and test structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .impact import impact


def closure(pairs: DataFrame, sources: DataFrame, limit: int = 100) -> DataFrame:
    """(source, id, depth): what each source (id) reaches over pairs (a, b), at its least depth, without
    itself. Cycles end; so does the search after `limit` levels, with an error if more is to come."""
    # Written once: made anew, the different pairs of all edges would be sorted out in each level.
    pairs = materialize(pairs.select("a", "b"), "closure-pairs")
    frontier = materialize(sources.select(F.col("id").alias("source"), F.col("id").alias("id")).distinct(), "closure-sources")
    seen, out = frontier, None
    for d in range(1, limit + 1):
        new = frontier.join(pairs, F.col("id") == F.col("a")).select("source", F.col("b").alias("id")).distinct().join(seen, ["source", "id"], "left_anti")
        new = materialize(new, "closure")
        if new.isEmpty():
            break
        found = new.withColumn("depth", F.lit(d))
        out = found if out is None else out.unionByName(found)
        seen, frontier = seen.unionByName(new), new
    else:
        raise RuntimeError(f"deeper than {limit} levels")
    return out if out is not None else seen.limit(0).withColumn("depth", F.lit(0))


def _pairs(edges: DataFrame, kind: str, reverse: bool = False) -> DataFrame:
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    return edges.filter(F.col("kind") == kind).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def ancestors(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return closure(_pairs(edges, "extends"), sources)


def descendants(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return closure(_pairs(edges, "extends", reverse=True), sources)


def members(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return closure(_pairs(edges, "contains"), sources)


def own_methods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, method, name, simple): functions that a node contains."""
    f = nodes.filter("kind = 'function'").select(F.col("id").alias("method"), "name", F.substring_index("name", ".", -1).alias("simple"))
    return edges.filter("kind = 'contains'").select(F.col("from_id").alias("owner"), F.col("to_id").alias("method")).distinct().join(f, "method")


def traits_by_type(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """(type, interface, via): interfaces of each type (id): its own, those of its ancestors, and what all of
    these extend. via: the name on the shortest route, '' for its own; the least of several."""
    known = nodes.select("id", "name")
    own = types.select(F.col("id").alias("type"), F.col("id").alias("holder")).distinct().withColumn("depth", F.lit(0))
    chain = own.unionByName(ancestors(edges, types).select(F.col("source").alias("type"), F.col("id").alias("holder"), "depth"))
    declared = edges.filter("kind = 'implements'").select(F.col("from_id").alias("holder"), F.col("to_id").alias("interface")).distinct()
    direct = chain.join(declared, "holder").join(known.select(F.col("id").alias("holder"), F.col("name").alias("n")), "holder", "left")
    direct = direct.select("type", "interface", "depth", F.when(F.col("depth") == 0, "").otherwise(F.coalesce("n", F.lit(""))).alias("via"))
    above = ancestors(edges, direct.select(F.col("interface").alias("id")).distinct()).select(F.col("source").alias("interface"), F.col("id").alias("super"), F.col("depth").alias("up"))
    names = known.select(F.col("id").alias("interface"), F.col("name").alias("n"))
    more = direct.join(above, "interface").join(names, "interface").select("type", F.col("super").alias("interface"), (F.col("depth") + 1000 * F.col("up")).alias("depth"), F.col("n").alias("via"))
    best = direct.unionByName(more).groupBy("type", "interface").agg(F.min(F.struct("depth", "via")).alias("b"))
    return best.join(known.select(F.col("id").alias("interface")), "interface", "left_semi").select("type", "interface", F.col("b.via").alias("via"))


def trait_methods(nodes: DataFrame, edges: DataFrame, traits: DataFrame) -> DataFrame:
    """(type, interface, declared, method): for each declared method of a type's interfaces the nearest
    definition in the type's chain, or the declaration. traits: (type, interface)."""
    methods = own_methods(nodes, edges)
    types = traits.select(F.col("type").alias("id")).distinct()
    own = types.select(F.col("id").alias("type"), F.col("id").alias("owner")).withColumn("depth", F.lit(0))
    chain = own.unionByName(ancestors(edges, types).select(F.col("source").alias("type"), F.col("id").alias("owner"), "depth"))
    bodies = chain.join(methods.select("owner", "method", "simple"), "owner").groupBy("type", "simple").agg(F.min(F.struct("depth", "method")).alias("b"))
    decl = traits.select("type", "interface").join(methods.select(F.col("owner").alias("interface"), F.col("method").alias("declared"), "simple"), "interface")
    return decl.join(bodies, ["type", "simple"], "left").select("type", "interface", "declared", F.coalesce("b.method", "declared").alias("method"))


def other_implementers(edges: DataFrame, traits: DataFrame) -> DataFrame:
    """(type, interface, id): direct implementers of an interface outside the type and its ancestors."""
    types = traits.select(F.col("type").alias("id")).distinct()
    chain = types.select(F.col("id").alias("type"), "id").unionByName(ancestors(edges, types).select(F.col("source").alias("type"), "id"))
    all_ = traits.select("type", "interface").join(edges.filter("kind = 'implements'").select(F.col("to_id").alias("interface"), F.col("from_id").alias("id")).distinct(), "interface")
    return all_.join(chain, ["type", "id"], "left_anti").select("type", "interface", "id")


def implementers(nodes: DataFrame, edges: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(interface, id, via): direct implementers of each interface (id) and the subtypes of these; via: the
    name of the direct one, '' for itself."""
    direct = interfaces.select(F.col("id").alias("to_id")).join(edges.filter("kind = 'implements'"), "to_id").select(F.col("to_id").alias("interface"), F.col("from_id").alias("id")).distinct()
    subs = descendants(edges, direct.select("id").distinct()).select(F.col("source").alias("d"), F.col("id").alias("sub"))
    inherited = direct.join(subs, F.col("id") == F.col("d")).join(nodes.select(F.col("id").alias("d"), "name"), "d").select("interface", F.col("sub").alias("id"), F.col("name").alias("via"))
    both = direct.withColumn("via", F.lit("")).unionByName(inherited)
    return both.groupBy("interface", "id").agg(F.min("via").alias("via")).join(nodes.select("id"), "id", "left_semi").select("interface", "id", "via")


def trait_impact(nodes: DataFrame, edges: DataFrame, interface: str, depth: int = 2) -> DataFrame:
    """(id): what reaches an interface or its methods, without these, the implementers and their members."""
    one = nodes.sparkSession.createDataFrame([(interface,)], "id string")
    seeds = one.unionByName(own_methods(nodes, edges).filter(F.col("owner") == interface).select(F.col("method").alias("id")))
    impl = implementers(nodes, edges, one).select("id")
    out = seeds.unionByName(impl).unionByName(members(edges, impl).select("id"))
    return impact(nodes, edges, seeds, depth).select(F.col("node_id").alias("id")).distinct().join(out, "id", "left_anti")


def interface_methods(nodes: DataFrame, edges: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(interface, method): methods of each interface and of what it extends."""
    owners = interfaces.select(F.col("id").alias("interface"), F.col("id").alias("owner")).unionByName(ancestors(edges, interfaces).select(F.col("source").alias("interface"), F.col("id").alias("owner")))
    return owners.join(own_methods(nodes, edges), "owner").select("interface", "method").distinct()


def containing_class(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, class_id): the target if it is a class, or the nearest class that contains it."""
    up = closure(_pairs(edges, "contains", reverse=True), targets).select(F.col("source").alias("target"), "id", "depth")
    own = targets.select(F.col("id").alias("target"), "id").distinct().withColumn("depth", F.lit(0))
    classes = nodes.filter("kind = 'class'").select("id")
    return own.unionByName(up).join(classes, "id", "left_semi").groupBy("target").agg(F.min(F.struct("depth", "id")).alias("b")).select("target", F.col("b.id").alias("class_id"))


def test_structure(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, grouping, siblings, shared_base): how the class of each target is tested: by no test class, a
    single one or one per concern; their names; and the nearest base that all of them extend ('' if none)."""
    own = containing_class(nodes, edges, targets)
    tests = edges.filter("kind = 'tested_by'").select(F.col("from_id").alias("class_id"), F.col("to_id").alias("test")).distinct().join(nodes.select(F.col("id").alias("test"), "name"), "test")
    linked = own.join(tests, "class_id")
    per = linked.groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("siblings"))
    bases = linked.join(ancestors(edges, tests.select(F.col("test").alias("id")).distinct()).select(F.col("source").alias("test"), F.col("id").alias("base"), "depth"), "test")
    shared = bases.groupBy("target", "base").agg(F.count_distinct("test").alias("m"), F.min("depth").alias("depth")).join(per.select("target", "n"), "target").filter("m = n")
    best = shared.groupBy("target").agg(F.min(F.struct("depth", "base")).alias("b")).select("target", F.col("b.base").alias("base")).join(nodes.select(F.col("id").alias("base"), F.col("name").alias("shared")), "base").select("target", "shared")
    j = targets.select(F.col("id").alias("target")).distinct().join(per, "target", "left").join(best, "target", "left")
    grouping = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "single").otherwise("per-concern")
    return j.select("target", grouping.alias("grouping"), F.coalesce("siblings", F.lit("")).alias("siblings"), F.coalesce("shared", F.lit("")).alias("shared_base"))
