"""Blast radius: breadth-first reach over dependency edges from many sources at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .order import numbered, placed

CAP = 5000
#: What context tells.
CONTEXT = ("hits", "skills", "conventions", "tests", "bridge", "core")


def steps(edges: DataFrame, direction: str = "up") -> DataFrame:
    """(at, peer, kind, confidence, from_id, to_id): dependency edges as steps from a node to a peer."""
    near, far = ("to_id", "from_id") if direction == "up" else ("from_id", "to_id")
    dep = edges.filter(~F.col("kind").isin("contains", "documents"))
    return dep.select(F.col(near).alias("at"), F.col(far).alias("peer"), "kind", "confidence", "from_id", "to_id")


_KEY = ["p", "from_id", "to_id", "kind"]


def _placed(level: DataFrame) -> DataFrame:
    """A level's rows in breadth-first order, with their places."""
    return placed(level, ["source", *(F.col(f"ord.{c}") for c in _KEY)], "impact-order")


def impact(nodes: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 2, direction: str = "up", cap: int | None = CAP) -> DataFrame:
    """(source, node_id, depth, via, confidence, ord) of all nodes within `depth` steps of each source (id).

    A source also starts from its file, if that is a node. Each node counts once, by the first edge in
    breadth-first order: the order of its parent, then of the edge (from, to, kind). ord is that order within a source
    and depth: the parent's place and the edge. Unknown peers are passed over; starts are not reported. cap: so many
    nodes a source, the first in breadth-first order, by default those of the tools (None: all); see truncated. A
    source that has them goes no further.
    """
    walk = steps(edges, direction)
    known = nodes.select(F.col("id").alias("node_id"))
    start = sources.select(F.col("id").alias("source"), F.col("id").alias("node_id")).distinct().withColumn("p", F.lit(0).cast("long"))
    own_file = start.join(nodes.select(F.col("id").alias("node_id"), "path"), "node_id").filter("path <> '' and path <> node_id").select("source", F.col("path").alias("node_id")).join(known, "node_id", "left_semi").withColumn("p", F.lit(1).cast("long"))
    frontier = start.unionByName(own_file)
    seen, hits, held = frontier.select("source", "node_id"), None, None
    for d in range(1, depth + 1):
        next_ = frontier.join(walk, F.col("node_id") == F.col("at")).select("source", F.col("peer").alias("node_id"), F.struct(*_KEY, "confidence").alias("k"))
        first = next_.groupBy("source", "node_id").agg(F.min("k").alias("k")).join(seen, ["source", "node_id"], "left_anti").join(known, "node_id", "left_semi")
        new = first.select("source", "node_id", F.lit(d).alias("depth"), F.col("k.kind").alias("via"), F.col("k.confidence").alias("confidence"), F.struct(*(F.col(f"k.{c}") for c in _KEY)).alias("ord"))
        if d == depth and not cap:
            hits = new if hits is None else hits.unionByName(new)
            break
        new = _placed(new) if d < depth else materialize(new, "impact")
        goes_on = new
        if cap:
            counted = new.groupBy("source").agg(F.count("*").alias("m"))
            counted = counted.withColumn("before", F.lit(0)) if held is None else counted.join(held, "source", "left").na.fill(0, ["before"])
            room = materialize(counted.select("source", (F.lit(cap) - F.col("before")).alias("room"), (F.col("before") + F.col("m")).alias("before")), "impact-room")
            full = room.filter(F.col("before") >= cap)
            over = full.filter(F.col("before") > cap).select("source", "room")
            if not over.isEmpty():
                own = new.join(over, "source", "left_semi")
                cut = numbered(own if d < depth else _placed(own), ["source"]).join(over, "source").filter("n < room")
                new = new.join(over, "source", "left_anti").unionByName(cut.select(*[c for c in cut.columns if c in new.columns]))
            goes_on = goes_on.join(full, "source", "left_anti")
            held = room.select("source", "before") if held is None else held.join(room, "source", "left_anti").unionByName(room.select("source", "before"))
        found = new.select("source", "node_id", "depth", "via", "confidence", "ord")
        hits = found if hits is None else hits.unionByName(found)
        if d == depth or goes_on.isEmpty():
            break
        frontier, seen = goes_on.select("source", "node_id", F.col("at").alias("p")), seen.unionByName(goes_on.select("source", "node_id"))
    if hits is None:
        edge = F.struct(F.lit(0).cast("long").alias("p"), *(F.lit("").alias(c) for c in _KEY[1:]))
        hits = start.limit(0).select("source", "node_id", F.lit(0).alias("depth"), F.lit("").alias("via"), F.lit("").alias("confidence"), edge.alias("ord"))
    return hits


def reached(nodes: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 2, direction: str = "up", cap: int | None = CAP) -> DataFrame:
    """(source, n): how many nodes impact gives each source that reaches any. No order is needed for a number, so
    the walk carries pairs (source, node) only, and a source that has reached the cap walks no further."""
    pairs = steps(edges, direction).select("at", "peer")
    known = nodes.select(F.col("id").alias("node_id"))
    # Neighbours of a node are the same whoever comes to it, so what is asked of them is asked once an edge: whether
    # they are nodes, and whether the walk goes on from them.
    peers = nodes.select(F.col("id").alias("peer")).join(pairs.select(F.col("at").alias("peer")).distinct().withColumn("on", F.lit(True)), "peer", "left")
    # They are made different where they met their peers: they lie there by these.
    walk = materialize(pairs.join(peers, "peer").select("at", "peer", F.coalesce("on", F.lit(False)).alias("on")).distinct(), "reached-walk")
    start = sources.select(F.col("id").alias("source"), F.col("id").alias("node_id")).distinct()
    own_file = start.join(nodes.select(F.col("id").alias("node_id"), "path"), "node_id").filter("path <> '' and path <> node_id").select("source", F.col("path").alias("node_id")).join(known, "node_id", "left_semi")
    seen = frontier = start.unionByName(own_file)
    counts = None
    for d in range(1, depth + 1):
        met = frontier.join(walk, F.col("node_id") == F.col("at")).select("source", F.col("peer").alias("node_id"), "on").distinct()
        new = materialize(met.join(seen, ["source", "node_id"], "left_anti"), "reached")
        one = new.groupBy("source").agg(F.count("*").alias("n"))
        counts = materialize((one if counts is None else counts.unionByName(one)).groupBy("source").agg(F.sum("n").alias("n")), "reached-n")
        if d == depth:
            break
        open_ = counts.filter(F.col("n") < cap).select("source") if cap else counts.select("source")
        went = new.filter("on")
        if went.isEmpty():
            break
        frontier = went.select("source", "node_id").join(open_, "source", "left_semi")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(new.select("source", "node_id").join(open_, "source", "left_semi"))
    if counts is None:
        return start.limit(0).select("source", F.lit(0).cast("long").alias("n"))
    return counts.withColumn("n", F.least("n", F.lit(cap).cast("long"))) if cap else counts


def truncated(uncapped: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, truncated): whether more nodes are reached than the cap lets through."""
    return uncapped.groupBy("source").agg((F.count("*") > cap).alias("truncated"))


def surprises(nodes: DataFrame, edges: DataFrame, files: DataFrame, hits: DataFrame, depth: int = 2, threshold: float = 0.10, least: int = 5) -> DataFrame:
    """(source, from_id, to_id, from_domain, to_domain, score): dependencies within each source's radius between
    domains that are seldom linked: of the edges out of the first domain, `least` or more, a smaller share
    than the threshold lead to the second. score: 1 less that share."""
    from ..operators.graph_joins import cross_domain, node_domains, shares_of

    domains = node_domains(nodes, files, depth)
    rare = shares_of(cross_domain(edges, domains)).filter((F.col("out") >= least) & (F.col("share") < threshold)).select("from_domain", "to_domain", (1 - F.col("share")).alias("score"))
    inside = materialize(hits.select("source", "node_id").union(hits.select("source", F.col("source").alias("node_id"))).distinct(), "inside")
    # The edges within a radius come first: these alone are made different and meet the seldom linked domains.
    near = edges.select("from_id", "to_id", "kind").join(inside.withColumnRenamed("node_id", "from_id"), "from_id").join(inside.withColumnRenamed("node_id", "to_id"), ["source", "to_id"])
    within = cross_domain(materialize(near, "near-edges"), domains).join(rare, ["from_domain", "to_domain"])
    return within.select("source", "from_id", "to_id", "from_domain", "to_domain", "score").distinct()


def affected_skills(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(source, id): skills that document the file of a source or of one of its hits."""
    from ..operators.graph_joins import skills_for

    touched = hits.select("source", "node_id").union(hits.select("source", F.col("source").alias("node_id"))).distinct()
    paths = touched.join(nodes.select(F.col("id").alias("node_id"), "path"), "node_id").select("source", "path").distinct()
    return paths.join(skills_for(edges, nodes, paths), "path").select("source", "id").distinct()


def affected_tests(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(source, id): tests of a source or of one of its hits."""
    touched = hits.select("source", F.col("node_id").alias("from_id")).union(hits.select("source", F.col("source").alias("from_id"))).distinct()
    return touched.join(edges.filter("kind = 'tested_by'").select("from_id", F.col("to_id").alias("id")), "from_id").join(nodes.select("id"), "id", "left_semi").select("source", "id").distinct()


def context(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2, core_shown: int = 15, parts: tuple[str, ...] = CONTEXT) -> dict[str, DataFrame]:
    """What bears on a change of a node: hits, skills, conventions, tests, its bridge score and its cyclic core
    (the first members, with the core's size). parts: those that are wanted; the others aren't computed, of which the
    last two look at the whole graph."""
    from .betweenness import chokepoints
    from .components import core_of

    source = nodes.sparkSession.createDataFrame([(target,)], "id string")
    hits = materialize(impact(nodes, edges, source, depth), "context")
    make = {
        "hits": lambda: hits,
        "skills": lambda: affected_skills(nodes, edges, hits),
        "conventions": lambda: nodes.filter("kind = 'convention'").select("id").orderBy("id"),
        "tests": lambda: affected_tests(nodes, edges, hits),
        "bridge": lambda: chokepoints(edges, nodes).filter(F.col("id") == target),
        "core": lambda: core_of(edges, target).withColumn("size", F.count("*").over(Window.partitionBy("component"))).orderBy("id").limit(core_shown),
    }
    return {name: make[name]() for name in parts}
