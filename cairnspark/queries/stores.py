"""Queries over stores, files in the shared folder, and what the other modules leave unasked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adaptors import LOG, LOG_SQL, NOTES_SQL, graph_edges, graph_files, graph_nodes, log, notes, table
from ..functions import paths, text
from ..operators import coverage as cov
from ..operators import graph_store
from ..operators import graph_joins as gj
from ..operators import graph_tables as gt
from ..operators import logs
from ..operators import notes as ops
from ..operators import rules, search
from ..plans import cards, closures, components, gaps, impact, resolve
from ..sources import chunks, files, reports, tables
from ..sources import logs as log_files
from ..storage import shared_dir
from .graph import _GAPS, TARGET, G, _graph, _reach
from .reports import _batch

_ID_SQL = "cast(substr(id, 5) as bigint)"  # no Column: modules are imported before there is a session
_K = "CAST(substr(id, 5) AS BIGINT)"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _one_of(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _pick(values: list[str], by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


# The graph store.


def _decoded(s, d):
    f = table(s, d, "nation").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit('["a.'), "n_name", F.lit('","b.*"]'))).alias("imports"))
    return tables.decoded_files(f).select("path", F.size("imports").alias("n"), F.array_join("imports", " ").alias("imports"))


def _metadata(s, d):
    m = table(s, d, "region").select(F.col("r_name").alias("key"), F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("value"))
    return tables.metadata_value(m, "ASIA").select("value", F.lit("ASIA").alias("key")).union(tables.metadata_value(m, "none").select("value", F.lit("none").alias("key")))


def _concepts(s, d):
    """Regions and one without files as concepts of their nations' files."""
    c = table(s, d, "region").select(F.col("r_name").alias("name")).union(s.range(1).select(F.lit("EMPTY")))
    f = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("concept"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("path"))
    return c, f


_CONCEPTS = "c AS (SELECT r_name AS name FROM region UNION ALL SELECT 'EMPTY'), cf AS (SELECT r_name AS concept, 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _concepts_with_files(s, d):
    return tables.concepts_with_files(*_concepts(s, d)).select("name", F.array_join("files", " ").alias("files"))


def _freshness(s, d):
    c, f = _concepts(s, d)
    k = F.regexp_extract("path", r"n(\d+)$", 1).cast("int")
    recorded = f.filter(k % 5 > 0).select("path", F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("h"), k)).alias("sha256"))
    current = f.select("path", F.when((k % 5 == 0) & (k < 15), "").when(k == 18, "changed").otherwise(F.concat(F.lit("h"), k)).alias("sha256"))
    return gt.concept_freshness(f, c, recorded, current)


_FRESH = f"""WITH {_CONCEPTS}, k AS (SELECT concept, path, CAST(regexp_extract(path, 'n([0-9]+)$', 1) AS INT) AS k FROM cf), h AS (SELECT concept, CASE WHEN k % 5 > 0 THEN 'h' || CAST(k AS STRING) ELSE '' END AS r, CASE WHEN k % 5 = 0 AND k < 15 THEN '' WHEN k = 18 THEN 'changed' ELSE 'h' || CAST(k AS STRING) END AS now FROM k), st AS (SELECT concept, bool_or(r <> now) AS stale FROM h GROUP BY 1)
SELECT name, CASE WHEN stale IS NULL THEN 'new' WHEN stale THEN 'stale' ELSE 'up-to-date' END AS status FROM c LEFT JOIN st ON concept = name"""


def _uncovered(s, d):
    c, f = _concepts(s, d)
    f = f.filter("concept <> 'ASIA'").withColumn("concept", F.when(F.col("concept") == "EUROPE", "architecture").otherwise(F.col("concept")))
    return gt.uncovered_files(graph_files(s, d).select("path"), c, f)


def _knowledge(s, d):
    n, e = _graph(s, d)
    new_n, new_e = gt.knowledge(_concepts(s, d)[1].filter("concept <> 'ASIA'"))
    n2, e2 = gt.replace_knowledge(n, e, new_n, new_e)
    return n2.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")).unionByName(e2.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("edges")))


def _upserted(s, d):
    known = graph_files(s, d).select("path", "size")
    new = known.filter("size % 2000 = 0").select("path", (F.col("size") + 1).alias("size")).unionByName(s.range(3).select(F.concat(F.lit("new"), "id").alias("path"), F.col("id").alias("size")))
    return gt.upsert_files(known, new)


def _concept_upsert(s, d):
    c = _concepts(s, d)[0].withColumn("description", F.lit("old"))
    new = c.filter("name < 'B'").withColumn("description", F.lit("new")).union(s.range(1).select(F.lit("MORE"), F.lit("new")))
    return gt.upsert_concepts(c, new)


def _concept_replace(s, d):
    c, f = _concepts(s, d)
    c2, f2 = gt.replace_concepts(c.filter("name > 'B'"), f.filter("concept > 'B'").union(s.createDataFrame([("lost", "x")], "concept string, path string")))
    return c2.join(f2.groupBy("concept").agg(F.count("*").alias("files")), F.col("name") == F.col("concept"), "left").select("name", F.coalesce("files", F.lit(0)).alias("files"))


def _replaced_files(s, d):
    """Parts of two brands parsed anew, each with a node and an edge less and one of another name."""
    n, e = _graph(s, d)
    gone = s.createDataFrame([("m/Brand#11",), ("m/Brand#12",)], "path string")
    own = n.join(gone, "path", "left_semi").filter("kind = 'function'")
    new = own.filter("line % 2 = 0").withColumn("ord", F.col("line").cast("long"))
    both = new.unionByName(new.withColumn("ord", F.col("ord") + 100).withColumn("name", F.lit("later")))
    contains = new.select(F.col("path").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("kind"), F.lit("exact").alias("confidence"), "ord")
    refs = e.filter("kind = 'calls'").select(F.concat(F.lit("m/Brand#11::"), "from_id").alias("from_id"), "kind", F.col("to_id").alias("name"))
    n2, r2, e2 = gt.replace_files(n, refs, e, gone, both, refs.limit(0).withColumn("ord", F.lit(0)), contains)
    return n2.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")).unionByName(e2.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("edges"))).unionByName(r2.agg(F.lit("refs").alias("kind"), F.count("*").alias("n"), F.lit("refs").alias("what"))).unionByName(n2.filter("name = 'later'").agg(F.lit("later").alias("kind"), F.count("*").alias("n"), F.lit("names").alias("what")))


def _stored_graph(s, d, change):
    """Number and names of nodes and edges by kind, after a change of a stored graph."""
    store = graph_store.create(graph_store.GraphStore(s, _folder(s, "graph"), 16), *_graph(s, d))
    change(s, store)
    n, e = (graph_store.table(store, x) for x in ("nodes", "edges"))
    count = lambda df, what, name: df.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length(name)).alias("letters")).withColumn("what", F.lit(what))
    return count(n, "nodes", "name").unionByName(count(e, "edges", "to_id")).unionByName(count(graph_store.table(store, "edges_in"), "edges_in", "from_id"))


def _brand_parsed_anew(s, store):
    """Of one brand's parts those of even size stay, under other names."""
    own = graph_store.table(store, "nodes").drop("part").filter("path = 'm/Brand#11'")
    new = own.filter("kind = 'file' or line % 2 = 0").withColumns({"name": F.concat(F.lit("new "), "id"), "ord": F.col("line").cast("long")})
    contains = new.filter("kind = 'function'").select(F.col("path").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("kind"), F.lit("exact").alias("confidence"), "ord")
    refs = graph_store.table(store, "refs").drop("part").limit(0)
    graph_store.replace_files(store, s.createDataFrame([("m/Brand#11",)], "path string"), new, refs, contains)


def _nation_deleted(s, store):
    graph_store.delete_files(store, s.createDataFrame([("r0/n0",), ("r1/n1",)], "path string"))


def _knowledge_replaced(s, store):
    n, e = (graph_store.table(store, x).drop("part") for x in ("nodes", "edges"))
    nodes = n.filter("kind = 'skill' and name < 'B'").withColumn("name", F.lit("renamed"))
    graph_store.put_changed(store, *gt.replace_knowledge(n, e, nodes, e.filter("kind = 'documents' and from_id < 'skill::B'")))


_IN_STORE = G + """, {changed}
SELECT 'nodes' AS what, kind, count(*) AS n, CAST(sum(length(name)) AS BIGINT) AS letters FROM n2 GROUP BY 2
UNION ALL SELECT 'edges', kind, count(*), CAST(sum(length(to_id)) AS BIGINT) FROM e2 GROUP BY 2 UNION ALL SELECT 'edges_in', kind, count(*), CAST(sum(length(from_id)) AS BIGINT) FROM e2 GROUP BY 2"""
_REPLACED_IN_STORE = _IN_STORE.format(changed="""stays AS (SELECT id FROM nodes WHERE path = 'm/Brand#11' AND (kind = 'file' OR line % 2 = 0)),
n2 AS (SELECT kind, CASE WHEN path = 'm/Brand#11' THEN 'new ' || id ELSE name END AS name FROM nodes WHERE path <> 'm/Brand#11' OR id IN (SELECT id FROM stays)),
e2 AS (SELECT * FROM edges WHERE kind <> 'contains' OR from_id <> 'm/Brand#11' OR to_id IN (SELECT id FROM stays))""")
_DELETED_IN_STORE = _IN_STORE.format(changed="""gone AS (SELECT id FROM nodes WHERE path IN ('r0/n0', 'r1/n1')), n2 AS (SELECT kind, name FROM nodes WHERE id NOT IN (SELECT id FROM gone)),
e2 AS (SELECT * FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone))""")
_KNOWN_IN_STORE = _IN_STORE.format(changed="""n2 AS (SELECT kind, CASE WHEN kind = 'skill' THEN 'renamed' ELSE name END AS name FROM nodes WHERE kind <> 'skill' OR name < 'B'),
e2 AS (SELECT * FROM edges WHERE kind <> 'documents' OR from_id < 'skill::B')""")


def _looked_up(s, d):
    """Callers of every part, by edges in buckets of their target."""
    n, e = _graph(s, d)
    up = graph_store.save_lookup(e, "up", 16)
    return gj.callers(n, up, n.filter("id like 'part:%'").select("id")).groupBy("target").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_LOOKED_UP = G + "SELECT to_id AS target, count(DISTINCT from_id) AS n, min(from_id) AS first FROM edges WHERE kind = 'calls' AND to_id LIKE 'part:%' AND from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes) GROUP BY 1"


# Targets, closures, tests.

TARGETS = ["part:3", "Supplier#000000001", "Supplier#000000009", "supplier#00000000", "nothing of it", "Brand#11", "BRAND#1", "INDIA", "order12"]


def _targets(s, d):
    n = graph_nodes(s, d)
    out = None
    for t in TARGETS:
        one = gj.resolve_target(n, t).select(F.lit(t).alias("target"), "id", "how")
        out = one if out is None else out.unionByName(one)
    return out


_TARGETS = G + ", t(target) AS (VALUES " + ", ".join(f"('{t}')" for t in TARGETS) + """), hit AS (SELECT target, id, kind, name FROM t JOIN nodes ON contains(lower(name), lower(target))), n AS (SELECT target, count(*) AS n FROM hit GROUP BY 1),
r AS (SELECT target, id, 0 AS rank FROM t JOIN nodes ON id = target UNION ALL SELECT target, id, 1 FROM hit JOIN n USING (target) WHERE n.n = 1 UNION ALL SELECT target, id, 2 FROM hit WHERE name = target AND kind = 'class' UNION ALL SELECT target, id, 3 FROM hit WHERE name = target)
SELECT target, id, ['id', 'single', 'class', 'name'][rank + 1] AS how FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank, id) AS k FROM r) q WHERE k = 1"""

_ANC = "anc(source, id, depth) AS (SELECT from_id, to_id, 1 FROM edges WHERE kind = 'extends' UNION ALL SELECT a.source, e.to_id, a.depth + 1 FROM anc a JOIN edges e ON e.from_id = a.id AND e.kind = 'extends')"


def _interfaces(s, d):
    n, e = _graph(s, d)
    return closures.other_implementers(e, closures.traits_by_type(n, e, n.filter("id like 'customer:%'").select("id")).select("type", "interface")).groupBy("type", "interface").agg(F.count("*").alias("others"))


def _methods(s, d):
    """Brands as interfaces with parts as their methods, and nations as types that implement them."""
    n, e = _graph(s, d)
    impl = graph_files(s, d).select(F.col("path").alias("from_id")).crossJoin(s.createDataFrame([("m/Brand#11",)], "to_id string")).select("from_id", "to_id", F.lit("implements").alias("kind"), F.lit("exact").alias("confidence"))
    more = e.unionByName(impl)
    traits = impl.select(F.col("from_id").alias("type"), F.col("to_id").alias("interface"))
    return closures.trait_methods(n, more, traits).groupBy("type", "interface").agg(F.count("*").alias("declared"), F.count_if(F.col("declared") == F.col("method")).alias("own"))


def _interface_methods(s, d):
    n, e = _graph(s, d)
    return closures.interface_methods(n, e, n.filter("kind = 'file'").select("id"))


def _containing(s, d):
    n, e = _graph(s, d)
    more = e.unionByName(table(s, d, "lineitem").select(F.concat(F.lit("supplier:"), "l_suppkey").alias("from_id"), F.concat(F.lit("order:"), "l_orderkey").alias("to_id"), F.lit("contains").alias("kind"), F.lit("exact").alias("confidence")).distinct())
    return closures.containing_class(n, more, n.filter("kind in ('function', 'class')").select("id"))


def _trait_impact(s, d):
    n, e = _graph(s, d)
    return closures.trait_impact(n, e, "supplier:2", 1)


def _context(s, d):
    n, e = _graph(s, d)
    ids = {"hits": F.col("node_id"), "skills": F.col("id"), "tests": F.col("id"), "conventions": F.col("id")}
    parts = impact.context(n, e, TARGET, parts=tuple(ids))
    out = None
    for name, column in ids.items():
        one = parts[name].select(F.lit(name).alias("part"), column.alias("id"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


def _deep_cap(s, d):
    n, e = _graph(s, d)
    return impact.impact(n, e, n.filter(F.col("id") == TARGET).select("id"), 2, cap=3000).select("node_id", "depth", "via")


def _landmarks(s, d):
    n, e = _graph(s, d)
    c = graph_files(s, d).select(F.col("package").alias("name"), "path")
    return cards.landmarks(n, e, c, 3).select("concept", "id", "fan_in", "entry", "rank")


_ANCHOR = G + """, up AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'contains'), ids AS (SELECT id FROM nodes UNION SELECT from_id FROM edges UNION SELECT to_id FROM edges), anchor AS (SELECT i.id, coalesce(u.from_id, i.id) AS a FROM ids i LEFT JOIN up u ON u.to_id = i.id),
own AS (SELECT n.id, n.name, f.package AS concept FROM nodes n JOIN files f ON f.path = n.path)"""


def _shared_traits(s, d):
    n, e = _graph(s, d)
    return cards.shared_traits(n, e, graph_files(s, d).select(F.col("package").alias("name"), "path"))


def _cards(s, d):
    """Nations as concepts with many landmarks: what a card keeps of them."""
    c = table(s, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("geo."), "n_name").alias("package"), F.lit("").alias("description"), F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 12 + 1), lambda i: F.concat(F.lit("mark "), i.cast("string"))).alias("landmarks"), F.array(F.lit("trait")).alias("traits"))
    return cards.render_cards(c).select("name", F.size(F.split("card", "\n- mark ")).alias("marks"), F.octet_length("card").alias("bytes"))


_CARD = "SELECT n_name AS name, CAST(2 + n_nationkey % 12 AS INT) AS marks, CAST(4 + 6 + length(n_name) + 1 + 13 + 4 + length(n_name) + 1 + 4 + 1 + 2 + length(n_name) + 2 + 4 + length(n_name) + 2 + 1 + 11 + list_sum(list_transform(range(1, CAST(n_nationkey % 12 + 2 AS BIGINT)), lambda i: 8 + length(CAST(i AS STRING)))) + 1 + 35 + 8 AS INT) AS bytes FROM nation"


def _budget(s, d):
    """Orders as targets with a body, call sites, callees and a skill of known lengths."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("target"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("m"))
    part = lambda kind, n, size: o.select("target", F.lit(kind).alias("kind"), F.lit(n).alias("ord"), F.repeat(F.lit("x"), size).alias("text"))
    rows = part("body", 0, F.col("m")).unionByName(part("call_site", 0, F.lit(60))).unionByName(part("call_site", 1, F.lit(20))).unionByName(part("callee", 0, F.lit(25))).unionByName(part("callee", 1, F.lit(1))).unionByName(part("skill", 0, F.lit(40)))
    return cards.context_within(rows, 100).select("target", "kind", "ord", F.length("text").alias("n"))


_BUDGET = """WITH o AS (SELECT CAST(o_orderkey AS STRING) AS target, CAST(o_orderkey % 50 + 1 AS INT) AS m FROM orders), a AS (SELECT *, CASE WHEN m + 60 <= 100 THEN 60 ELSE 0 END AS c0 FROM o), b AS (SELECT *, CASE WHEN m + c0 < 100 AND m + c0 + 20 <= 100 THEN 20 ELSE 0 END AS c1 FROM a),
c AS (SELECT *, CASE WHEN m + c0 + c1 + 25 <= 100 THEN 25 ELSE 0 END AS k0 FROM b), e AS (SELECT *, CASE WHEN k0 > 0 AND m + c0 + c1 + k0 + 1 <= 100 THEN 1 ELSE 0 END AS k1 FROM c), f AS (SELECT *, least(40, 100 - m - c0 - c1 - k0 - k1) AS s0 FROM e)
SELECT target, x.kind, CAST(x.ord AS INT) AS ord, CAST(x.n AS INT) AS n FROM f, LATERAL (VALUES ('body', 0, m), ('call_site', 0, c0), ('call_site', 1, c1), ('callee', 0, k0), ('callee', 1, k1), ('skill', 0, s0)) x(kind, ord, n) WHERE x.n > 0"""


def _java(s, d):
    """Suppliers as classes and tests of four forms of names, with methods that override and calls between them."""
    k = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = F.concat(F.lit("Own"), F.col("k").cast("string"))
    path = F.concat(F.lit("src/"), name, F.lit(".java"))
    test = F.when(F.col("k") % 4 == 0, F.concat(name, F.lit("Test"))).when(F.col("k") % 4 == 1, F.concat(F.lit("Test"), name)).when(F.col("k") % 4 == 2, F.concat(name, F.lit("WhenIdleTest"))).otherwise(F.concat(name, F.lit("ShapeIT")))
    test_path = F.concat(F.lit("test/"), test, F.lit(".java"))
    node = lambda kind, n, p: k.select(F.concat(p, F.lit("::"), n).alias("id"), F.lit(kind).alias("kind"), n.alias("name"), p.alias("path"), F.lit("").alias("return_type"))
    n = node("class", name, path).unionByName(node("test", test, test_path)).unionByName(node("function", F.concat(name, F.lit(".run")), path))
    f = k.select(path.alias("path"), F.lit("java").alias("language"), F.lit("").alias("package"), F.array().cast("array<string>").alias("imports"))
    f = f.unionByName(k.select(test_path.alias("path"), F.lit("java").alias("language"), F.lit("").alias("package"), F.array().cast("array<string>").alias("imports")))
    return k, n, f, path, test_path, name


def _tested_by(s, d):
    k, n, f, path, test_path, _ = _java(s, d)
    imports = k.filter("k % 4 = 2 and k % 8 = 2").select(test_path.alias("from_id"), path.alias("to_id"), F.lit("imports").alias("kind"), F.lit("exact").alias("confidence"))
    return resolve.test_edges(n, f, imports)


_TESTED = """WITH s AS (SELECT s_suppkey AS k, 'Own' || CAST(s_suppkey AS STRING) AS n FROM supplier), t AS (SELECT k, n, CASE k % 4 WHEN 0 THEN n || 'Test' WHEN 1 THEN 'Test' || n WHEN 2 THEN n || 'WhenIdleTest' ELSE n || 'ShapeIT' END AS t FROM s)
SELECT 'src/' || n || '.java::' || n AS from_id, 'test/' || t || '.java::' || t AS to_id, 'tested_by' AS kind, CASE WHEN k % 4 < 2 THEN 'high' ELSE 'medium' END AS confidence FROM t WHERE k % 4 < 2 OR k % 8 = 2"""


def _overrides(s, d):
    k, n, _, path, _, name = _java(s, d)
    up = F.concat(F.lit("Own"), (F.col("k") - 1).cast("string"))
    e = k.filter("k % 3 > 0").select(F.concat(path, F.lit("::"), name).alias("from_id"), F.concat(F.lit("src/"), up, F.lit(".java::"), up).alias("to_id"))
    return gj.overrides(n, e)


def _fragments(s, d):
    """Nations as fragments on region types that customers' operations spread."""
    node = lambda t, i, kind, name, on: t.select(i.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.lit("").alias("path"), on.alias("return_type"))
    r, n, c = table(s, d, "region"), table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = node(r, F.concat(F.lit("t::"), "r_name"), "graphql_type", F.col("r_name"), F.lit("")).unionByName(node(n, F.concat(F.lit("f::"), "n_name"), "graphql_fragment", F.col("n_name"), F.col("r_name")))
    refs = c.select(F.concat(F.lit("op::"), "c_custkey").alias("from_id"), F.lit("spreads").alias("kind"), F.col("n_name").alias("name"))
    return resolve.fragment_edges(nodes, refs)


_MATCH_TESTS = ["OrderServiceWhenEmpty", "OrderServiceX", "OrderServicer", "Order", "Orders", "OrderServiceXY", "Zed"]


def _prefixes(s, d):
    """Names of parts as names of tests, and the first one to three words of every other part as classes."""
    p = table(s, d, "part").select("p_partkey", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("base"), F.split(F.initcap("p_name"), " ").alias("w"))
    classes = p.filter("p_partkey % 2 = 0").select(F.array_join(F.slice("w", 1, (F.col("p_partkey") % 3 + 1).cast("int")), "").alias("name"))
    return gj.longest_prefix_class(p.select(F.concat("base", F.lit("Test")).alias("base")), classes)


_PREFIXES = """WITH p AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM part), b AS (SELECT DISTINCT array_to_string(w, '') || 'Test' AS base FROM p),
c AS (SELECT DISTINCT array_to_string(w[1:p_partkey % 3 + 1], '') AS name FROM p WHERE p_partkey % 2 = 0)
SELECT base, name FROM (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY length(name) DESC) AS k FROM b JOIN c ON starts_with(base, name) AND regexp_matches(base[length(name) + 1], '[A-Z]')) q WHERE k = 1"""


def _refs(s, d):
    """Calls as references by name, in order."""
    e = graph_edges(s, d).filter("kind = 'calls'")
    return tables.ordered_refs(e.select("from_id", "kind", F.col("to_id").alias("name"), F.length("to_id").alias("line"), F.lit("").alias("recv")))


def _domain_paths(s, d):
    n, e = _graph(s, d)
    out = None
    for r in ("AFRICA", "ASIA", "EUROPE"):
        one = gj.domain_files(n, e, r).select(F.lit(r).alias("domain"), "path")
        out = one if out is None else out.unionByName(one)
    return out


def _overview(s, d):
    """Brands as domains of their parts, as many as fit 400 bytes."""
    from ..plans import domains as dm

    p = table(s, d, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("made by "), "p_type").alias("description"), F.concat(F.lit("p/"), F.col("p_name")).alias("path")).groupBy("name", "path").agg(F.min("description").alias("description"))
    one = p.groupBy("name").agg(F.min("description").alias("description"))
    pairs = s.createDataFrame([("Brand#11", "Brand#12")], "from_domain string, to_domain string")
    return dm.overview(p.select("name", "path").join(one, "name"), pairs, 400)


_OVERVIEW = """WITH p AS (SELECT DISTINCT p_brand AS name, 'p/' || p_name AS path FROM part), o AS (SELECT p_brand AS name, min('made by ' || p_type) AS description FROM part GROUP BY 1),
k AS (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY length(path), path) AS n FROM p), r AS (SELECT o.name, description, string_agg(path, ', ' ORDER BY n) AS key_files FROM k JOIN o USING (name) WHERE n <= 3 GROUP BY 1, 2),
z AS (SELECT *, sum(strlen(name) + strlen(description) + strlen(key_files) + 20) OVER (ORDER BY name) AS run, row_number() OVER (ORDER BY name) AS n FROM r)
SELECT name, description, key_files FROM z WHERE run + 23 <= 400 OR n = 1"""


def _legacy_once(s, d):
    """Notes of the older store taken over twice; only the first time counts."""
    known = notes(s, d).select("id", "topic_key", "scope", "project", "title", "content", "type", "source", "revision", "created_at", "updated_at", "author", "sync_id", "imported", "deleted_at")
    old = table(s, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("old-"), "o_orderkey")).otherwise("").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("content"), F.lit("json").alias("source"), F.lit("2020-01-02 03:04:05").alias("created_at"))
    meta = s.createDataFrame([("version", "1")], "key string, value string")
    n, meta = ops.import_legacy(known, meta, old)
    n, meta = ops.import_legacy(n, meta, old)
    return n.groupBy("source", "scope", "revision", F.col("topic_key").isNull().alias("keyless")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).join(meta.filter("key = 'migrated_from_json'").select(F.col("value").alias("migrated")))


_LEGACY_ONCE = f"""WITH {NOTES_SQL}, n AS (SELECT source, scope, revision, id FROM notes UNION ALL SELECT 'json', 'project', 1, CASE WHEN o_orderkey % 2 = 0 THEN 'old-' ELSE 'new-' END || CAST(o_orderkey AS STRING) FROM orders)
SELECT source, scope, revision, false AS keyless, count(*) AS n, count(DISTINCT id) AS ids, 'true' AS migrated FROM n GROUP BY 1, 2, 3"""


def _write_each(rows: DataFrame, folder: str) -> None:
    """Each row (name, text) as a file of the folder, written by the tasks."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            for name, text in zip(b.column("name"), b.column("text")):  # a text at a time is turned into bytes
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows.select("name", "text").mapInArrow(run, "n long").collect()


def _found_reports(s, d):
    """A report a brand, those of some brands a second time: of what changed since the first ones, the newest of each
    name, and their cases."""
    import time

    root = _folder(s, "found")
    p = table(s, d, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".xml")).alias("name"), F.concat(F.lit('<testcase classname="P" name="'), "p_partkey", F.when(F.col("p_size") % 5 == 0, '"><failure/></testcase>').otherwise('"/>')).alias("case"), "p_size")
    report = lambda df: df.groupBy("name").agg(F.concat(F.lit("<testsuite>"), F.array_join(F.array_sort(F.collect_list("case")), ""), F.lit("</testsuite>")).alias("text"))
    _write_each(report(p.filter("p_size < 10")), f"{root}/old")
    time.sleep(0.1)
    since = time.time()
    time.sleep(0.1)
    _write_each(report(p.filter("p_size >= 10")), f"{root}/one")
    time.sleep(0.1)
    _write_each(report(p.filter("p_size >= 30 and name < 'Brand-3'")), f"{root}/two")
    fresh = reports.newest_by_name(reports.fresh_reports(s, f"{root}/*/*.xml", since, 0.0))
    cases = reports.junit(fresh.select(F.substring_index("path", "/", -1).alias("path"), "text"))
    return cases.groupBy("path", "status").agg(F.count("*").alias("n"))


_FOUND = """SELECT replace(p_brand, '#', '-') || '.xml' AS path, CASE WHEN p_size % 5 = 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS n FROM part WHERE p_size >= CASE WHEN p_brand < 'Brand#3' THEN 30 ELSE 10 END GROUP BY 1, 2"""


def _covered_gaps(s, d):
    """Gaps with a profile of most brands' files, lines of each third covered, and weights of some functions."""
    n, e = _graph(s, d)
    brands = table(s, d, "part").select("p_brand").distinct().filter("p_brand < 'Brand#5'")
    profile = brands.select(F.concat(F.lit("m/"), "p_brand").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("line")).withColumn("covered", F.col("line") % 3 == 0)
    weights = table(s, d, "part").filter("p_partkey % 7 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), (F.col("p_size") / 10.0).cast("double").alias("weight"))
    out = gaps.untested_gaps(n, e, profile=profile, criticality=weights)
    return out.withColumns({"covered": F.round("covered", 6), "score": F.round("score", 4)})


_COVERED = _GAPS[: _GAPS.index("cand AS (")] + f"""prof AS (SELECT 'm/' || p_brand AS file, k AS pos, k % 3 = 0 AS hit FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#5') b, range(1, 61) r(k)),
ratio AS (SELECT n.id, avg(CAST(hit AS DOUBLE)) AS ratio FROM nodes n JOIN prof ON file = n.path AND pos BETWEEN line AND end_line WHERE n.kind = 'function' GROUP BY 1),
cand AS (SELECT nodes.id, path, end_line - line + 1 AS span, ratio FROM nodes LEFT JOIN ratio USING (id) WHERE kind = 'function' AND exported AND line <> 0 AND end_line - line + 1 >= 4 AND (end_line - line + 1 > 4 OR nodes.id IN (SELECT from_id FROM edges WHERE kind = 'calls')) AND (ratio < 1 OR (ratio IS NULL AND nodes.id NOT IN (SELECT id FROM t)))),
seed AS (""" + _GAPS[_GAPS.index("seed AS (") + 9 : _GAPS.index("SELECT c.id, coalesce(fan_in, 0)")] + """SELECT c.id, coalesce(fan_in, 0) AS fan_in, least(coalesce(blast, 0), 5000) AS blast, span, round(coalesce(ratio, -1), 6) AS covered,
  round((1 - coalesce(ratio, 0)) * (coalesce(fan_in, 0) + 1) * least(coalesce(blast, 0), 5000) * CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS DOUBLE) / 10 ELSE 1 END * (1 + least(greatest(span, 0), 60) / 60.0::DOUBLE), 4) AS score
FROM cand c LEFT JOIN blast ON s = c.id LEFT JOIN fan ON to_id = c.id LEFT JOIN part ON 'part:' || CAST(p_partkey AS STRING) = c.id"""


def _externals(s, d):
    """Classes that extend imported ones that no file has: stubs for these."""
    k = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    path, name = F.concat(F.lit("src/e"), F.col("k").cast("string"), F.lit(".java")), F.concat(F.lit("E"), F.col("k").cast("string"))
    n = k.select(F.concat(path, F.lit("::"), name).alias("id"), F.lit("class").alias("kind"), name.alias("name"), path.alias("path"), F.lit("").alias("return_type"))
    f = k.select(path.alias("path"), F.lit("java").alias("language"), F.lit("").alias("package"), F.array(F.concat(F.lit("lib.p"), (F.col("k") % 5).cast("string"), F.lit(".Base"))).alias("imports"))
    r = k.select(F.concat(path, F.lit("::"), name).alias("from_id"), F.lit("extends").alias("kind"), F.lit("Base").alias("name"), F.lit(1).alias("line"), F.lit("").alias("recv"))
    edges, outside = resolve.resolve(n, f, r)
    return outside.select("id", "kind", "name").join(edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n")), "id")


_TEST_PATHS = ["a/b_test.go", "a/test_x.py", "x_test.py", "src/A.java", "src/ATest.java", "w/x.test.ts", "w/__tests__/y.tsx", "w/y.ts", "test_data/z.go", "w/x.spec.tsx", "my_test.python", "src/Tests.java"]


def _test_paths(s, d):
    p = _one_of(_TEST_PATHS, "doc_id")
    return table(s, d, "documents").groupBy(p.alias("path")).agg(F.count("*").alias("n")).select("path", "n", paths.is_test_path(F.col("path")).alias("test_path"), paths.is_test_file(F.col("path")).alias("test_file"), F.array_join(paths.test_sources(F.col("path")), ",").alias("sources"))


_TEST_SQL = f"""SELECT path, n, ends_with(path, '_test.go') OR ends_with(path, '_test.py') OR (ends_with(path, '.py') AND starts_with(b, 'test_')) OR (regexp_matches(path, '[.]tsx?$') AND (contains(b, '.test.') OR contains(b, '.spec.') OR contains(path, '__tests__/'))) AS test_path,
  starts_with(b, 'test_') OR regexp_matches(b, '(_test[.]go|_test[.]py|[.]test[.]ts|[.]spec[.]ts|Tests?[.]java)$') AS test_file,
  CASE path WHEN 'w/x.test.ts' THEN 'w/x.ts' WHEN 'w/__tests__/y.tsx' THEN 'w/y.tsx' WHEN 'w/x.spec.tsx' THEN 'w/x.tsx' ELSE '' END AS sources
FROM (SELECT {_pick(_TEST_PATHS, "doc_id")} AS path, regexp_extract({_pick(_TEST_PATHS, "doc_id")}, '([^/]*)$', 1) AS b, count(*) AS n FROM documents GROUP BY 1, 2)"""


def _logger_calls(s, d):
    r = table(s, d, "lineitem").select(F.lit("calls").alias("kind"), _one_of(["info", "save", "warn", "trace", "find"], "l_partkey").alias("name"), _one_of(["Log", "logger", "x", None], "l_suppkey").alias("recv"))
    return gj.without_logger_calls(r).groupBy("name", "recv").agg(F.count("*").alias("n"))


def _boundary(s, d):
    n, e = _graph(s, d)
    f = graph_files(s, d)
    c = gj.file_coupling(n, e).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    return gj.boundary(c, f.select("path", F.col("package").alias("domain")))


def _core(s, d):
    """Regions that trade with each other: of customers' and suppliers' nations."""
    l, o, c, n = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))  # noqa: E741
    su = table(s, d, "supplier")
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(su, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("n"), "c_nationkey").alias("from_domain"), F.concat(F.lit("n"), "s_nationkey").alias("to_domain")).filter("from_domain <> to_domain").distinct()
    return components.largest_core(e)


_CORE = """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || CAST(c_nationkey AS STRING) AS a, 'n' || CAST(s_nationkey AS STRING) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS c FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a), z AS (SELECT c, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT id FROM m WHERE c = (SELECT c FROM z ORDER BY n DESC, c LIMIT 1)"""


# Files in the shared folder.


def _log_file(s, d):
    """The log written as JSON lines, with lines that are no entries, and read back."""
    folder = _folder(s, "log")
    entries = log(s, d).select(*[c for c in LOG if c != "ord"])
    lines = entries.select(F.to_json(F.struct(*entries.columns)).alias("value")).union(s.createDataFrame([("",), ("{broken",), ("[1]",), ("12",)], "value string"))
    lines.write.text(folder)
    return log_files.read_log(s, folder).groupBy("event", "provider").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


_LOG_FILE = f"WITH {LOG_SQL} SELECT event, provider, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, round(sum(cost_usd), 4) AS cost_usd FROM log GROUP BY 1, 2"


def _log_streamed(s, d):
    """The usage report over the log as a stream of JSON-line files."""
    from ..streaming import logs as streams

    folder, name = _folder(s, "stream"), f"usage_{uuid.uuid4().hex}"
    log(s, d).select("event", "provider", "input_tokens", "output_tokens", "latency_ms", "cost_usd").repartition(4).write.json(folder)
    query = streams.usage_stream(streams.log_stream(s, folder, 2)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", _folder(s, "stream-state")).start()
    query.awaitTermination()
    return s.table(name).select("provider", "calls", "input_tokens", "output_tokens", "latency_ms")


_STREAMED = f"WITH {LOG_SQL} SELECT provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM log WHERE event = '' GROUP BY 1"


def _chunk_files(s, d):
    """The chunks of two authors written, the first one twice, and all chunks read back."""
    folder, n = _folder(s, "chunks"), notes(s, d)
    wrote = [ops.write_chunk(ops.export_records(n, a), folder, a) for a in ("a1", "A 2!", "a1")]
    read = chunks.read_chunks(s, folder).groupBy("author").agg(F.count("*").alias("n"), F.sum("revision").alias("revisions"), F.count_distinct(F.md5("content")).alias("texts"))
    return read.withColumn("written", F.lit(sum(wrote)))


_CHUNK_FILES = f"WITH {NOTES_SQL}, a(a) AS (VALUES ('a1'), ('A 2!')) SELECT a AS author, count(*) AS n, CAST(sum(revision) AS BIGINT) AS revisions, count(DISTINCT md5(content)) AS texts, 2 AS written FROM notes JOIN a ON author IN ('', a) WHERE deleted_at IS NULL AND scope <> 'personal' GROUP BY 1"


#: Notes of a file of the older store.
LEGACY_NOTES = 500


def _legacy(s, d):
    """An older store a file for some hundred notes: a file is read by one task, and its array is held."""
    folder = _folder(s, "legacy")
    one = F.struct("id", F.col("topic_key").alias("topic"), F.col("content").alias("content"), F.when(F.expr(_ID_SQL) % 2 == 0, F.col("source")).alias("source"))
    stores = notes(s, d).groupBy(F.floor(F.expr(_ID_SQL) / LEGACY_NOTES).alias("k")).agg(F.to_json(F.collect_list(one)).alias("text"))
    _write_each(stores.select(F.concat(F.lit("store-"), F.coalesce("k", F.lit(-1)), F.lit(".json")).alias("name"), "text"), folder)
    return chunks.read_legacy(s, folder).select("id", "topic", F.md5("content").alias("m"), "source")


def _listing(s, d):
    """Files of brands below folders, some of which are no sources."""
    root = _folder(s, "sources")
    p = table(s, d, "part").select(_one_of(["src/a", "src/b", "testdata", ".git", "src/fixtures", "lib"], "p_size").alias("at"), "p_name").repartition(1)
    for at in ("src/a", "src/b", "testdata", ".git", "src/fixtures", "lib"):
        p.filter(F.col("at") == at).select("p_name").coalesce(1).write.text(f"{root}/{at}")
    found = files.list_sources(s, root, [".txt"], excludes=["lib"])
    return found.groupBy(paths.directory(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


_LISTING = f"SELECT folder, count(DISTINCT folder) AS files, CAST(sum(length(p_name) + 1) AS BIGINT) AS bytes FROM (SELECT {_pick(['src/a', 'src/b', 'testdata', '.git', 'src/fixtures', 'lib'], 'p_size')} AS folder, p_name FROM part) WHERE folder IN ('src/a', 'src/b') GROUP BY 1"


# Notes.


def _folded(s, d):
    """Saves of documents in order, fifty keys: a save of the same text changes nothing."""
    x = table(s, d, "documents").select(F.concat(F.lit("k/"), (F.col("doc_id") % 50).cast("string")).alias("topic_key"), F.lit("project").alias("scope"), F.lit("").alias("project"), F.lit("t").alias("title"), F.concat(F.lit("c"), (F.floor(F.col("doc_id") / 150) % 4).cast("string")).alias("content"), F.when(F.col("doc_id") % 7 == 0, "decision").otherwise("").alias("type"), F.lit("s").alias("source"), F.lit("me").alias("author"), F.col("doc_id").alias("ord"), F.lit("2024-01-01").cast("timestamp").alias("saved_at"))
    return ops.fold_saves(x).select("topic_key", "content", "revision")


_FOLDED = "SELECT topic_key, max_by(c, doc_id) AS content, CAST(1 + count(*) FILTER (p IS NOT NULL AND p <> c) AS INT) AS revision FROM (SELECT 'k/' || CAST(doc_id % 50 AS STRING) AS topic_key, doc_id, 'c' || CAST(doc_id // 150 % 4 AS STRING) AS c, lag('c' || CAST(doc_id // 150 % 4 AS STRING)) OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS p FROM documents) GROUP BY 1"


def _keyless(s, d):
    n = notes(s, d)
    more = ops.append_keyless(n, n.filter(F.expr(_ID_SQL) % 5 == 0).drop("id").withColumn("topic_key", F.lit("")))
    return more.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("topic_key") == '').alias("keyless"))


def _drift(s, d):
    n = notes(s, d)
    return search.index_drifted(search.build_index(n), n).select(F.lit("whole").alias("index"), "drifted").union(search.index_drifted(search.build_index(n.filter(F.expr(_ID_SQL) > 9)), n).select(F.lit("part"), "drifted"))


def _pieces(s, d):
    """Small functions of texts."""
    t = table(s, d, "documents").select("doc_id", F.col("text").alias("t"), F.col("source").alias("src"))
    return t.select("doc_id", F.md5(text.search_terms(F.concat(F.col("src"), F.lit(' "a" b')))).alias("terms"), text.truncate_bytes(F.col("t"), 21).alias("cut"), text.quantise(F.col("doc_id") / 7919).alias("weight"), text.strip_test_suffix(_one_of(["ATest", "Tests", "BIT", "Cs", "XTestsIT"], "doc_id")).alias("bare"), text.parse_time(_one_of(["2024-02-03 04:05:06", "bad", ""], "doc_id"), F.lit("2000-01-01 00:00:00").cast("timestamp")).cast("string").alias("at"))


_PIECES = """SELECT doc_id, md5('"' || source || '" OR \"""a""\" OR "b"') AS terms, (SELECT max(left(t, k)) FROM range(0, 22) x(k) WHERE strlen(left(t, k)) <= 21) AS cut, CAST(round(doc_id / 7919 * 10000) AS INT) AS weight,
  ['A', NULL, 'B', NULL, 'XTests'][doc_id % 5 + 1] AS bare, ['2024-02-03 04:05:06', '2000-01-01 00:00:00', '2000-01-01 00:00:00'][doc_id % 3 + 1] AS at FROM (SELECT *, text AS t FROM documents)"""


def _state(s, d):
    """Alert state as text and back."""
    st = table(s, d, "region").select(F.col("r_name").alias("rule_id"), (F.col("r_regionkey") * 3).cast("long").alias("last_shown"), (F.col("r_regionkey") % 2 == 0).alias("dismissed"))
    return rules.read_state(rules.write_state(st))


# Reports.


def _mutation_texts(s, d):
    l = table(s, d, "lineitem")  # noqa: E741
    py = F.concat(F.lit("    pkg.m"), F.col("l_partkey") % 7, F.lit(".f__mutmut_"), F.col("l_linenumber"), F.lit(": "), F.when(F.col("l_quantity") > 20, "killed").otherwise("survived"))
    xml = F.concat(F.lit('<mutation detected="'), (F.col("l_quantity") > 30).cast("string"), F.lit('" status="X"><sourceFile>P'), F.col("l_partkey") % 7, F.lit(".java</sourceFile><lineNumber>"), F.col("l_linenumber"), F.lit("</lineNumber><description>d</description></mutation>"))
    g = l.groupBy((F.col("l_suppkey") % 9).cast("string").alias("path"), _batch("l_orderkey", 5_000)).agg(F.array_join(F.collect_list(py), "\n").alias("py"), F.array_join(F.collect_list(xml), "").alias("xml"), F.count_if(F.col("l_quantity") > 40).alias("p"), F.count_if(F.col("l_quantity") <= 40).alias("f"))
    return g.select("path", "py", F.concat(F.lit("<?xml version='1.0'?><mutations>"), "xml", F.lit("</mutations>")).alias("xml"), F.concat(F.lit("noise\nThe mutation score is 0.5 ("), "p", F.lit(" passed, "), "f", F.lit(" failed, 0 duplicated, 0 skipped, total is "), F.col("p") + F.col("f"), F.lit(")")).alias("go"))


def _engines(s, d):
    t = _mutation_texts(s, d)
    score = lambda m: cov.mutation_score(m, "path").select("path", "total", "killed")
    py, java = score(reports.python_mutants(t, column="py")).withColumn("tool", F.lit("python")), score(reports.java_mutants(t, column="xml")).withColumn("tool", F.lit("java"))
    go = reports.go_mutation_summary(t, column="go").groupBy("path").agg(F.sum("total").alias("total"), F.sum("killed").alias("killed")).withColumn("tool", F.lit("go"))
    return py.unionByName(java).unionByName(go)


_ENGINES = "SELECT CAST(l_suppkey % 9 AS STRING) AS path, count(*) AS total, count(*) FILTER (CASE tool WHEN 'python' THEN l_quantity > 20 WHEN 'java' THEN l_quantity > 30 ELSE l_quantity <= 40 END) AS killed, tool FROM lineitem, (VALUES ('python'), ('java'), ('go')) t(tool) GROUP BY 1, 4"


def _nested_junit(s, d):
    """Cases in suites nested one to nine deep, with quoted brackets, comments and character data."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("g"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("deep"))
    mark = F.when(F.col("o_orderkey") % 5 == 0, "<failure message='a &lt; b'><![CDATA[<testcase name=\"no\"/>]]></failure>").when(F.col("o_orderkey") % 7 == 0, "<skipped/>").otherwise("<!-- <failure/> --><system-out>x</system-out>")
    case = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("<testcase classname='C>1' name=\"t"), "o_orderkey", F.lit('"/>'))).otherwise(F.concat(F.lit("<testcase classname='C>1' name=\"t"), "o_orderkey", F.lit('">'), mark, F.lit("</testcase>")))
    nested = F.concat(F.repeat(F.lit("<testsuite name='s'>"), F.col("deep")), case, F.repeat(F.lit("</testsuite>"), F.col("deep")))
    t = o.groupBy(F.col("g").cast("string").alias("path"), _batch("o_orderkey", 50_000)).agg(F.concat(F.lit("<testsuites>"), F.array_join(F.collect_list(nested), "\n"), F.lit("</testsuites>")).alias("text"))
    return reports.junit(t).groupBy("path", "class", "status").agg(F.count("*").alias("n"))


_NESTED = "SELECT CAST(o_custkey % 30 AS STRING) AS path, 'C>1' AS class, CASE WHEN o_orderkey % 11 = 0 THEN 'pass' WHEN o_orderkey % 5 = 0 THEN 'fail' WHEN o_orderkey % 7 = 0 THEN 'skipped' ELSE 'pass' END AS status, count(*) AS n FROM orders GROUP BY 1, 2, 3"


def _red(s, d):
    o = table(s, d, "orders")
    c = o.select(F.concat(F.lit("org.x.T"), (F.col("o_custkey") % 50).cast("string")).alias("class"), F.lit("t").alias("name"), F.when(F.col("o_custkey") % 50 < 5, "pass").otherwise("fail").alias("status"))
    new = s.range(0, 60).select(F.concat(F.lit("test/org/x/T"), F.col("id").cast("string"), F.lit(".java")).alias("file"))
    return cov.red_gate(c, new, False).select(F.lit("failing").alias("suite"), "ok", "green").union(cov.red_gate(c, new, True).select(F.lit("passing"), "ok", "green"))


_RED = "SELECT 'failing' AS suite, count(*) = 0 AS ok, coalesce(string_agg(f, ', ' ORDER BY f), '') AS green FROM (SELECT DISTINCT 'test/org/x/T' || CAST(o_custkey % 50 AS STRING) || '.java' AS f FROM orders WHERE o_custkey % 50 < 5) UNION ALL SELECT 'passing', false, ''"


def _pending(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("feature"), F.when(F.col("o_orderkey") < 40, "pass").when(F.col("o_orderstatus") == "F", "blocked").otherwise("pending").alias("status"), F.col("o_orderkey").alias("ord"))
    return cov.next_pending(o).select(F.lit("some").alias("of"), "feature", "resumable").union(cov.next_pending(o.filter("status <> 'pending'")).select(F.lit("none"), "feature", "resumable"))


_PENDING = "SELECT 'some' AS of, CAST(min(o_orderkey) AS STRING) AS feature, true AS resumable FROM orders WHERE o_orderkey >= 40 AND o_orderstatus <> 'F' UNION ALL SELECT 'none', '', false"


def _matter(s, d):
    """Documents as skill files: a block in front, a provenance line and a marked range."""
    k = F.col("doc_id").cast("string")
    t = table(s, d, "documents").select(k.alias("path"), F.concat(F.lit("---\nname: n"), k, F.lit('\ndescription: "d '), k, F.lit('"\n---\nbody\n<!-- made: source-hash=ab'), F.col("doc_id") % 10, F.lit(" label=l-"), k, F.lit(" -->\n"), F.repeat(F.lit("x\n"), (F.col("doc_id") % 5).cast("int")), F.lit("<!-- open -->\ny\n<!-- close -->\n<!-- close -->\n")).alias("text"))
    m = files.marker_range(t, "path", "<!-- open -->", "<!-- close -->")
    return files.provenance(files.front_matter(t), "made:").select("path", "name", "description", "source_hash", "label").join(m, "path")


_MATTER = "SELECT CAST(doc_id AS STRING) AS path, 'n' || CAST(doc_id AS STRING) AS name, 'd ' || CAST(doc_id AS STRING) AS description, 'ab' || CAST(doc_id % 10 AS STRING) AS source_hash, 'l-' || CAST(doc_id AS STRING) AS label, CAST(7 + doc_id % 5 AS INT) AS start_line, CAST(9 + doc_id % 5 AS INT) AS end_line FROM documents"


def _transcripts(s, d):
    """Conversations as transcript lines of JSON messages with content blocks."""
    block = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"type":"tool_use","id":"t'), "turn", F.lit('","name":"look","input":{"a":1}}'))).otherwise(F.concat(F.lit('{"type":"tool_result","tool_use_id":"t'), F.col("turn") - 1, F.lit('","is_error":true}')))
    lines = table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("line"), F.concat(F.lit('{"message":{"content":[{"type":"text","text":"x"},'), block, F.lit("]}}")).alias("text"))
    return files.transcript_steps(lines).groupBy("session", "kind").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.min("id").alias("first"))


_TRANSCRIPT = "SELECT conv_id AS session, kind, count(*) AS n, count(*) FILTER (kind = 'tool_result') AS errors, min(CASE kind WHEN 'tool_use' THEN 't' || CAST(turn AS STRING) WHEN 'tool_result' THEN 't' || CAST(turn - 1 AS STRING) END) AS first FROM conversations, (VALUES ('text'), ('tool_use'), ('tool_result')) k(kind) WHERE kind = 'text' OR (turn % 2 = 0) = (kind = 'tool_use') GROUP BY 1, 2"

QUERIES = {
    "store_replace": (lambda s, d: _stored_graph(s, d, _brand_parsed_anew), _REPLACED_IN_STORE),
    "store_delete": (lambda s, d: _stored_graph(s, d, _nation_deleted), _DELETED_IN_STORE),
    "store_knowledge": (lambda s, d: _stored_graph(s, d, _knowledge_replaced), _KNOWN_IN_STORE),
    "bucket_lookup": (_looked_up, _LOOKED_UP),
    "scan_nodes": (lambda s, d: tables.ordered_nodes(graph_nodes(s, d)).select("id", "kind", "name", "path"), G + "SELECT id, kind, name, path FROM nodes"),
    "scan_edges": (lambda s, d: tables.ordered_edges(tables.dependency_edges(graph_edges(s, d))).select("from_id", "to_id", "kind"), G + "SELECT from_id, to_id, kind FROM dep"),
    "scan_files": (_decoded, "SELECT n_name AS path, CAST(CASE WHEN n_nationkey % 3 > 0 THEN 2 ELSE 0 END AS INT) AS n, CASE WHEN n_nationkey % 3 > 0 THEN 'a.' || n_name || ' b.*' ELSE '' END AS imports FROM nation"),
    "metadata_values": (_metadata, "SELECT coalesce(max(CASE WHEN r_name = 'ASIA' THEN 'v' || CAST(r_regionkey AS STRING) END), '') AS value, 'ASIA' AS key FROM region UNION ALL SELECT '', 'none'"),
    "concepts_with_files": (_concepts_with_files, f"WITH {_CONCEPTS} SELECT name, coalesce((SELECT string_agg(path, ' ' ORDER BY path) FROM cf WHERE concept = name), '') AS files FROM c"),
    "concept_freshness": (_freshness, _FRESH),
    "uncovered_files": (_uncovered, G + "SELECT path FROM files WHERE path NOT IN (SELECT 'r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE'))"),
    "knowledge_layer": (
        _knowledge,
        G + f", {_CONCEPTS} SELECT kind, count(*) AS n, 'nodes' AS what FROM (SELECT kind FROM nodes WHERE kind <> 'skill' UNION ALL SELECT DISTINCT 'skill' || left(concept, 0) FROM cf WHERE concept = 'x' UNION ALL SELECT 'skill' FROM (SELECT DISTINCT concept FROM cf WHERE concept <> 'ASIA')) GROUP BY 1 UNION ALL SELECT kind, count(*), 'edges' FROM (SELECT kind FROM edges WHERE kind <> 'documents' UNION ALL SELECT 'documents' FROM cf WHERE concept <> 'ASIA') GROUP BY 1",
    ),
    "upsert_files": (_upserted, G + "SELECT path, CAST(CASE WHEN size % 2000 = 0 THEN size + 1 ELSE size END AS BIGINT) AS size FROM files UNION ALL SELECT 'new' || CAST(i AS STRING), i FROM range(3) r(i)"),
    "upsert_concepts": (_concept_upsert, f"WITH {_CONCEPTS} SELECT name, CASE WHEN name < 'B' THEN 'new' ELSE 'old' END AS description FROM c UNION ALL SELECT 'MORE', 'new'"),
    "replace_concepts": (_concept_replace, f"WITH {_CONCEPTS} SELECT name, count(path) AS files FROM c LEFT JOIN cf ON concept = name WHERE name > 'B' GROUP BY 1"),
    "replace_files": (
        _replaced_files,
        G + """, own AS (SELECT * FROM nodes WHERE path IN ('m/Brand#11', 'm/Brand#12')), new AS (SELECT * FROM own WHERE kind = 'function' AND line % 2 = 0)
SELECT kind, count(*) AS n, 'nodes' AS what FROM (SELECT kind FROM nodes WHERE path NOT IN ('m/Brand#11', 'm/Brand#12') UNION ALL SELECT kind FROM new) GROUP BY 1 UNION ALL SELECT kind, count(*), 'edges' FROM (SELECT kind FROM edges WHERE kind <> 'contains' OR from_id NOT IN ('m/Brand#11', 'm/Brand#12') UNION ALL SELECT 'contains' FROM new) GROUP BY 1 UNION ALL SELECT 'refs', 0, 'refs' UNION ALL SELECT 'later', 0, 'names'""",
    ),
    "resolve_targets": (_targets, _TARGETS),
    "other_implementers": (
        _interfaces,
        G + f", {_ANC}, chain AS (SELECT id AS t, id AS h FROM nodes WHERE starts_with(id, 'customer:') UNION ALL SELECT source, id FROM anc WHERE starts_with(source, 'customer:')), imp AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'implements'), tr AS (SELECT DISTINCT t, to_id AS i FROM chain JOIN imp ON from_id = h WHERE to_id IN (SELECT id FROM nodes) AND t IN (SELECT id FROM nodes)) SELECT t AS type, i AS interface, count(*) AS others FROM tr JOIN imp ON to_id = i WHERE (t, from_id) NOT IN (SELECT (t, h) FROM chain) GROUP BY 1, 2",
    ),
    "trait_methods": (_methods, G + "SELECT path AS type, 'm/Brand#11' AS interface, (SELECT count(*) FROM nodes WHERE path = 'm/Brand#11' AND kind = 'function') AS declared, (SELECT count(*) FROM nodes WHERE path = 'm/Brand#11' AND kind = 'function') AS own FROM files"),
    "interface_methods": (_interface_methods, G + "SELECT DISTINCT from_id AS interface, to_id AS method FROM edges JOIN nodes f ON f.id = from_id AND f.kind = 'file' JOIN nodes m ON m.id = to_id AND m.kind = 'function' WHERE edges.kind = 'contains'"),
    "containing_classes": (_containing, G + "SELECT id AS target, id AS class_id FROM nodes WHERE kind = 'class' UNION ALL SELECT 'order:' || CAST(l_orderkey AS STRING), min('supplier:' || CAST(l_suppkey AS STRING)) FROM lineitem WHERE l_orderkey % 301 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY l_orderkey"),
    "trait_impact": (
        _trait_impact,
        G + f", {_ANC}, impl AS (SELECT DISTINCT from_id AS id FROM edges WHERE kind = 'implements' AND to_id = 'supplier:2' AND from_id IN (SELECT id FROM nodes)), subs AS (SELECT id FROM impl UNION SELECT source FROM anc JOIN impl ON impl.id = anc.id), seed AS (SELECT 'supplier:2' AS id UNION SELECT path FROM nodes WHERE id = 'supplier:2') SELECT DISTINCT from_id AS id FROM dep JOIN seed ON to_id = seed.id WHERE from_id IN (SELECT id FROM nodes) AND from_id NOT IN (SELECT id FROM seed) AND from_id NOT IN (SELECT id FROM subs)",
    ),
    "context": (
        _context,
        _reach(TARGET, "to_id", "from_id") + f""", touched AS (SELECT id FROM hits UNION SELECT '{TARGET}'), parts AS (SELECT 'hits' AS part, id FROM hits UNION ALL SELECT DISTINCT 'skills', e.from_id FROM touched JOIN nodes n USING (id) JOIN edges e ON e.kind = 'documents' AND e.to_id = n.path UNION ALL SELECT DISTINCT 'tests', e.to_id FROM touched h JOIN edges e ON e.kind = 'tested_by' AND e.from_id = h.id WHERE e.to_id IN (SELECT id FROM nodes))
SELECT part, count(*) AS n, min(id) AS least, max(id) AS most FROM parts GROUP BY 1""",
    ),
    "impact_in_order": (
        _deep_cap,
        _reach(TARGET, "to_id", "from_id").replace("n <= 5000", "n <= 3000").replace("SELECT id, row_number() OVER (ORDER BY o, from_id, to_id, kind) AS r FROM", "SELECT id, kind AS via, row_number() OVER (ORDER BY o, from_id, to_id, kind) AS r FROM").replace("hits AS (SELECT id, depth FROM (SELECT id, depth,", "hits AS (SELECT id, depth, via FROM (SELECT id, depth, via,").replace("SELECT id, r, 1 AS depth FROM l1 UNION ALL SELECT id, r, 2 FROM l2", "SELECT id, r, via, 1 AS depth FROM l1 UNION ALL SELECT id, r, via, 2 FROM l2")
        + "SELECT id AS node_id, CAST(depth AS INT) AS depth, via FROM hits",
    ),
    "top_gaps": (lambda s, d: gaps.untested_gaps(*_graph(s, d), top=40).select("id", "fan_in", "blast", "span"), f"SELECT id, fan_in, blast, span FROM ({_GAPS}) g ORDER BY (fan_in + 1) * blast * (1 + least(greatest(span, 0), 60) / 60.0::DOUBLE) DESC, id LIMIT 40"),
    "landmarks": (
        _landmarks,
        _ANCHOR + """, u AS (SELECT f.a AS f, t.a AS t FROM edges e JOIN anchor f ON f.id = e.from_id JOIN anchor t ON t.id = e.to_id WHERE e.kind IN ('calls', 'extends', 'implements') AND f.a <> t.a), i AS (SELECT u.t AS id, count(*) AS n, bool_or(tc.concept IS NOT NULL AND fc.concept IS DISTINCT FROM tc.concept) AS x FROM u LEFT JOIN own fc ON fc.id = u.f LEFT JOIN own tc ON tc.id = u.t GROUP BY 1),
r AS (SELECT concept, own.id, coalesce(n, 0) AS fan_in, coalesce(x, false) AS entry, row_number() OVER (PARTITION BY concept ORDER BY coalesce(n, 0) DESC, name, own.id) AS rank FROM own JOIN anchor ON anchor.id = own.id AND anchor.a = own.id LEFT JOIN i ON i.id = own.id) SELECT concept, id, fan_in, entry, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""",
    ),
    "shared_traits": (
        _shared_traits,
        _ANCHOR + """, impl AS (SELECT DISTINCT e.to_id AS id, a.a AS impl FROM edges e JOIN anchor a ON a.id = e.from_id WHERE e.kind = 'implements' AND a.a <> e.to_id), pl AS (SELECT impl.id, n.name, o.concept FROM impl LEFT JOIN nodes n ON n.id = impl.impl LEFT JOIN own o ON o.id = impl.impl), x AS (SELECT DISTINCT i.concept, i.id, p.name FROM (SELECT DISTINCT id, concept FROM pl WHERE concept IS NOT NULL) i JOIN pl p ON p.id = i.id WHERE p.name IS NOT NULL AND p.concept IS DISTINCT FROM i.concept),
k AS (SELECT *, row_number() OVER (PARTITION BY concept, id ORDER BY name) AS k FROM x) SELECT concept, k.id, n.name, string_agg(k.name, ', ' ORDER BY k.name) AS others FROM k JOIN nodes n ON n.id = k.id WHERE k <= 6 GROUP BY 1, 2, 3""",
    ),
    "concept_cards": (_cards, _CARD),
    "context_budgets": (_budget, _BUDGET),
    "tested_by": (_tested_by, _TESTED),
    "overrides": (
        _overrides,
        "WITH s AS (SELECT s_suppkey AS k, 'Own' || CAST(s_suppkey AS STRING) AS n, 'Own' || CAST(s_suppkey - 1 AS STRING) AS u FROM supplier) SELECT 'src/' || n || '.java::' || n || '.run' AS from_id, 'src/' || u || '.java::' || u || '.run' AS to_id FROM s WHERE k % 3 > 0 AND k - 1 IN (SELECT s_suppkey FROM supplier)",
    ),
    "fragment_edges": (
        _fragments,
        "SELECT 'op::' || CAST(c_custkey AS STRING) AS from_id, 'f::' || n_name AS to_id, 'spreads' AS kind, 'exact' AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'f::' || n_name, 't::' || r_name, 'on_type', 'exact' FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "longest_prefix_classes": (_prefixes, _PREFIXES),
    "scan_refs": (_refs, G + "SELECT from_id, kind, to_id AS name, CAST(length(to_id) AS INT) AS line, '' AS recv FROM edges WHERE kind = 'calls'"),
    "domain_paths": (_domain_paths, G + "SELECT DISTINCT n.name AS domain, e.to_id AS path FROM nodes n JOIN edges e ON e.from_id = n.id AND e.kind = 'documents' WHERE n.kind = 'skill' AND n.name IN ('AFRICA', 'ASIA', 'EUROPE')"),
    "overview": (_overview, _OVERVIEW),
    "legacy_once": (_legacy_once, _LEGACY_ONCE),
    "found_reports": (_found_reports, _FOUND),
    "covered_gaps": (_covered_gaps, _COVERED),
    "external_stubs": (_externals, "SELECT 'external::lib.p' || CAST(s_suppkey % 5 AS STRING) || '.Base' AS id, 'external' AS kind, 'lib.p' || CAST(s_suppkey % 5 AS STRING) || '.Base' AS name, count(*) AS n FROM supplier GROUP BY 1, 2, 3"),
    "test_paths": (_test_paths, _TEST_SQL),
    "logger_calls": (
        _logger_calls,
        f"SELECT name, recv, count(*) AS n FROM (SELECT {_pick(['info', 'save', 'warn', 'trace', 'find'], 'l_partkey')} AS name, ['Log', 'logger', 'x', NULL][l_suppkey % 4 + 1] AS recv FROM lineitem) WHERE NOT (name IN ('info', 'warn', 'trace') AND coalesce(recv, '') IN ('Log', 'logger')) GROUP BY 1, 2",
    ),
    "domain_boundaries": (
        _boundary,
        G + ", p AS (SELECT DISTINCT a.path AS x, b.path AS y FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE e.kind IN ('imports', 'calls', 'extends', 'implements') AND a.path <> b.path AND a.path <> '' AND b.path <> ''), d AS (SELECT DISTINCT f.package AS x, t.package AS y FROM p JOIN files f ON f.path = least(p.x, p.y) JOIN files t ON t.path = greatest(p.x, p.y) WHERE f.package <> t.package) SELECT x AS domain, 'out' AS direction, y AS other FROM d UNION ALL SELECT y, 'in', x FROM d",
    ),
    "largest_core": (_core, _CORE),
    "log_file": (_log_file, _LOG_FILE),
    "log_stream": (_log_streamed, _STREAMED),
    "chunk_files": (_chunk_files, _CHUNK_FILES),
    "legacy_notes": (_legacy, f"WITH {NOTES_SQL} SELECT id, topic_key AS topic, md5(content) AS m, CASE WHEN {_K} % 2 = 0 THEN source ELSE '' END AS source FROM notes"),
    "source_listing": (_listing, _LISTING),
    "folded_saves": (_folded, _FOLDED),
    "notes_keyless": (_keyless, "SELECT count(*) + count(*) FILTER (doc_id % 5 = 0) AS n, count(*) + count(*) FILTER (doc_id % 5 = 0) AS ids, count(*) FILTER (doc_id % 5 = 0) AS keyless FROM documents"),
    "index_drift": (_drift, "SELECT 'whole' AS index, false AS drifted UNION ALL SELECT 'part', true"),
    "text_pieces": (_pieces, _PIECES),
    "alert_state": (_state, "SELECT r_name AS rule_id, CAST(r_regionkey * 3 AS BIGINT) AS last_shown, r_regionkey % 2 = 0 AS dismissed FROM region"),
    "mutation_engines": (_engines, _ENGINES),
    "nested_suites": (_nested_junit, _NESTED),
    "red_gate": (_red, _RED),
    "next_pending": (_pending, _PENDING),
    "skill_files": (_matter, _MATTER),
    "transcript_steps": (_transcripts, _TRANSCRIPT),
}
