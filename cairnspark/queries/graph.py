"""Queries over the trade tables as a dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adaptors import GRAPH_SQL, graph_edges, graph_files, graph_nodes, one_target, table
from ..functions import paths
from ..operators import graph_joins as gj
from ..operators import graph_tables as gt
from ..plans import betweenness, closures, components, flow, gaps, impact, louvain, resolve
from ..storage import materialize

G = f"WITH RECURSIVE {GRAPH_SQL}, dep AS (SELECT * FROM edges WHERE kind NOT IN ('contains', 'documents')) "
TARGET = "supplier:1"


def _graph(s, d):
    return graph_nodes(s, d), graph_edges(s, d)


def _impact(s, d, depth=2, direction="up", target=TARGET):
    n, e = _graph(s, d)
    return impact.impact(n, e, one_target(s, target), depth, direction)


def _reach(target: str, near: str, far: str, cap: int | None = 5000) -> str:
    """The first 5,000 nodes, or with no cap all, within two steps of a target and its file, in breadth-first order: by
    the order of the parent, then of the edge."""
    step = "SELECT e.{far} AS id, p.r AS o, e.from_id, e.to_id, e.kind FROM {at} p JOIN dep e ON e.{near} = p.id WHERE e.{far} IN (SELECT id FROM nodes) AND e.{far} NOT IN (SELECT id FROM seed)"
    first = "SELECT id, row_number() OVER (ORDER BY o, from_id, to_id, kind) AS r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, from_id, to_id, kind) AS n FROM ({step}) q) k WHERE n = 1"
    one, two = (step.format(near=near, far=far, at=at) for at in ("seed", "l1"))
    return (
        G
        + f""", seed(id, r) AS (SELECT '{target}', 0 UNION SELECT path, 1 FROM nodes WHERE id = '{target}' AND path <> '' AND path <> id AND path IN (SELECT id FROM nodes)),
l1 AS ({first.format(step=one)}), l2 AS ({first.format(step=two + f" AND e.{far} NOT IN (SELECT id FROM l1)")}),
hits AS (SELECT id, depth FROM (SELECT id, depth, row_number() OVER (ORDER BY depth, r) AS n FROM (SELECT id, r, 1 AS depth FROM l1 UNION ALL SELECT id, r, 2 FROM l2) b) c{f" WHERE n <= {cap}" if cap else ""})"""
    )


def _multi(s, d):
    n, e = _graph(s, d)
    return impact.impact(n, e, n.filter("kind = 'class' and id like 'supplier:%'").select("id"), 1).groupBy("source").agg(F.count("*").alias("n"))


def _capped(s, d):
    n, e = _graph(s, d)
    return impact.impact(n, e, one_target(s, TARGET), 1, "up", cap=50).select("node_id", "via", "confidence")


def _surprises(s, d):
    n, e = _graph(s, d)
    # Nations as files of their regions' packages: the edges between customers and suppliers cross domains.
    hits = impact.impact(n, e, one_target(s, TARGET), 2, cap=None)
    out = impact.surprises(n, e, graph_files(s, d), hits, 2, 0.25, 5)
    return out.select("from_id", "to_id", "from_domain", "to_domain", F.round("score", 6).alias("score"))


_DOMAIN = ", dom AS (SELECT n.id, CASE WHEN n.kind = 'external' THEN 'external' WHEN f.package IS NOT NULL THEN replace(f.package, '.', '/') WHEN n.path = '' THEN 'external' ELSE lower(array_to_string(list_slice(list_filter(string_split_regex(n.path, '[./]'), lambda x: x <> ''), 1, 2), '/')) END AS d FROM nodes n LEFT JOIN files f ON f.path = n.path)"
_CROSS = _DOMAIN + ", x AS (SELECT e.*, a.d AS fd, b.d AS td FROM dep e JOIN dom a ON a.id = e.from_id JOIN dom b ON b.id = e.to_id WHERE a.d <> b.d AND a.d <> 'external' AND b.d <> 'external'), sh AS (SELECT fd, td, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY fd) AS BIGINT) AS o FROM x GROUP BY fd, td)"


def _trimmed(levels: int) -> str:
    """Edges between nodes that both have edges in and out, trimmed so many times: what falls away is in no cycle."""
    out = ", c0 AS (SELECT DISTINCT from_id AS a, to_id AS b FROM dep WHERE from_id <> to_id)"
    for k in range(levels):
        out += f", c{k + 1} AS (SELECT a, b FROM c{k} WHERE a IN (SELECT b FROM c{k}) AND b IN (SELECT a FROM c{k}))"
    return out + f", c AS (SELECT a, b FROM c{levels})"


_MUTUAL = G + _trimmed(8) + ", reach(a, b) AS (SELECT a, b FROM c UNION SELECT r.a, c.b FROM reach r JOIN c ON c.a = r.b), mutual AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a), ids AS (SELECT from_id AS id FROM dep UNION SELECT to_id FROM dep), scc AS (SELECT i.id, coalesce(m.component, i.id) AS component FROM ids i LEFT JOIN mutual m ON m.id = i.id)"
#: Shortest paths are counted from the first hundred nodes and from all that these reach.
_BETWEEN = G + """, c AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'calls'), ids AS (SELECT from_id AS id FROM c UNION SELECT to_id FROM c), src AS (SELECT id FROM ids ORDER BY id LIMIT 100),
near(id) AS (SELECT id FROM src UNION SELECT c.to_id FROM near JOIN c ON c.from_id = near.id),
walk(s, v, d) AS (SELECT id, id, 0 FROM near UNION SELECT w.s, c.to_id, w.d + 1 FROM walk w JOIN c ON c.from_id = w.v WHERE w.d < 110), dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY s, v),
paths(s, v, d) AS (SELECT id, id, 0 FROM near UNION ALL SELECT p.s, x.v, x.d FROM paths p JOIN c ON c.from_id = p.v JOIN dist x ON x.s = p.s AND x.v = c.to_id AND x.d = p.d + 1), sig AS (SELECT s, v, d, count(*) AS n FROM paths GROUP BY s, v, d),
score AS (SELECT i.id, coalesce(q.score, 0) AS score FROM ids i LEFT JOIN (SELECT a.v AS id, sum(a.n * b.n / t.n) AS score FROM src JOIN sig a ON a.s = src.id JOIN sig b ON b.s = a.v JOIN sig t ON t.s = a.s AND t.v = b.v AND t.d = a.d + b.d WHERE a.v <> a.s AND b.v <> a.v GROUP BY a.v) q ON q.id = i.id)"""


def _closure(s, d):
    e = graph_edges(s, d)
    return closures.ancestors(e, table(s, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")))


_UP = G + ", ext AS (SELECT from_id, to_id FROM edges WHERE kind = 'extends'), anc(source, id, depth) AS (SELECT from_id, to_id, 1 FROM ext UNION ALL SELECT a.source, e.to_id, a.depth + 1 FROM anc a JOIN ext e ON e.from_id = a.id) "


def _traits(s, d):
    n, e = _graph(s, d)
    return closures.traits_by_type(n, e, n.filter("id like 'customer:%'").select("id"))


def _implementers(s, d):
    n, e = _graph(s, d)
    return closures.implementers(n, e, n.filter("id like 'supplier:%'").select("id")).select("interface", "id")


def _gap_rows(s, d):
    n, e = _graph(s, d)
    return gaps.untested_gaps(n, e).withColumn("score", F.round("score", 6))


_SPAN = "end_line - line + 1"
_GAPS = G + f""", t AS (SELECT from_id AS id FROM edges WHERE kind = 'tested_by' UNION SELECT k.to_id FROM edges k JOIN edges b ON b.from_id = k.from_id AND b.kind = 'tested_by' WHERE k.kind = 'contains' UNION SELECT c.to_id FROM edges c JOIN nodes n ON n.id = c.from_id AND n.kind = 'test' WHERE c.kind = 'calls'),
cand AS (SELECT id, path, {_SPAN} AS span FROM nodes WHERE kind = 'function' AND exported AND line <> 0 AND {_SPAN} >= 4 AND ({_SPAN} > 4 OR id IN (SELECT from_id FROM edges WHERE kind = 'calls')) AND id NOT IN (SELECT id FROM t)),
seed AS (SELECT id AS s, id FROM cand UNION SELECT c.id, n.id FROM cand c JOIN nodes n ON n.id = c.path),
l1 AS (SELECT DISTINCT s, from_id AS id FROM seed JOIN dep ON to_id = seed.id WHERE from_id IN (SELECT id FROM nodes)), l2 AS (SELECT DISTINCT s, from_id AS id FROM l1 JOIN dep ON to_id = l1.id WHERE from_id IN (SELECT id FROM nodes)),
blast AS (SELECT s, count(*) AS blast FROM (SELECT * FROM l1 UNION SELECT * FROM l2) h WHERE (s, id) NOT IN (SELECT (s, id) FROM seed) GROUP BY s),
fan AS (SELECT to_id, count(DISTINCT from_id) AS fan_in FROM edges WHERE kind = 'calls' GROUP BY 1)
SELECT c.id, coalesce(fan_in, 0) AS fan_in, least(coalesce(blast, 0), 5000) AS blast, span, CAST(-1 AS DOUBLE) AS covered, round((coalesce(fan_in, 0) + 1) * least(coalesce(blast, 0), 5000) * (1 + least(greatest(span, 0), 60) / 60.0::DOUBLE), 6) AS score FROM cand c LEFT JOIN blast ON s = c.id LEFT JOIN fan ON to_id = c.id"""


def _trees(s, d):
    """Trees of two steps from every function, of at most three callees a node."""
    n, e = _graph(s, d)
    return flow.call_trees(n, e, n.filter("kind = 'function'").select("id"), 2, 3)


#: The walk of an entry as a fold over its callees: those that it follows, each with what it follows in turn.
_TREES = G + """, c AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'calls' AND to_id IN (SELECT id FROM nodes)), l AS (SELECT from_id, list(to_id ORDER BY to_id) AS callees FROM c GROUP BY 1),
two AS (SELECT c.from_id AS entry, list({'id': c.to_id, 'next': coalesce(l.callees, [])} ORDER BY c.to_id) AS xs FROM c LEFT JOIN l ON l.from_id = c.to_id GROUP BY 1),
walk AS (SELECT n.id AS entry, list_reduce(coalesce(xs, []), lambda s, x: CASE WHEN s.stop OR list_contains(s.seen, x.id) THEN s WHEN s.taken >= 3 THEN {'seen': s.seen, 'hops': s.hops, 'taken': s.taken, 'stop': true, 'cut': true}
  ELSE {'seen': s.seen || [x.id] || list_filter(x.next, lambda y: y <> x.id AND NOT list_contains(s.seen, y))[:3],
    'hops': s.hops || [{'p': 0, 'd': 1, 'id': x.id}] || list_transform(list_filter(x.next, lambda y: y <> x.id AND NOT list_contains(s.seen, y))[:3], lambda y: {'p': CAST(len(s.hops) AS INT), 'd': 2, 'id': y}),
    'taken': s.taken + 1, 'stop': false, 'cut': s.cut OR len(list_filter(x.next, lambda y: y <> x.id AND NOT list_contains(s.seen, y))) > 3} END,
  {'seen': [n.id], 'hops': [{'p': -1, 'd': 0, 'id': n.id}], 'taken': 0, 'stop': false, 'cut': false}) AS s FROM nodes n LEFT JOIN two ON two.entry = n.id WHERE n.kind = 'function'),
hops AS (SELECT entry, s.cut AS truncated, CAST(unnest(range(len(s.hops))) AS INT) AS hop, unnest(s.hops) AS h FROM walk)
SELECT entry, hop, h.p AS parent_hop, h.d AS depth, h.id AS id, coalesce(h.p >= 0 AND regexp_replace(b.path, '/[^/]*$', '') <> regexp_replace(a.path, '/[^/]*$', ''), false) AS crosses, '' AS dispatch, truncated
FROM hops LEFT JOIN nodes a ON a.id = h.id LEFT JOIN (SELECT entry AS e, hop AS k, h.id AS caller FROM hops) u ON u.e = entry AND u.k = h.p LEFT JOIN nodes b ON b.id = u.caller"""


def _structure(s, d):
    n, e = _graph(s, d)
    return closures.test_structure(n, e, n.filter("id like 'supplier:%'").select("id")).select("target", "grouping", "siblings")


def _coupling_pairs(s, d):
    n, e = _graph(s, d)
    return gj.file_coupling(n, e)


def _communities(s, d):
    # Written once: pairs of files are few, and the nodes' ids and the edges are joined for them.
    w = materialize(_coupling_pairs(s, d), "coupling")
    files = w.select(F.col("a").alias("id")).union(w.select("b")).distinct()
    return louvain.louvain(files, w)


def _changes(s, d):
    known = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ns"), F.sha2("text", 256).alias("sha256"))
    now = known.filter("doc_id % 7 <> 0" if "doc_id" in known.columns else "mtime_ns % 7 <> 0")
    scanned = now.withColumns({"mtime_ns": F.when(F.col("mtime_ns") % 3 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")), "sha256": F.when(F.col("mtime_ns") % 5 == 0, F.lit("x")).otherwise(F.col("sha256"))})
    return gt.changes(known, scanned).groupBy("action").agg(F.count("*").alias("n"))


def _deleted_files(s, d):
    n, e = _graph(s, d)
    files = n.filter("kind = 'file'").select("path")
    refs = e.select("from_id", "kind", F.col("to_id").alias("name"))
    f, n2, r, e2 = gt.delete_files(files, n, refs, e, s.createDataFrame([("r1/n1",), ("m/Brand#11",)], "path string"))
    return f.agg(F.count("*").alias("files")).join(n2.agg(F.count("*").alias("nodes"))).join(r.agg(F.count("*").alias("refs"))).join(e2.agg(F.count("*").alias("edges")))


def _replaced(s, d):
    n, e = _graph(s, d)
    new = e.filter("kind = 'calls' and from_id like 'supplier:%'")
    n2, e2 = gt.replace_resolved(n, e, new, s.createDataFrame([("external::x.Y", "external", "x.Y")], "id string, kind string, name string"))
    return e2.groupBy("kind").agg(F.count("*").alias("n")).unionByName(n2.filter("kind = 'external'").groupBy("kind").agg(F.count("*").alias("n")))




def _code(s, d):
    """Suppliers as Java files of a class with a method each: names recur, packages are few."""
    k = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    path, name = F.concat(F.lit("src/s"), F.col("k").cast("string"), F.lit(".java")), F.concat(F.lit("S"), (F.col("k") % 40).cast("string"))
    method = F.concat(name, F.lit(".m"), (F.col("k") % 30).cast("string"))
    node = lambda kind, n: k.select(F.concat(path, F.lit("::"), n).alias("id"), F.lit(kind).alias("kind"), n.alias("name"), path.alias("path"), F.lit("").alias("return_type"))
    package = lambda x: F.concat(F.lit("p"), (x % 7).cast("string"))
    files = k.select(path.alias("path"), F.lit("java").alias("language"), package(F.col("k")).alias("package"), F.array(F.concat(package(F.col("k") * 3), F.lit(".*"))).alias("imports"))
    ref = lambda kind, n, to: k.select(F.concat(path, F.lit("::"), n).alias("from_id"), F.lit(kind).alias("kind"), to.alias("name"), F.lit(1).alias("line"), F.lit("").alias("recv"))
    refs = ref("extends", name, F.concat(F.lit("S"), ((F.col("k") + 1) % 40).cast("string"))).unionByName(ref("calls", method, F.concat(F.lit("m"), ((F.col("k") + 5) % 30).cast("string"))))
    return node("class", name).unionByName(node("function", method)), files, refs


def _resolved_imports(s, d):
    n, f, _ = _code(s, d)
    return resolve.import_edges(n, f)


def _resolved_classes(s, d):
    return resolve.resolve_classes(*_code(s, d))


def _resolved_calls(s, d):
    n, f, r = _code(s, d)
    return resolve.resolve_calls(n, f, r, s.createDataFrame([], "from_id string, to_id string"))


_CODE = "WITH c AS (SELECT s_suppkey AS k, 'src/s' || CAST(s_suppkey AS STRING) || '.java' AS path, 'S' || CAST(s_suppkey % 40 AS STRING) AS name, 'm' || CAST(s_suppkey % 30 AS STRING) AS m, 'p' || CAST(s_suppkey % 7 AS STRING) AS pkg, 'p' || CAST(s_suppkey * 3 % 7 AS STRING) AS imp, 'S' || CAST((s_suppkey + 1) % 40 AS STRING) AS up, 'm' || CAST((s_suppkey + 5) % 30 AS STRING) AS callee FROM supplier) "


QUERIES = {
    "impact": (lambda s, d: _impact(s, d).select("node_id", "depth"), _reach(TARGET, "to_id", "from_id") + "SELECT id AS node_id, CAST(depth AS INT) AS depth FROM hits"),
    "impact_down": (lambda s, d: _impact(s, d, 2, "down", "order:7").select("node_id", "depth"), _reach("order:7", "from_id", "to_id") + "SELECT id AS node_id, CAST(depth AS INT) AS depth FROM hits"),
    "impact_via": (
        lambda s, d: _impact(s, d, 1).select("node_id", "via", "confidence"),
        G + f", seed AS (SELECT '{TARGET}' AS id, 0 AS o UNION SELECT path, 1 FROM nodes WHERE id = '{TARGET}'), k AS (SELECT e.from_id AS node_id, e.kind AS via, e.confidence, row_number() OVER (PARTITION BY e.from_id ORDER BY o, e.from_id, e.to_id, e.kind) AS n FROM dep e JOIN seed ON e.to_id = seed.id WHERE e.from_id NOT IN (SELECT id FROM seed)) SELECT node_id, via, confidence FROM k WHERE n = 1",
    ),
    "impact_many": (_multi, G + ", seed AS (SELECT id AS s, id FROM nodes WHERE starts_with(id, 'supplier:') UNION SELECT id, path FROM nodes WHERE starts_with(id, 'supplier:')) SELECT s AS source, count(DISTINCT from_id) AS n FROM seed JOIN dep ON to_id = seed.id WHERE (s, from_id) NOT IN (SELECT (s, id) FROM seed) AND from_id IN (SELECT id FROM nodes) GROUP BY s"),
    "impact_capped": (
        _capped,
        G + f", k AS (SELECT from_id AS node_id, kind AS via, confidence, row_number() OVER (PARTITION BY from_id ORDER BY kind) AS n FROM dep WHERE to_id = '{TARGET}' AND from_id <> to_id) SELECT node_id, via, confidence FROM k WHERE n = 1 ORDER BY node_id LIMIT 50",
    ),
    "impact_subsystems": (
        lambda s, d: gj.by_subsystem(_impact(s, d).select(F.col("node_id").alias("id")).join(graph_nodes(s, d), "id"), graph_files(s, d)),
        _reach(TARGET, "to_id", "from_id") + "SELECT coalesce(f.package, CASE WHEN contains(n.path, '/') THEN regexp_replace(n.path, '/[^/]*$', '') END, '(root)') AS subsystem, count(*) AS n FROM hits JOIN nodes n USING (id) LEFT JOIN files f ON f.path = n.path GROUP BY 1",
    ),
    "impact_skills": (
        lambda s, d: impact.affected_skills(*_graph(s, d), _impact(s, d)).select("id"),
        _reach(TARGET, "to_id", "from_id") + f"SELECT DISTINCT e.from_id AS id FROM (SELECT id FROM hits UNION SELECT '{TARGET}') h JOIN nodes n USING (id) JOIN edges e ON e.kind = 'documents' AND e.to_id = n.path",
    ),
    "impact_tests": (
        lambda s, d: impact.affected_tests(*_graph(s, d), _impact(s, d)).select("id"),
        _reach(TARGET, "to_id", "from_id") + f"SELECT DISTINCT e.to_id AS id FROM (SELECT id FROM hits UNION SELECT '{TARGET}') h JOIN edges e ON e.kind = 'tested_by' AND e.from_id = h.id WHERE e.to_id IN (SELECT id FROM nodes)",
    ),
    "surprising_edges": (
        _surprises,
        _reach(TARGET, "to_id", "from_id", None) + _CROSS + f", ins AS (SELECT id FROM hits UNION SELECT '{TARGET}') SELECT DISTINCT x.from_id, x.to_id, x.fd AS from_domain, x.td AS to_domain, round(1 - n / o, 6) AS score FROM x JOIN sh ON sh.fd = x.fd AND sh.td = x.td WHERE o >= 5 AND n / o < 0.25 AND x.from_id IN (SELECT id FROM ins) AND x.to_id IN (SELECT id FROM ins)",
    ),
    "domain_shares": (
        lambda s, d: gj.domain_shares(graph_edges(s, d), gj.node_domains(graph_nodes(s, d), graph_files(s, d))).withColumn("share", F.round("share", 6)),
        G + _CROSS + " SELECT fd AS from_domain, td AS to_domain, n, o AS out, round(n / o, 6) AS share FROM sh",
    ),
    "strong_components": (lambda s, d: components.strong_components(graph_edges(s, d)), _MUTUAL + " SELECT id, component FROM scc"),
    "cycles": (lambda s, d: components.cycles(graph_edges(s, d)).select("component", "size"), _MUTUAL + " SELECT component, count(*) AS size FROM scc GROUP BY 1 HAVING count(*) > 1"),
    "cyclic_core": (lambda s, d: components.core_of(graph_edges(s, d), TARGET), _MUTUAL + f" SELECT id, component FROM scc WHERE component = (SELECT component FROM scc WHERE id = '{TARGET}') AND (SELECT count(*) FROM scc WHERE component = (SELECT component FROM scc WHERE id = '{TARGET}')) > 1"),
    "betweenness": (lambda s, d: betweenness.bridge_scores(graph_edges(s, d)).withColumn("score", F.round("score", 4)), _BETWEEN + " SELECT id, round(CAST(score AS DOUBLE), 4) AS score FROM score"),
    "top_bridges": (lambda s, d: betweenness.top_bridges(graph_edges(s, d), 10).withColumn("score", F.round("score", 4)), _BETWEEN + " SELECT id, round(CAST(score AS DOUBLE), 4) AS score FROM score WHERE score > 0 ORDER BY round(score, 6) DESC, id LIMIT 10"),
    "chokepoints": (lambda s, d: betweenness.chokepoints(graph_edges(s, d), graph_nodes(s, d)).select("id", "is_chokepoint"), _BETWEEN + ", pos AS (SELECT id, round(score, 6) AS score FROM score WHERE score > 0), ord AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM pos), cut AS (SELECT score AS least FROM ord WHERE k = greatest(0, least(n - 1, CAST(floor(n * 0.95) AS BIGINT)))) SELECT id, score >= least AS is_chokepoint FROM pos, cut"),
    "ancestors": (_closure, _UP + "SELECT source, id, CAST(min(depth) AS INT) AS depth FROM anc GROUP BY 1, 2"),
    "members": (lambda s, d: closures.members(graph_edges(s, d), graph_nodes(s, d).filter("kind = 'file'").select("id")), G + "SELECT DISTINCT from_id AS source, to_id AS id, 1 AS depth FROM edges WHERE kind = 'contains'"),
    "traits_of_types": (
        _traits,
        _UP + ", imp AS (SELECT from_id, to_id FROM edges WHERE kind = 'implements'), chain AS (SELECT id AS t, id AS h, 0 AS depth FROM nodes WHERE starts_with(id, 'customer:') UNION ALL SELECT source, id, depth FROM anc WHERE starts_with(source, 'customer:')), k AS (SELECT t, imp.to_id AS interface, depth, CASE WHEN depth = 0 THEN '' ELSE coalesce(n.name, '') END AS via, row_number() OVER (PARTITION BY t, imp.to_id ORDER BY depth, n.name) AS r FROM chain JOIN imp ON imp.from_id = h LEFT JOIN nodes n ON n.id = h) SELECT t AS type, interface, via FROM k WHERE r = 1 AND interface IN (SELECT id FROM nodes)",
    ),
    "implementers": (
        _implementers,
        _UP + ", imp AS (SELECT from_id, to_id FROM edges WHERE kind = 'implements') SELECT to_id AS interface, from_id AS id FROM imp WHERE starts_with(to_id, 'supplier:') AND from_id IN (SELECT id FROM nodes) UNION SELECT imp.to_id, anc.source FROM imp JOIN anc ON anc.id = imp.from_id WHERE starts_with(imp.to_id, 'supplier:') AND anc.source IN (SELECT id FROM nodes)",
    ),
    "test_structure": (
        _structure,
        G + "SELECT n.id AS target, CASE count(t.name) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'per-concern' END AS grouping, coalesce(string_agg(t.name, ', ' ORDER BY t.name), '') AS siblings FROM nodes n LEFT JOIN edges e ON e.kind = 'tested_by' AND e.from_id = n.id LEFT JOIN nodes t ON t.id = e.to_id WHERE starts_with(n.id, 'supplier:') GROUP BY n.id",
    ),
    "untested_gaps": (_gap_rows, _GAPS),
    "call_trees": (_trees, _TREES),
    "callers": (lambda s, d: gj.callers(*_graph(s, d), table(s, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))), G + "SELECT DISTINCT to_id AS target, from_id AS id FROM edges WHERE kind = 'calls' AND starts_with(to_id, 'supplier:') AND from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT 'supplier:' || CAST(s_suppkey AS STRING) FROM supplier)"),
    "callees": (lambda s, d: gj.callees(*_graph(s, d), table(s, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))), G + "SELECT DISTINCT from_id AS source, to_id AS id FROM edges WHERE kind = 'calls' AND starts_with(from_id, 'part:') AND to_id IN (SELECT id FROM nodes) AND from_id IN (SELECT 'part:' || CAST(p_partkey AS STRING) FROM part)"),
    "fan_in": (lambda s, d: gj.fan_in(graph_edges(s, d)), G + "SELECT to_id AS id, count(DISTINCT from_id) AS fan_in FROM edges WHERE kind = 'calls' GROUP BY 1"),
    "find_symbols": (lambda s, d: gj.find(graph_nodes(s, d), "0001").select("id", "name"), G + "SELECT id, name FROM nodes WHERE contains(lower(name), '0001')"),
    "resolve_target": (lambda s, d: gj.resolve_target(graph_nodes(s, d), "part:3"), "SELECT 'part:3' AS id, 'id' AS how"),
    "existing_nodes": (lambda s, d: gj.existing(graph_nodes(s, d), table(s, d, "part").select(F.concat(F.lit("part:"), (F.col("p_partkey") * 2).cast("string")).alias("id"))), "SELECT DISTINCT 'part:' || CAST(p_partkey * 2 AS STRING) AS id FROM part WHERE p_partkey * 2 IN (SELECT p_partkey FROM part)"),
    "node_count": (lambda s, d: graph_nodes(s, d).groupBy("kind").agg(F.count("*").alias("n")), G + "SELECT kind, count(*) AS n FROM nodes GROUP BY 1"),
    "non_trivial_functions": (
        lambda s, d: gj.not_trivial(graph_nodes(s, d).filter("kind = 'function'"), graph_edges(s, d)).select("id"),
        G + f"SELECT id FROM nodes WHERE kind = 'function' AND ({_SPAN} > 4 OR id IN (SELECT from_id FROM edges WHERE kind = 'calls'))",
    ),
    "file_coupling": (_coupling_pairs, G + "SELECT least(a.path, b.path) AS a, greatest(a.path, b.path) AS b, count(*) AS weight FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE e.kind IN ('imports', 'calls', 'extends', 'implements') AND a.path <> b.path AND a.path <> '' AND b.path <> '' GROUP BY 1, 2"),
    "file_communities": (_communities, None),
    "domain_edges": (
        lambda s, d: gj.domain_edges(_coupling_pairs(s, d).select(F.col("a").alias("from_id"), F.col("b").alias("to_id")), graph_nodes(s, d).select("path", paths.directory(F.col("path")).alias("domain")).distinct()),
        G + "SELECT DISTINCT regexp_replace(least(a.path, b.path), '/[^/]*$', '') AS from_domain, regexp_replace(greatest(a.path, b.path), '/[^/]*$', '') AS to_domain FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE e.kind IN ('imports', 'calls', 'extends', 'implements') AND a.path <> b.path AND a.path <> '' AND b.path <> '' AND regexp_replace(a.path, '/[^/]*$', '') <> regexp_replace(b.path, '/[^/]*$', '')",
    ),
    "primary_language": (lambda s, d: gj.primary_language(graph_nodes(s, d)), G + "SELECT language FROM nodes WHERE kind = 'function' GROUP BY 1 ORDER BY count(*) DESC, language LIMIT 1"),
    "domain_sizes": (lambda s, d: gj.domain_sizes(graph_files(s, d), graph_files(s, d).select("path", F.col("package").alias("domain"))), G + "SELECT package AS domain, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) // 3 AS BIGINT) AS tokens FROM files GROUP BY 1"),
    "class_methods": (lambda s, d: gj.class_methods(*_graph(s, d)), G + "SELECT from_id AS class_id, to_id AS id FROM edges JOIN nodes ON id = to_id WHERE edges.kind = 'contains' AND nodes.kind = 'function' AND exported"),
    "skills_for_files": (lambda s, d: gj.skills_for(graph_edges(s, d), graph_nodes(s, d), graph_files(s, d)), G + "SELECT to_id AS path, from_id AS id FROM edges WHERE kind = 'documents'"),
    "function_languages": (lambda s, d: graph_nodes(s, d).filter("kind = 'function'").groupBy("language").agg(F.count("*").alias("n")), G + "SELECT language, count(*) AS n FROM nodes WHERE kind = 'function' GROUP BY 1"),
    "incremental_changes": (_changes, "SELECT CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 3 <> 0 OR doc_id % 5 <> 0 THEN 'unchanged' ELSE 'parse' END AS action, count(*) AS n FROM documents GROUP BY 1"),
    "delete_files": (
        _deleted_files,
        G + ", gone AS (SELECT id FROM nodes WHERE path IN ('r1/n1', 'm/Brand#11')) SELECT (SELECT count(*) FROM nodes WHERE kind = 'file' AND path NOT IN ('r1/n1', 'm/Brand#11')) AS files, (SELECT count(*) FROM nodes WHERE path NOT IN ('r1/n1', 'm/Brand#11')) AS nodes, (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM gone)) AS refs, (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)) AS edges",
    ),
    "replace_resolved": (_replaced, G + "SELECT kind, count(*) AS n FROM edges WHERE kind IN ('contains', 'documents') OR (kind = 'calls' AND starts_with(from_id, 'supplier:')) GROUP BY 1 UNION ALL SELECT 'external', 1"),
    "graph_status": (
        lambda s, d: gt.status(graph_files(s, d).withColumn("status", F.when(F.col("size") % 3000 == 0, "failed").otherwise("ok")), *_graph(s, d)),
        G + "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE size % 3000 = 0) AS failed, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges",
    ),
    "resolve_imports": (_resolved_imports, _CODE + "SELECT DISTINCT a.path AS from_id, b.path AS to_id, 'imports' AS kind, 'exact' AS confidence FROM c a JOIN c b ON b.pkg = a.imp WHERE a.path <> b.path"),
    "resolve_inheritance": (
        _resolved_classes,
        _CODE
        + """, fq AS (SELECT pkg, name, min(path || '::' || name) AS id FROM c GROUP BY 1, 2), cand AS (SELECT k, fq.id, 2 AS rule FROM c JOIN fq ON fq.pkg = c.pkg AND fq.name = c.up UNION SELECT k, fq.id, 4 FROM c JOIN fq ON fq.pkg = c.imp AND fq.name = c.up UNION SELECT a.k, b.path || '::' || b.name, 5 FROM c a JOIN c b ON b.name = a.up),
best AS (SELECT *, min(rule) OVER (PARTITION BY k) AS top FROM cand), cnt AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM best WHERE rule = top)
SELECT c.path || '::' || c.name AS from_id, id AS to_id, 'extends' AS kind, CASE WHEN rule < 4 THEN 'exact' WHEN n = 1 THEN 'high' ELSE 'low' END AS confidence FROM cnt JOIN c USING (k) WHERE (rule < 5 OR n <= 5) AND id <> c.path || '::' || c.name""",
    ),
    "resolve_calls": (
        _resolved_calls,
        _CODE
        + """, cand AS (SELECT a.k, b.path || '::' || b.name || '.' || b.m AS id, CASE WHEN b.pkg = a.pkg OR b.pkg = a.imp THEN 1 ELSE 2 END AS seen FROM c a JOIN c b ON b.m = a.callee), r AS (SELECT k, id, 1 AS rule FROM cand WHERE seen = 1 UNION ALL SELECT k, id, 2 FROM cand),
best AS (SELECT *, min(rule) OVER (PARTITION BY k) AS top FROM r), cnt AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM best WHERE rule = top)
SELECT c.path || '::' || c.name || '.' || c.m AS from_id, id AS to_id, 'calls' AS kind, CASE WHEN n > 1 THEN 'low' WHEN rule = 1 THEN 'high' ELSE 'medium' END AS confidence FROM cnt JOIN c USING (k) WHERE n <= 5""",
    ),
}
