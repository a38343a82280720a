"""Graph operators on small hand-made graphs."""

import random

import pytest

from cairnspark.model import EDGES, FILES, NODES, REFS
from cairnspark.operators import graph_joins, graph_tables
from cairnspark.plans import betweenness, closures, components, flow, gaps, impact, louvain, resolve


def graph(spark, nodes, edges):
    """nodes: id -> changed fields; edges: (from, to, kind[, confidence])."""
    base = {"kind": "function", "name": None, "path": "", "line": 1, "end_line": 10, "language": "go", "params": "", "return_type": "", "exported": True}
    rows = [tuple(({"id": i} | base | {"name": i} | f)[c] for c in NODES.names) for i, f in nodes.items()]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(*e, "exact")[:4] for e in edges], EDGES)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


CLASS = {"kind": "class"}


def test_impact_reaches_in_two_steps_and_never_the_target(spark):
    n, e = graph(spark, {"A": CLASS, "B": CLASS, "C": CLASS, "T": {"kind": "test"}, "X": CLASS}, [("B", "A", "extends"), ("C", "B", "calls"), ("A", "T", "tested_by"), ("A", "B", "contains"), ("gone", "A", "calls"), ("X", "C", "calls")])
    got = pairs(impact.impact(n, e, ids(spark, "A"), 2), "node_id", "depth", "via")
    assert got == {("B", 1, "extends"), ("C", 2, "calls")}
    assert pairs(impact.impact(n, e, ids(spark, "A"), 1, "down"), "node_id") == {("T",)}
    assert not impact.impact(n, e, ids(spark, "A"), 0).count()


def test_impact_starts_from_the_file_too_and_caps_in_order(spark):
    n, e = graph(spark, {"f": {"kind": "file", "path": "f"}, "f::A": {"path": "f"}, "g": {"kind": "file", "path": "g"}, "a": {}, "b": {}}, [("g", "f", "imports"), ("b", "f::A", "calls"), ("a", "f::A", "calls")])
    got = impact.impact(n, e, ids(spark, "f::A"), 1)
    assert pairs(got, "node_id", "via") == {("g", "imports"), ("a", "calls"), ("b", "calls")}
    assert pairs(impact.impact(n, e, ids(spark, "f::A"), 1, cap=2), "node_id") == {("a",), ("b",)}
    assert impact.truncated(got, 2).first()["truncated"]


def test_first_edge_in_order_names_the_route(spark):
    n, e = graph(spark, {x: {} for x in "tpqz"}, [("q", "t", "calls", "low"), ("p", "t", "calls", "high"), ("z", "q", "calls", "low"), ("z", "p", "extends", "high")])
    got = {r["node_id"]: (r["via"], r["confidence"]) for r in impact.impact(n, e, ids(spark, "t"), 2).collect()}
    assert got["z"] == ("extends", "high")  # through p, which comes before q


def test_surprises_are_rare_domain_pairs(spark):
    nodes = {f"a{i}": {"path": "a/x/f"} for i in range(20)} | {"b": {"path": "b/x/f"}, "c": {"path": "c/x/f"}}
    edges = [(f"a{i}", "b", "calls") for i in range(19)] + [("a19", "c", "calls")]
    n, e = graph(spark, nodes, edges)
    files = spark.createDataFrame([], FILES)
    hits = impact.impact(n, e, ids(spark, "c"), 2)
    got = impact.surprises(n, e, files, hits).collect()
    assert [(r["from_id"], r["to_id"], round(r["score"], 2)) for r in got] == [("a19", "c", 0.95)]


def mutual(edges):
    nodes = {x for e in edges for x in e[:2]}
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b, *_ in edges:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    return {v: min(w for w in nodes if w in reach[v] and v in reach[w]) for v in nodes}


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_are_mutual_reachability(spark, local):
    r = random.Random(5)
    edges = [(f"n{r.randrange(12):02}", f"n{r.randrange(12):02}", "calls") for _ in range(16)]
    _, e = graph(spark, {}, edges)
    got = dict(pairs(components.strong_components(e, local_edges=local), "id", "component"))
    assert got == mutual(edges)


def brandes(edges, samples):
    """Dependencies by the text-book algorithm, one source at a time."""
    below = {}
    for a, b in set(edges):
        below.setdefault(a, []).append(b)
    ids_ = sorted({x for e in edges for x in e})
    score = dict.fromkeys(ids_, 0.0)
    for s in ids_[:samples]:
        dist, paths, order, delta = {s: 0}, {s: 1}, [s], {}
        for v in order:
            for w in below.get(v, ()):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        for v in reversed(order):
            delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in below.get(v, ()) if dist[w] == dist[v] + 1)
            score[v] += delta[v] if v != s else 0
    return {k: round(v, 6) for k, v in score.items()}


@pytest.mark.parametrize("task_edges", [1_000_000, 0])
def test_betweenness_equals_brandes_on_random_graphs(spark, task_edges):
    r = random.Random(8)
    calls = [(f"n{r.randrange(70):02}", f"n{r.randrange(70):02}") for _ in range(160)] + [(f"n{i:02}", f"z{i}") for i in range(9)] + [(f"z{i}", f"z{i + 1}") for i in range(6)]
    _, e = graph(spark, {}, [(a, b, "calls") for a, b in calls])
    got = {k: round(v, 6) for k, v in pairs(betweenness.bridge_scores(e, 7, task_edges), "id", "score")}
    assert got == brandes(calls, 7) and sum(v > 0 for v in got.values()) > 20


def test_betweenness_of_a_path_and_of_both_ways(spark):
    _, e = graph(spark, {}, [("A", "B", "calls"), ("B", "C", "calls"), ("A", "C", "imports")])
    assert dict(pairs(betweenness.bridge_scores(e), "id", "score")) == {"A": 0.0, "B": 1.0, "C": 0.0}
    r = random.Random(3)
    _, e = graph(spark, {}, [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", "calls") for _ in range(20)])
    a = {k: round(v, 6) for k, v in pairs(betweenness.bridge_scores(e, 5), "id", "score")}
    b = {k: round(v, 6) for k, v in pairs(betweenness.bridge_scores(e, 5, task_edges=0), "id", "score")}
    assert a == b and any(a.values())


def test_traits(spark):
    nodes = {x: CLASS | {"name": x.lower()} for x in ("I", "J", "Base", "Impl", "Other")} | {"I.m": {"name": "I.m"}, "Base.m": {"name": "Base.m"}}
    n, e = graph(spark, nodes, [("Impl", "Base", "extends"), ("Base", "I", "implements"), ("I", "J", "extends"), ("Other", "I", "implements"), ("I", "I.m", "contains"), ("Base", "Base.m", "contains"), ("user", "I.m", "calls")])
    t = closures.traits_by_type(n, e, ids(spark, "Impl"))
    assert pairs(t, "interface", "via") == {("I", "base"), ("J", "i")}
    assert pairs(closures.trait_methods(n, e, t), "declared", "method") == {("I.m", "Base.m")}
    assert pairs(closures.other_implementers(e, t), "interface", "id") == {("I", "Other")}
    assert pairs(closures.implementers(n, e, ids(spark, "I")), "id", "via") == {("Base", ""), ("Other", ""), ("Impl", "base")}
    assert pairs(closures.interface_methods(n, e, ids(spark, "I")), "method") == {("I.m",)}


def test_test_structure(spark):
    n, e = graph(spark, {"C": CLASS, "C.m": {}, "T1": {"kind": "test"}, "T2": {"kind": "test"}, "B": CLASS}, [("C", "C.m", "contains"), ("C", "T1", "tested_by"), ("C", "T2", "tested_by"), ("T1", "B", "extends"), ("T2", "B", "extends")])
    assert closures.test_structure(n, e, ids(spark, "C.m", "B")).orderBy("target").collect() == [("B", "none", "", ""), ("C.m", "per-concern", "T1, T2", "B")]


def test_gaps_keep_what_matters(spark):
    nodes = {
        "Pay": {"end_line": 30}, "Refund": {"end_line": 20}, "Short": {"end_line": 3}, "Setter": {"end_line": 4}, "Four": {"end_line": 4}, "hidden": {"exported": False}, "Done": {}, "InClass": {}, "K": CLASS, "T": {"kind": "test"}, "c1": {"exported": False}, "c2": {"exported": False}, "inTest": {"path": "x_test.go"},
    }
    n, e = graph(spark, nodes, [("c1", "Pay", "calls"), ("c2", "Pay", "calls"), ("c1", "Refund", "calls"), ("c1", "Four", "calls"), ("Four", "ext", "calls"), ("Done", "T", "tested_by"), ("K", "InClass", "contains"), ("K", "T", "tested_by"), ("c1", "Setter", "calls")])
    got = gaps.untested_gaps(n, e).collect()
    assert [r["id"] for r in got] == ["Pay", "Refund", "Four"]
    assert got[0]["fan_in"] == 2 and got[0]["blast"] == 2 and got[0]["score"] == 3 * 2 * 1.5
    profile = spark.createDataFrame([("p", 1, True)], "file string, line int, covered boolean")
    assert {r["id"] for r in gaps.untested_gaps(n, e, profile=profile).collect()} == {"Pay", "Refund", "Four"}


def test_call_tree_is_depth_first_with_one_visited_set(spark):
    n, e = graph(spark, {"a": {"path": "x/a"}, "b": {"path": "x/b"}, "c": {"path": "y/c"}, "I": CLASS, "I.m": {"name": "I.m"}, "K": CLASS, "K.m": {"name": "K.m"}}, [("a", "b", "calls"), ("a", "c", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "I.m", "calls"), ("I", "I.m", "contains"), ("K", "K.m", "contains"), ("K", "I", "implements")])
    got = flow.call_trees(n, e, ids(spark, "a")).orderBy("hop").collect()
    assert [(r["hop"], r["parent_hop"], r["id"], r["crosses"], r["dispatch"]) for r in got] == [(0, -1, "a", False, ""), (1, 0, "b", False, ""), (2, 1, "c", True, ""), (3, 2, "I.m", True, "K.m")]
    cut = flow.call_trees(n, e, ids(spark, "a"), 5, 1).collect()
    assert all(r["truncated"] for r in cut) or len(cut) == 4


def test_louvain(spark):
    tri = [(0, 1, 5), (1, 2, 5), (0, 2, 5), (3, 4, 5), (4, 5, 5), (3, 5, 5), (2, 3, 1)]
    assert louvain.communities(7, tri) == [0, 0, 0, 3, 3, 3, 6]
    assert louvain.communities(7, [(b, a, w) for a, b, w in reversed(tri)]) == [0, 0, 0, 3, 3, 3, 6]
    nodes = spark.range(7)
    e = spark.createDataFrame(tri, "a long, b long, weight long")
    got = dict(pairs(louvain.louvain(nodes, e), "id", "community"))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_parts_are_clustered_as_the_whole(spark):
    r = random.Random(11)
    edges = [(k * 10 + r.randrange(10), k * 10 + r.randrange(10), 1 + r.randrange(9)) for k in range(3) for _ in range(14)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    whole = louvain.communities(30, edges)
    got = dict(pairs(louvain.louvain(spark.range(30), spark.createDataFrame(edges, "a long, b long, weight long")), "id", "community"))
    assert [got[i] for i in range(30)] == whole


@pytest.mark.parametrize("seed, names", [(1, int), (2, lambda i: f"n{i:03}")])
def test_large_parts_go_in_blocks_with_the_sequential_result(spark, seed, names):
    r = random.Random(seed)
    n = 60
    # Groups of ten with many inner edges and a part of its own that fits a task.
    drawn = [(a, b, 1 + r.randrange(9)) for a in range(n) for b in range(a) if r.random() < (0.5 if a // 10 == b // 10 else 0.03)] + [(n + i, n + i + 1, 2) for i in range(4)]
    want = louvain.communities(n + 5, drawn)
    kind = "long" if names is int else "string"
    e = spark.createDataFrame([(names(a), names(b), w) for a, b, w in drawn], f"a {kind}, b {kind}, weight long")
    nodes = spark.createDataFrame([(names(i),) for i in range(n + 5)], f"id {kind}")
    got = dict(pairs(louvain.louvain(nodes, e, block_edges=110), "id", "community"))
    assert [got[names(i)] for i in range(n + 5)] == [names(c) for c in want] and 3 < len(set(want)) < 20


def test_resolution_rules(spark):
    n, _ = graph(
        spark,
        {"a/A.java": {"kind": "file", "path": "a/A.java"}, "a/A.java::A": CLASS | {"name": "A", "path": "a/A.java"}, "a/A.java::A.run": {"name": "A.run", "path": "a/A.java"}, "b/B.java::B": CLASS | {"name": "B", "path": "b/B.java"}, "b/B.java::B.run": {"name": "B.run", "path": "b/B.java"}, "b/B.java::B.go": {"name": "B.go", "path": "b/B.java"}, "t/ATest.java::ATest": {"kind": "test", "name": "ATest", "path": "t/ATest.java"}},
        [],
    )
    files = spark.createDataFrame([("a/A.java", "", "java", "", "a", [], 0, 0), ("b/B.java", "", "java", "", "b", ["a.A", "x.Gone"], 0, 0), ("t/ATest.java", "", "java", "", "t", ["a.*"], 0, 0)], FILES)
    refs = spark.createDataFrame([("b/B.java::B", "extends", "A", 1, ""), ("b/B.java::B", "implements", "Gone", 1, ""), ("b/B.java::B.go", "calls", "run", 2, ""), ("b/B.java::B.go", "calls", "info", 2, "LOG"), ("t/ATest.java::ATest", "calls", "go", 2, "")], REFS)
    edges, outside = resolve.resolve(n, files, refs)
    got = pairs(edges, "from_id", "to_id", "kind", "confidence")
    assert ("b/B.java", "a/A.java", "imports", "exact") in got and ("t/ATest.java", "a/A.java", "imports", "exact") in got
    assert ("b/B.java::B", "a/A.java::A", "extends", "exact") in got
    assert ("b/B.java::B", "external::x.Gone", "implements", "exact") in got
    assert ("b/B.java::B.go", "a/A.java::A.run", "calls", "medium") in got  # inherited
    assert ("t/ATest.java::ATest", "b/B.java::B.go", "calls", "medium") in got  # the only one of its name
    assert ("b/B.java::B.run", "a/A.java::A.run", "overrides", "high") in got
    assert ("a/A.java::A", "t/ATest.java::ATest", "tested_by", "high") in got
    assert pairs(outside, "id", "name") == {("external::x.Gone", "x.Gone")}


def test_targets_prefixes_and_overrides(spark):
    n, _ = graph(spark, {"p::Order": CLASS | {"name": "Order"}, "p::Order.pay": {"name": "Order.pay"}, "q::Order": {"name": "Order"}, "q::Zed": {"name": "Zed"}}, [])
    for target, want in (("q::Order", ("q::Order", "id")), ("zed", ("q::Zed", "single")), ("Order", ("p::Order", "class"))):
        assert tuple(graph_joins.resolve_target(n, target).first()) == want
    assert not graph_joins.resolve_target(n, "Ord").count()
    tests = spark.createDataFrame([("OrderServiceShipping",), ("Ordering",)], "base string")
    names = spark.createDataFrame([("Order",), ("OrderService",)], "name string")
    assert pairs(graph_joins.longest_prefix_class(tests, names), "base", "name") == {("OrderServiceShipping", "OrderService")}


def test_file_changes(spark):
    kind = "path string, size long, mtime_ns long, sha256 string"
    known = spark.createDataFrame([("same", 1, 1, "x"), ("touched", 1, 1, "x"), ("edited", 1, 1, "x"), ("gone", 1, 1, "x")], kind)
    now = spark.createDataFrame([("same", 1, 1, "y"), ("touched", 1, 2, "x"), ("edited", 2, 2, "z"), ("new", 1, 1, "n")], kind)
    assert dict(pairs(graph_tables.changes(known, now), "path", "action")) == {"same": "unchanged", "touched": "unchanged", "edited": "parse", "gone": "deleted", "new": "parse"}


def walked(below, leaf, entry, depth, fan_out):
    """A depth-first walk, one call after the other."""
    rows, seen, cut = [(0, -1, 0, entry)], {entry}, False

    def follow(caller, hop, d):
        nonlocal cut
        taken = 0
        for callee in sorted(below.get(caller, ())):
            if callee in seen:
                continue
            if fan_out and taken >= fan_out:
                cut = True
                return
            taken += 1
            seen.add(callee)
            rows.append((len(rows), hop, d, callee))
            if callee not in leaf and d < depth:
                follow(callee, len(rows) - 1, d + 1)

    if depth:
        follow(entry, 0, 1)
    return {(entry, *r, cut) for r in rows}


@pytest.mark.parametrize("depth, fan_out", [(4, 2), (6, 0), (1, 1)])
def test_trees_of_all_entries_equal_walks(spark, depth, fan_out):
    r = random.Random(depth)
    names = [f"n{i:02}" for i in range(26)]
    calls = {(r.choice(names), r.choice(names)) for _ in range(70)}
    nodes = {x: {"path": f"d{i % 3}/{x}"} for i, x in enumerate(names)} | {"I": CLASS, "K": CLASS} | {x: {"name": f"I.{x}"} for x in names[:3]}
    n, e = graph(spark, nodes, [(a, b, "calls") for a, b in calls] + [("K", "I", "implements"), *(("I", x, "contains") for x in names[:3]), ("n05", "gone", "calls")])
    got = {(x.entry, x.hop, x.parent_hop, x.depth, x.id, x.truncated) for x in flow.call_trees(n, e, ids(spark, *names), depth, fan_out).collect()}
    below = {}
    for a, b in calls:
        below.setdefault(a, set()).add(b)
    assert got == set().union(*(walked(below, set(names[:3]), x, depth, fan_out) for x in names))


def test_colors_jump_over_long_chains(spark):
    n = 700
    names = [f"c{(i * 577) % n:03}" for i in range(n)]
    ring = [(a, b) for a, b in zip(names, names[1:] + names[:1])]
    e = spark.createDataFrame([*ring, ("x", names[5]), (names[7], "y"), ("a0", "x")], "a string, b string")
    start = spark.createDataFrame([(x, x) for x in [*names, "x", "y", "a0"]], "id string, color string")
    got = dict(map(tuple, components._spread(e, start).collect()))
    assert got == dict.fromkeys([*names, "x", "y", "a0"], "a0")
    alone = dict(map(tuple, components._spread(spark.createDataFrame(ring, "a string, b string"), start.filter("id = 'c100'")).collect()))
    assert alone == dict.fromkeys(names, "c100")
