"""Queries against the whole of their tables, by SQL or plain Python over all rows."""

import random
from collections import Counter, defaultdict, deque

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairnspark.adaptors import EDGES_SQL
from cairnspark.plans import domains, louvain
from cairnspark.queries import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def many_parts(tmp_path_factory):
    """A folder with parts whose keys go beyond 2,000."""
    d = tmp_path_factory.mktemp("parts")
    k = list(range(1, 4101, 3))
    pq.write_table(pa.table({"p_partkey": pa.array(k, pa.int64()), "p_brand": [f"Brand#{x % 7}" for x in k], "p_size": pa.array([x % 50 + 1 for x in k], pa.int32())}), d / "part.parquet")
    return str(d)


@pytest.mark.parametrize(("name", "lines"), [("read_cobertura", "1"), ("read_jacoco", "1"), ("read_istanbul", "1 + p_partkey % 2")])
def test_reports_are_written_from_all_parts(spark, many_parts, name, lines):
    got = sorted(tuple(r)[1:] for r in QUERIES[name][0](spark, many_parts).collect())
    want = duckdb.sql(f"SELECT CAST(sum({lines}) AS BIGINT), CAST(coalesce(sum({lines}) FILTER (p_partkey % 3 > 0), 0) AS BIGINT) FROM '{many_parts}/part.parquet' GROUP BY p_brand").fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize(("name", "key", "least"), [("mutation_scores", "'k' || CAST(l_suppkey % 9 AS STRING)", 20), ("read_go_mutants", "CAST(l_suppkey % 9 AS STRING)", 20), ("read_typescript_mutants", "CAST(l_suppkey % 9 AS STRING)", 15)])
def test_mutants_are_all_line_items(spark, sf, name, key, least):
    got = {r[0]: (r["total"], r["killed"], r["score"]) for r in QUERIES[name][0](spark, sf).collect()}
    want = duckdb.sql(f"SELECT {key}, count(*), count(*) FILTER (l_quantity > {least}), round(avg(CAST(l_quantity > {least} AS INT)), 6) FROM '{sf}/lineitem.parquet' GROUP BY 1").fetchall()
    assert got == {k: tuple(x) for k, *x in want}


def test_mutation_gate_is_over_all_line_items(spark, tmp_path):
    # Tool k1 passes over all rows and fails over every tenth order, k2 the other way round.
    rows = [(k, 1 if k % 10 else 2, 1, 1, q) for k in range(1, 41) for q in [30 if k % 10 else 10]]
    rows += [(k, 2, 1, 2, 10) for k in range(1, 41) if k % 10] + [(k, 1, 1, 2, 10) for k in range(10, 41, 10)] + [(k, 2, 1, 3, 30) for k in range(10, 41, 10)]
    pq.write_table(pa.table(dict(zip(("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity"), map(list, zip(*rows))))), tmp_path / "lineitem.parquet")
    got = {r["tool"]: r["passed"] for r in QUERIES["mutation_gate"][0](spark, str(tmp_path)).collect()}
    want = duckdb.sql(f"SELECT 'k' || CAST(l_suppkey % 9 AS STRING), avg(CAST(l_quantity > 20 AS INT)) >= 0.6 FROM '{tmp_path}/lineitem.parquet' GROUP BY 1").fetchall()
    tenth = duckdb.sql(f"SELECT 'k' || CAST(l_suppkey % 9 AS STRING), avg(CAST(l_quantity > 20 AS INT)) >= 0.6 FROM '{tmp_path}/lineitem.parquet' WHERE l_orderkey % 10 = 0 GROUP BY 1").fetchall()
    assert got == dict(want) != dict(tenth)


@pytest.mark.parametrize("name", ["note_similarity", "umbrella_free_tokens"])
def test_notes_are_read_whole(spark, sf, name):
    run, sql = QUERIES[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert "substr(content" not in sql
    want = con.sql(sql).df()
    got = run(spark, sf).toPandas()[list(want.columns)]
    key = lambda df: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))
    assert key(got) == key(want)


def test_notes_are_grouped_by_their_later_text(spark, tmp_path):
    # Twelve notes in three groups whose members share words behind character 300 only; none is a skill.
    ids = [i for i in range(40) if i % 8 != 5 and i % 11][:12]
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    text = lambda i, g: " ".join(f"own{letters(1000 * i + k)}" for k in range(120, 160)) + " " + " ".join(f"shared{letters(1000 * g + k)}" for k in range(100, 300))
    texts = [text(i, n % 3 + 7) for n, i in enumerate(ids)]
    assert all(t.index("shared") > 300 for t in texts)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "source": ["web"] * len(ids)}), tmp_path / "documents.parquet")
    own = {f"doc-{i}": n % 3 for n, i in enumerate(ids)}
    groups = defaultdict(set)
    for r in QUERIES["note_communities"][0](spark, str(tmp_path)).collect():
        groups[r["community"]].add(own[r["id"]])
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    assert [r["size"] for r in QUERIES["note_clusters"][0](spark, str(tmp_path)).collect()] == [4, 4, 4]


@pytest.fixture(scope="module")
def edges(sf):
    con = duckdb.connect()
    for t in ("nation", "region", "supplier", "customer", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(f"WITH {EDGES_SQL} SELECT from_id, to_id, kind FROM edges").fetchall()


def reached(to, v):
    seen, todo = {v}, [v]
    while todo:
        for w in to[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def test_components_are_of_all_dependency_edges(spark, sf, edges):
    out, back = defaultdict(set), defaultdict(set)
    for a, b, kind in edges:
        if kind not in ("contains", "documents"):
            out[a].add(b)
            back[b].add(a)
    want = {}
    for v in sorted(set(out) | set(back)):
        if v not in want:
            want |= dict.fromkeys(reached(out, v) & reached(back, v), v)
    assert dict(map(tuple, QUERIES["strong_components"][0](spark, sf).select("id", "component").collect())) == want
    sizes = {c: n for c, n in Counter(want.values()).items() if n > 1}
    assert dict(map(tuple, QUERIES["cycles"][0](spark, sf).select("component", "size").collect())) == sizes
    core = {v for v in want if want[v] == want["supplier:1"]} if want["supplier:1"] in sizes else set()
    assert {r["id"] for r in QUERIES["cyclic_core"][0](spark, sf).collect()} == core


def test_bridges_are_of_all_calls(spark, sf, edges):
    to = defaultdict(set)
    for a, b, kind in edges:
        if kind == "calls":
            to[a].add(b)
    nodes = sorted(set(to) | {b for x in to.values() for b in x})
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes[:100]:
        dist, paths, order, todo = {s: 0}, Counter({s: 1}), [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in to[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = Counter()
        for v in reversed(order):
            delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in to[v] if dist[w] == dist[v] + 1)
            if v != s:
                want[v] += delta[v]
    got = dict(map(tuple, QUERIES["betweenness"][0](spark, sf).select("id", "score").collect()))
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-3 for v in want)
    top = [tuple(r) for r in QUERIES["top_bridges"][0](spark, sf).select("id", "score").collect()]
    assert [x for _, x in top] == pytest.approx(sorted(want.values(), reverse=True)[:10], abs=1e-3)
    positive = sorted(x for x in want.values() if x > 0)
    least = positive[max(0, min(len(positive) - 1, int(len(positive) * 0.95)))]
    marks = dict(map(tuple, QUERIES["chokepoints"][0](spark, sf).select("id", "is_chokepoint").collect()))
    assert marks.keys() == {v for v in want if want[v] > 0}
    assert all(marks[v] == (want[v] >= least) for v in marks if abs(want[v] - least) > 1e-9)


def test_more_than_a_thousand_large_communities_keep_their_files(spark):
    n = 1005
    files = spark.range(3 * n).selectExpr("concat('f', id) AS path", "concat('p.q', id % 5) AS package", "1L AS size")
    pairs = spark.range(n).selectExpr("explode(array(struct(3 * id AS x, 3 * id + 1 AS y), struct(3 * id AS x, 3 * id + 2 AS y), struct(3 * id + 1 AS x, 3 * id + 2 AS y))) AS e").selectExpr("concat('f', e.x) AS a", "concat('f', e.y) AS b", "1L AS weight")
    none = spark.createDataFrame([], "from_id string, to_id string")
    got = [r["path"] for r in domains.clustered_domain_map(files, none, pairs, domains.Limits(max_files=2)).collect()]
    assert sorted(got) == sorted(f"f{i}" for i in range(3 * n))


def test_graphs_are_clustered_apart_as_alone(spark):
    r = random.Random(4)
    rows = [(f"g{g}n{a}", f"g{g}n{b}", r.randrange(1, 5 * g + 3), g) for g in range(4) for a in range(12) for b in range(a) if r.random() < 0.3]
    edges = spark.createDataFrame(rows, "a string, b string, weight long, g int")
    nodes = lambda e: e.selectExpr("a AS id").union(e.select("b")).distinct()
    got = {tuple(x) for x in louvain.louvain(nodes(edges), edges, by="g").collect()}
    alone = [edges.filter(F.col("g") == g).drop("g") for g in range(4)]
    assert got == {tuple(x) for e in alone for x in louvain.louvain(nodes(e), e).collect()}


def test_surprises_are_sought_in_the_whole_radius(spark, sf, monkeypatch):
    # 5,200 nodes call the target; the last of them, in a domain that leads elsewhere, is beyond the blast radius' cap.
    from cairnspark.queries import graph

    near = [(f"f{i:04}", "function", "b/x/f") for i in range(5200)]
    far = [(f"o{i}", "function", "c/x/f") for i in range(5)]
    nodes = spark.createDataFrame([("supplier:1", "class", "a/x/f"), ("z", "function", "z/x/f"), *near, *far], "id string, kind string, path string")
    calls = [(f, "supplier:1") for f, *_ in [*near, ("z",)]] + [("z", o) for o, *_ in far]
    edges = spark.createDataFrame([(a, b, "calls", "high") for a, b in calls], "from_id string, to_id string, kind string, confidence string")
    monkeypatch.setattr(graph, "_graph", lambda s, d: (nodes, edges))
    got = [tuple(r) for r in QUERIES["surprising_edges"][0](spark, sf).collect()]
    assert got == [("z", "supplier:1", "z/x", "a/x", round(1 - 1 / 6, 6))]
    assert "5000" in QUERIES["impact"][1] and "5000" not in QUERIES["surprising_edges"][1]
