"""What one row, one task or one round holds doesn't grow with the tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairnspark.queries import all_queries
from cairnspark.sources import chunks, reports

QUERIES = all_queries()


@pytest.fixture(scope="module")
def many_orders(tmp_path_factory):
    """Line items of 40,000 orders, all of one supplier."""
    d = tmp_path_factory.mktemp("orders")
    k = list(range(1, 40_001))
    pq.write_table(pa.table({"l_orderkey": pa.array(k, pa.int64()), "l_suppkey": pa.array([9] * len(k), pa.int64()), "l_partkey": pa.array(k, pa.int64()), "l_linenumber": pa.array([1] * len(k), pa.int32()), "l_quantity": pa.array([float(x % 50) for x in k])}), d / "lineitem.parquet")
    return str(d)


def _longest(monkeypatch, names):
    """What readers of reports are given: the longest text of each."""
    seen = []
    for name in names:
        own = getattr(reports, name)

        def read(texts, *args, own=own, **kwargs):
            column = kwargs.get("column", "text")
            seen.append(texts.agg(F.max(F.length(column))).first()[0])
            return own(texts, *args, **kwargs)

        monkeypatch.setattr(reports, name, read)
    return seen


@pytest.mark.parametrize(("name", "readers"), [("mutation_engines", ["python_mutants", "java_mutants"]), ("read_typescript_mutants", ["typescript_mutants"]), ("read_go_mutants", ["go_mutants"])])
def test_a_tools_reports_are_no_one_text(spark, many_orders, monkeypatch, name, readers):
    longest = _longest(monkeypatch, readers)
    got = QUERIES[name][0](spark, many_orders).collect()
    assert {r["total"] for r in got} == {40_000}
    assert len(longest) == len(readers) and max(longest) < 1_000_000


def test_the_older_store_is_no_one_text(spark, tmp_path, monkeypatch):
    n = 2_000
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": ["x" * 1000] * n, "source": ["s"] * n}), tmp_path / "documents.parquet")
    largest = []
    own = chunks.read_legacy
    monkeypatch.setattr(chunks, "read_legacy", lambda s, folder: largest.append(s.read.format("binaryFile").load(folder).agg(F.max("length")).first()[0]) or own(s, folder))
    assert QUERIES["legacy_notes"][0](spark, str(tmp_path)).count() == n
    assert largest[0] < 700_000


def test_a_large_chunk_is_several_files(spark, tmp_path):
    from cairnspark.operators import notes

    folder = f"file://{tmp_path}"
    rows = lambda n, r=1: spark.range(n).select(F.concat(F.lit("obs-"), "id").alias("sync_id"), F.repeat(F.lit("x"), 1000).alias("content"), F.lit(r).alias("revision"))
    files = lambda: sorted(p.name for p in tmp_path.glob("chunk-*"))
    read = lambda: sorted((r["sync_id"], r["revision"]) for r in chunks.read_chunks(spark, folder).select("sync_id", "revision").collect())
    assert notes.write_chunk(rows(3), folder, "a-1", 100_000) and notes.write_chunk(rows(400), folder, "a", 100_000)
    assert files() == ["chunk-a-1.jsonl.gz", *(f"chunk-a.{k}.jsonl.gz" for k in range(1, 8)), "chunk-a.jsonl.gz"]
    assert max(spark.read.text(str(p)).agg(F.sum(F.length("value"))).first()[0] for p in tmp_path.glob("chunk-a*.gz")) < 120_000
    assert read() == sorted([(f"obs-{i}", 1) for i in range(3)] + [(f"obs-{i}", 1) for i in range(400)])
    assert not notes.write_chunk(rows(400), folder, "a", 100_000)
    assert notes.write_chunk(rows(150, 2), folder, "a", 100_000)
    assert files() == ["chunk-a-1.jsonl.gz", "chunk-a.1.jsonl.gz", "chunk-a.jsonl.gz"]
    assert read() == sorted([(f"obs-{i}", 1) for i in range(3)] + [(f"obs-{i}", 2) for i in range(150)])
    assert notes.write_chunk(rows(0), folder, "a", 100_000) and files() == ["chunk-a-1.jsonl.gz", "chunk-a.jsonl.gz"]
    assert len(read()) == 3 and not notes.write_chunk(rows(0), folder, "a")


def test_budgets_go_on_over_batches(spark, monkeypatch):
    from cairnspark.plans import cards

    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None, raising=False)  # no call of Python a target
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(t, kind, o, text) for t in "pqr" for kind, o, text in [("skill", 1, "ü" * 9), ("skill", 0, "k"), ("callee", 2, "c"), ("callee", 1, "c" * 50), ("callee", 0, "cc"), ("call_site", 1, "s" * 4), ("call_site", 0, "s" * 40), ("body", 0, "b" * 5)]]
        got = cards.context_within(spark.createDataFrame(rows, "target string, kind string, ord int, text string"), 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [("body", 0, "bbbbb"), ("call_site", 1, "ssss"), ("callee", 0, "cc"), ("skill", 0, "k"), ("skill", 1, "üüüü")]
    assert sorted(map(tuple, got)) == sorted((t, *x) for t in "pqr" for x in want)


def _code(spark, seed, n=60):
    """Files of few packages, some with classes of a second file entry, and names that recur."""
    import random

    rng = random.Random(seed)
    files = [(f"f{i}", "java", rng.choice(["", "p", "q", "r"]), [f"{rng.choice('pqr')}.{rng.choice(['*', 'C1', 'C2'])}" for _ in range(rng.randrange(4))]) for i in range(n)]
    files += [(f"f{i}", "java", rng.choice("pq"), []) for i in range(0, n, 9)]
    nodes = [(f"f{i}::C{i % 4}", "class", f"C{i % 4}", f"f{i}") for i in range(n) if i % 5] + [(f"f{i}::C{i % 4}.m{k}", "function", f"C{i % 4}.m{k}", f"f{i}") for i in range(n) for k in {rng.randrange(12) for _ in range(2)}]
    refs = [(f"f{i}::C{i % 4}.m{rng.randrange(12)}", "calls", f"m{rng.randrange(14)}", 1, "") for i in range(n) for _ in range(3)]
    return spark.createDataFrame(nodes, "id string, kind string, name string, path string"), spark.createDataFrame(files, "path string, language string, package string, imports array<string>"), spark.createDataFrame(refs, "from_id string, kind string, name string, line int, recv string"), nodes, files, refs


@pytest.mark.parametrize("seed", [1, 2])
def test_imports_are_made_once_each(spark, seed):
    from cairnspark.plans import resolve

    nodes, files, _, n, f, _ = _code(spark, seed)
    out = resolve.import_edges(nodes, files)
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")  # edges are moved by no shuffle
    classes = {(i, name, path, pk) for i, kind, name, path in n if kind == "class" for fp, _, pk, _ in f if fp == path}
    full = {}
    for i, name, path, pk in classes:
        fqn = f"{pk}.{name}" if pk else name
        full[fqn] = min(full.get(fqn, (i, path)), (i, path))
    want = {(path, to) for path, _, _, imports in f for x in imports for to in ({c[2] for c in classes if c[3] == x[:-2]} if x.endswith(".*") else {full[x][1]} if x in full else ()) if to != path}
    assert sorted((r["from_id"], r["to_id"]) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_calls_in_crowded_packages(spark, seed):
    from cairnspark.plans import resolve

    nodes, files, refs, n, f, r = _code(spark, seed)
    plan = (out := resolve.resolve_calls(nodes, files, refs, spark.createDataFrame([], "from_id string, to_id string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan.split("Join")[-1] or "row_number" in plan  # of a name in a package no more than decide
    classes = {(i, name, path, pk) for i, kind, name, path in n if kind == "class" for fp, _, pk, _ in f if fp == path}
    full = {}
    for i, name, path, pk in classes:
        fqn = f"{pk}.{name}" if pk else name
        full[fqn] = min(full.get(fqn, (i, path)), (i, path))
    sees = {}
    for path, _, pk, imports in f:
        s = sees.setdefault(path, {path})
        s |= {c[2] for c in classes if c[3] == pk}
        for x in imports:
            s |= {c[2] for c in classes if c[3] == x[:-2]} if x.endswith(".*") else {full[x][1]} if x in full else set()
    want = set()
    for from_id, _, name, _, _ in r:
        every = {i for i, kind, long, _ in n if kind == "function" and long.split(".")[-1] == name}
        near = {i for i in every if i.split("::")[0] in sees[from_id.split("::")[0]]}
        hits = near or every
        if len(hits) <= resolve.AMBIGUOUS:
            want |= {(from_id, to, "low" if len(hits) > 1 else "high" if near else "medium") for to in hits if to != from_id}
    assert sorted((x["from_id"], x["to_id"], x["confidence"]) for x in out.collect()) == sorted(want)


def test_notes_are_not_sent_to_every_part(spark):
    import random

    from cairnspark.plans import note_clusters

    rng = random.Random(5)
    sets = {f"n{i}": {f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))} for i in range(150)}
    tokens = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id string, token string")
    out = note_clusters.similar_notes(tokens, 0.25, 10)
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves().mkString(" ")
    assert "note-sets" not in leaves and " s#" not in leaves and "[s#" not in leaves  # sets don't pass a shuffle on their way to pairs
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items() if v >= 0.25}


def test_a_closure_sorts_out_its_pairs_once(spark, monkeypatch):
    from cairnspark.plans import closures

    written = []
    own = closures.materialize
    monkeypatch.setattr(closures, "materialize", lambda df, name: written.append(name) or own(df, name))
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = closures.closure(pairs, spark.createDataFrame([("a",)], "id string")).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1), ("a", "c", 2)] and written.count("closure-pairs") == 1


@pytest.mark.parametrize(("seed", "depth", "fan_out"), [(1, 2, 3), (2, 3, 2)])
def test_small_trees_are_walked_from_short_lists(spark, monkeypatch, seed, depth, fan_out):
    """As by labels, with hubs, cycles, parallel edges, methods of interfaces and callees that nobody knows."""
    import random

    from cairnspark.plans import flow

    rng = random.Random(seed)
    ids = [f"n{i:02}" for i in range(40)]
    nodes = spark.createDataFrame([(i, "function", "T.run", f"d{k % 4}/f") for k, i in enumerate(ids)] + [(f"t{k}", "class", f"T{k}", "d/f") for k in range(3)], "id string, kind string, name string, path string")
    calls = [(rng.choice(ids), rng.choice(ids), "calls", c) for _ in range(150) for c in rng.sample(["high", "low"], rng.randrange(1, 3))] + [("n00", i, "calls", "high") for i in ids] + [(i, "n00", "calls", "low") for i in ids[::3]] + [("n01", "gone", "calls", "low")]
    owned = [(f"t{k % 3}", i, "contains", "exact") for k, i in enumerate(ids[1::4])] + [("t1", "t0", "implements", "high"), ("t2", "t0", "implements", "high")]
    edges = spark.createDataFrame(calls + owned, "from_id string, to_id string, kind string, confidence string")
    entries = nodes.filter("kind = 'function'").select("id").union(spark.createDataFrame([("n01",), ("unknown",)], "id string"))
    lists, own = [], flow.materialize
    monkeypatch.setattr(flow, "materialize", lambda df, name: lists.append((name, out := own(df, name))) or out)
    got = sorted(map(tuple, flow.call_trees(nodes, edges, entries, depth, fan_out).collect()))
    longest = [df.agg(F.max(F.size("callees"))).first()[0] for name, df in lists if name == "flow-lists"]
    assert longest and longest[0] <= sum(fan_out**k for k in range(depth + 1)) + 1
    monkeypatch.setattr(flow, "TREE_NODES", 0)
    assert got == sorted(map(tuple, flow.call_trees(nodes, edges, entries, depth, fan_out).collect()))
    assert any(r[6] for r in got) and any(r[5] for r in got) and any(r[7] for r in got)


def test_coupling_is_joined_once_for_communities(spark, sf, monkeypatch):
    from cairnspark.plans import louvain

    given = []
    monkeypatch.setattr(louvain, "louvain", lambda files, w: given.append(w) or files)
    QUERIES["file_communities"][0](spark, sf)
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cap", [None, 4])
def test_reach_ends_where_nothing_leads_on(spark, monkeypatch, cap):
    import random

    from cairnspark.plans import impact

    rng = random.Random(7)
    ids = [f"n{i:02}" for i in range(30)]
    nodes = spark.createDataFrame([(i, rng.choice([*ids, ""])) for i in ids], "id string, path string")
    edges = spark.createDataFrame([(rng.choice([*ids, "gone"]), rng.choice(ids), "calls", "high") for _ in range(50)], "from_id string, to_id string, kind string, confidence string")
    for depth in (1, 3):
        want = {r["source"]: r["count"] for r in impact.impact(nodes, edges, nodes.select("id"), depth, cap=cap).groupBy("source").count().collect()}
        assert {r["source"]: r["n"] for r in impact.reached(nodes, edges, nodes.select("id"), depth, cap=cap).collect()} == want
    written, own = [], impact.materialize
    monkeypatch.setattr(impact, "materialize", lambda df, name: written.append(name) or own(df, name))
    flat = spark.createDataFrame([("b", "a", "calls", "high"), ("c", "a", "calls", "high")], "from_id string, to_id string, kind string, confidence string")
    three = spark.createDataFrame([(x, "") for x in "abc"], "id string, path string")
    got = impact.reached(three, flat, three.filter("id = 'a'").select("id"), 3, cap=cap)
    assert [tuple(r) for r in got.collect()] == [("a", 2)] and written.count("reached") == 1


def test_context_makes_the_parts_that_are_asked_for(spark, sf, monkeypatch):
    from cairnspark.plans import betweenness, components, impact

    def never(*args, **kwargs):
        raise AssertionError("not asked for")

    monkeypatch.setattr(components, "core_of", never)
    monkeypatch.setattr(betweenness, "chokepoints", never)
    assert {r["part"] for r in QUERIES["context"][0](spark, sf).collect()} == {"hits", "skills", "tests"}
    with pytest.raises(AssertionError, match="not asked for"):
        impact.context(*(spark.createDataFrame([], x) for x in ("id string, kind string, path string", "from_id string, to_id string, kind string, confidence string")), "x")


@pytest.fixture
def small_partitions(spark):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def _most_files(spark, folder, pattern):
    """The largest number of files in a folder of a table's partition."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    parents = [x.getPath().getParent().toString() for x in found]
    return max(map(parents.count, parents))


def test_a_crowded_partition_of_a_store_is_no_one_task(spark, tmp_path, small_partitions):
    from cairnspark.operators import graph_store

    nodes = spark.range(0, 20_000, 1, 8).select(F.concat(F.lit("n"), F.md5(F.col("id").cast("string"))).alias("id"), F.lit("function").alias("kind"), F.lit("n").alias("name"), F.lit("one/path").alias("path"))
    edges = spark.createDataFrame([("a", "b", "calls", "high")], "from_id string, to_id string, kind string, confidence string")
    store = graph_store.create(graph_store.GraphStore(spark, f"file://{tmp_path}", 4), nodes, edges)
    assert _most_files(spark, store.root, "nodes/part=*") > 1 and graph_store.table(store, "nodes").count() == 20_000


def test_a_crowded_bucket_of_an_index_is_no_one_task(spark, tmp_path, small_partitions):
    from cairnspark.operators import search_store

    notes = spark.range(0, 4_000, 1, 8).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", *(F.md5((F.col("id") * 7 + k).cast("string")) for k in range(5))).alias("content"), F.lit("t").alias("title"), F.lit("k").alias("topic_key"), F.lit("").alias("type"), F.current_timestamp().alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    store = search_store.create(search_store.SearchStore(spark, f"file://{tmp_path}", 1), notes)
    assert _most_files(spark, store.root, "gen=0/postings/segment=0/bucket=*") > 1
    assert search_store.postings_of(store, ["t"]).count() == 4_000


@pytest.mark.parametrize("seed", [1, 2])
def test_landmarks_meet_their_concepts_once_an_anchor(spark, seed):
    import random

    from cairnspark.plans import cards

    rng = random.Random(seed)
    paths = ["p", "q", "r", "s"]
    owner = {f"f{i}": rng.choice(paths) for i in range(40)}
    nodes = [(x, x, x) for x in paths[:3]] + [(i, f"n{rng.randrange(9)}", p if rng.random() < 0.8 else "elsewhere") for i, p in owner.items()]
    contains = [(p, i, "contains") for i, p in owner.items() if int(i[1:]) % 4]
    calls = [(a, b, rng.choice(["calls", "extends"])) for a, b in {(rng.choice([*owner, "x1", "x2"]), rng.choice([*owner, "x1"])) for _ in range(150)}]
    concepts = [("A", "p"), ("B", "p"), ("B", "q"), (None, "q"), ("C", "r")]
    n = spark.createDataFrame(nodes, "id string, name string, path string")
    e = spark.createDataFrame(contains + calls, "from_id string, to_id string, kind string")
    out = cards.landmarks(n, e, spark.createDataFrame(concepts, "name string, path string"), 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Aggregate [t#" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    below = [x for x in plan[at + 1 :]]
    below = below[: next((i for i, x in enumerate(below) if depth(x) <= depth(plan[at])), len(below))]
    assert sum(x.lstrip(" :+-").startswith("Join ") and ("from_id" in x or "to_id" in x) for x in below) == 2
    assert not any(x.lstrip(" :+-").startswith("Join ") and "(t#" in x for x in below)

    top = {c: a for a, c, _ in contains}
    of = {}
    for i, _, path in nodes:
        of.setdefault(i, []).extend(c for c, p in concepts if p == path)
    fan, entry = {}, {}
    for a, b, _ in calls:
        f, t = top.get(a, a), top.get(b, b)
        if f != t:
            for fc in of.get(f) or [None]:
                for tc in of.get(t) or [None]:
                    fan[t] = fan.get(t, 0) + 1
                    entry[t] = entry.get(t, False) or (tc is not None and fc != tc)
    want = []
    for concept in {c for c, _ in concepts}:
        own = sorted((-fan.get(i, 0), name, i) for i, name, _ in nodes if i not in top for c in of[i] if c == concept)
        want += [(concept, i, -k, entry.get(i, False), rank + 1) for rank, (k, _, i) in enumerate(own[:3])]
    got = [(r["concept"], r["id"], r["fan_in"], r["entry"], r["rank"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_surprises_are_sought_within_the_radius(spark, monkeypatch):
    import random

    from cairnspark.plans import impact

    rng, written, own = random.Random(4), [], impact.materialize
    monkeypatch.setattr(impact, "materialize", lambda df, name: written.append((name, out := own(df, name))) or out)
    ids = [f"n{i}" for i in range(120)]
    path = {x: rng.choice(["a/x", "a/y", "b/x", "c/d", "e/f"]) for x in ids}
    edges = [(a, b, k) for a in ids for b in rng.sample(ids, 12) for k in rng.sample(["calls", "extends", "contains"], 2)]
    hits = [("n0", x) for x in ids[1:9]] + [("n7", x) for x in ids[5:20]]
    files = spark.createDataFrame([], "path string, package string")
    n = spark.createDataFrame([(x, "function", path[x]) for x in ids], "id string, kind string, path string")
    out = impact.surprises(n, spark.createDataFrame(edges, "from_id string, to_id string, kind string"), files, spark.createDataFrame(hits, "source string, node_id string"), 2, 0.24, 5)
    got = [(r["source"], r["from_id"], r["to_id"], r["from_domain"], r["to_domain"], round(r["score"], 9)) for r in out.collect()]
    cross = [(a, b, path[a], path[b]) for a, b, k in edges if k != "contains" and path[a] != path[b]]
    share = lambda f, t: sum(x[2:] == (f, t) for x in cross) / sum(x[2] == f for x in cross)
    seldom = {p: 1 - share(*p) for p in {x[2:] for x in cross} if share(*p) < 0.24}
    within = {s: {s} | {x for t, x in hits if t == s} for s, _ in hits}
    want = {(s, a, b, f, t, round(seldom[f, t], 9)) for s, w in within.items() for a, b, f, t in cross if a in w and b in w and (f, t) in seldom}
    assert want and sorted(got) == sorted(want)
    assert max(df.count() for _, df in written) < len(cross) / 4


def test_a_search_counts_the_terms_it_asks_for(spark, tmp_path, monkeypatch):
    from cairnspark.operators import search
    from cairnspark.queries import notes

    written = []
    for at in (search, notes):
        own = at.materialize
        monkeypatch.setattr(at, "materialize", lambda df, name, own=own: written.append((name, out := own(df, name), df)) or out)
    texts = [f"{'thing ' * (i % 4)}w{i} w{i + 1} .. tion" if i % 3 else "" for i in range(300)]
    pq.write_table(pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": texts, "source": ["s"] * 300}), tmp_path / "documents.parquet")
    assert QUERIES["note_search_ranked"][0](spark, str(tmp_path)).count() == sum(bool(i % 3 and i % 11) for i in range(300))
    assert [name for name, _, _ in written] == ["hits"] and {r["term"] for r in written[0][1].collect()} == {"thing", "tion"}
    plan = written[0][2]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("IN (onthe,tion,edand,thing)") < plan.index("Generate") and plan.count("split(") == 1


def test_betweenness_writes_the_edges_that_are_reached(spark, monkeypatch):
    from cairnspark.plans import betweenness

    written, own = [], betweenness.materialize
    monkeypatch.setattr(betweenness, "materialize", lambda df, name: written.append(out := own(df, name)) or out)
    far = [(f"x{i}", f"y{i % 7}") for i in range(500)] + [(f"y{i}", f"z{j}") for i in range(7) for j in range(3)]
    near = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "y1"), ("d", "d")]
    e = spark.createDataFrame([(f, t, "calls") for f, t in 3 * (far + near)] + [("a", "q", "extends")], "from_id string, to_id string, kind string")
    scores = {r["id"]: r["score"] for r in betweenness.bridge_scores(e, 1).collect()}
    assert {k: v for k, v in scores.items() if v} == {"b": 2.5, "c": 2.5, "d": 4.0, "y1": 3.0}
    assert scores.keys() == {x for pair in far + near for x in pair}
    assert max(df.count() for df in written if df.columns == ["a", "b"]) <= 3 * (len(near) + 7 * 3)
    assert not betweenness.bridge_scores(e.filter("kind = 'none'")).count()


@pytest.mark.parametrize(("wide", "visit"), [(64, 10**6), (3, 10**6), (64, 0)])
def test_a_large_part_is_read_once_a_pass(spark, monkeypatch, wide, visit):
    """With weights whose products pass 64 bits, nodes of few and of many edges, two large parts and a small one; parts of
    too many nodes go in blocks."""
    import random

    from cairnspark.plans import louvain

    written, own = [], louvain.materialize
    monkeypatch.setattr(louvain, "materialize", lambda df, name: written.append(name) or own(df, name))
    monkeypatch.setattr(louvain, "WIDE", wide)
    monkeypatch.setattr(louvain, "VISIT_NODES", visit)
    monkeypatch.setattr(louvain, "FILE_ENDS", 200)
    rng, n = random.Random(3), 80
    drawn = [(a, b, rng.randrange(1, 10**11)) for a in range(n) for b in range(a) if rng.random() < (0.5 if a // 10 == b // 10 else 0.04 if a // 40 == b // 40 else 0)] + [(n + i, n + i + 1, 2) for i in range(4)]
    want, name = louvain.communities(n + 5, drawn), lambda i: f"n{i:02}"
    edges = spark.createDataFrame([(name(a), name(b), w) for a, b, w in drawn], "a string, b string, weight long")
    nodes = spark.createDataFrame([(name(i),) for i in range(n + 5)], "id string")
    got = {r["id"]: r["community"] for r in louvain.louvain(nodes, edges, block_edges=60).collect()}
    assert [got[name(i)] for i in range(n + 5)] == [name(c) for c in want] and 3 < len(set(want)) < 30
    if visit:  # no table is written for a block of a pass
        assert not {"louvain-own", "louvain-out", "louvain-home"} & set(written) and written.count("louvain-moved") <= 3


def test_a_forest_connects_what_its_pairs_do(spark):
    import random

    from cairnspark.plans import louvain

    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] * 40
    all_ = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    some = louvain.forest(all_)
    assert some.count() < 4 * 60 and some.exceptAll(all_).isEmpty()
    got, want = ({tuple(r) for r in louvain.connected(x).filter("id <> part").collect()} for x in (some, all_))
    assert got == want


def test_notes_are_clustered_by_numbers(spark, monkeypatch):
    from cairnspark.adaptors import notes
    from cairnspark.plans import note_clusters

    given, own = [], note_clusters.louvain
    monkeypatch.setattr(note_clusters, "louvain", lambda nodes, edges: given.append((nodes, edges)) or own(nodes, edges))
    texts = [" ".join(f"g{'abc'[i % 3]}{chr(97 + k)}word" for k in range(20)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    monkeypatch.setattr("cairnspark.adaptors.table", lambda s, d, name: docs)
    groups, members = note_clusters.note_clusters(notes(spark, ""), 3)
    assert {t for _, t in given[0][0].dtypes + given[0][1].dtypes} == {"bigint", "int"}  # ids and keys stay behind
    alive = [i for i in range(60) if i % 11 and not (i % 8 == 5 and i % 3)]
    assert sorted(r["size"] for r in groups.collect()) == sorted(sum(i % 3 == g for i in alive) for g in range(3))
    assert {r["id"] for r in members.collect()} == {f"doc-{i}" for i in alive}


def test_known_lists_move_once_a_round(spark, monkeypatch):
    from cairnspark.plans import flow

    plans, own = [], flow.materialize
    monkeypatch.setattr(flow, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or own(df, name))
    ids = [f"n{i:02}" for i in range(30)]
    nodes = spark.createDataFrame([(i, "function", "run", "d/f") for i in ids], "id string, kind string, name string, path string")
    # All entries go on to a second round; the walk of n00 and n01, whose callees call each other, to a third.
    calls = {(a, ids[(k + d) % 30]) for k, a in enumerate(ids) for d in (5, 11)} | {("n00", x) for x in ids[1:9]} | {("n01", "n00")}
    edges = spark.createDataFrame([(a, b, "calls") for a, b in calls], "from_id string, to_id string, kind string")
    got = sorted(map(tuple, flow.call_trees(nodes, edges, nodes.select("id"), 2, 3).collect()))
    walks = [p for name, p in plans if name == "flow-walked"]
    assert "Aggregate" not in walks[0] and "Aggregate" in walks[1]
    assert "LeftSemi" not in walks[1] and any(name == "flow-wanted" for name, _ in plans)
    monkeypatch.setattr(flow, "TREE_NODES", 0)
    assert got == sorted(map(tuple, flow.call_trees(nodes, edges, nodes.select("id"), 2, 3).collect()))
    monkeypatch.setattr(flow, "TREE_NODES", 200)
    monkeypatch.setattr(flow, "MOST", 0)
    assert got == sorted(map(tuple, flow.call_trees(nodes, edges, nodes.select("id"), 2, 3).collect()))


def test_gaps_ask_callers_of_candidates_alone(spark, monkeypatch):
    from cairnspark.plans import gaps, impact

    written = []
    for at in (gaps, impact):
        monkeypatch.setattr(at, "materialize", lambda df, name, own=at.materialize: written.append((name, out := own(df, name), df._jdf.queryExecution().optimizedPlan().toString())) or out, raising=False)
    kinds = {"a": ("function", True), "b": ("function", True), "c": ("function", True), "hidden": ("function", False), "t": ("test", False), "u": ("function", False)}
    nodes = spark.createDataFrame([(i, k, i, f"p/{i}", 1, 9, "go", x) for i, (k, x) in kinds.items()], "id string, kind string, name string, path string, line int, end_line int, language string, exported boolean")
    calls = [("u", "a", "high"), ("u", "a", "low"), ("hidden", "a", "low"), ("t", "b", "high"), ("u", "hidden", "high"), ("t", "hidden", "high"), ("t", "u", "low")]
    edges = spark.createDataFrame([(a, b, "calls", c) for a, b, c in calls], "from_id string, to_id string, kind string, confidence string")
    got = {r["id"]: (r["fan_in"], r["blast"]) for r in gaps.untested_gaps(nodes, edges).collect()}
    assert got == {"a": (2, 3), "c": (0, 0)}
    assert sorted((r["from_id"], r["to_id"]) for name, df, _ in written if name == "gap-calls" for r in df.collect()) == [("hidden", "a"), ("t", "b"), ("u", "a")]
    # Edges are made different where they have met their peers.
    walk = next(plan for name, _, plan in written if name == "reached-walk")
    assert walk.startswith("Aggregate [at#")
