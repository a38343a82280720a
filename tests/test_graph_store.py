"""The stored graph: mutations equal those of whole tables and rewrite touched partitions alone; lookups are pruned."""

import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.model import EDGES, FILES, NODES, REFS
from cairnspark.operators import graph_joins, graph_store, graph_tables
from cairnspark.plans import impact

NODES_ORD = T.StructType([*NODES.fields, T.StructField("ord", T.LongType())])


@pytest.fixture
def made(spark, tmp_path):
    nodes, edges, refs, files = [], [], [], []
    for i in range(120):
        path = f"d{i % 7}/f{i}.go"
        files.append((path, f"s{i}", "go", "ok", "p", [], i, i))
        nodes.append((path, "file", f"f{i}", path, 0, 0, "go", "", "", False))
        for k in range(3):
            nodes.append((f"{path}::m{k}", "function", f"m{k}", path, k, k + 9, "go", "", "", True))
            edges.append((path, f"{path}::m{k}", "contains", "exact"))
            edges.append((f"{path}::m{k}", f"d{(i + k + 1) % 120 % 7}/f{(i + k + 1) % 120}.go::m0", "calls", "high"))
            refs.append((f"{path}::m{k}", "call", "x", k, ""))
    frames = [spark.createDataFrame(r, s) for r, s in ((nodes, NODES), (edges, EDGES), (refs, REFS), (files, FILES))]
    store = graph_store.create(graph_store.GraphStore(spark, f"file://{tmp_path}/store", 32), *frames)
    return store, *frames


def state(store):
    root = store.root.removeprefix("file://")
    return {f"{n}/{p}": sorted(os.listdir(f"{root}/{n}/{p}")) for n in ("nodes", "edges", "edges_in", "refs", "files") for p in os.listdir(f"{root}/{n}") if p.startswith("part=")}


def rows(df):
    return sorted(map(str, df.drop("part").collect()))


def same(store, nodes, edges, refs, files=None):
    assert rows(graph_store.table(store, "nodes")) == rows(nodes) and rows(graph_store.table(store, "refs")) == rows(refs)
    assert rows(graph_store.table(store, "edges")) == rows(graph_store.table(store, "edges_in")) == rows(edges)
    assert files is None or rows(graph_store.table(store, "files")) == rows(files)


def untouched(before, after, touched):
    return all(after.get(k) == v for k, v in before.items() if int(k.split("=")[1]) not in touched[k.split("/")[0]])


def test_a_replaced_file_rewrites_its_partitions_alone(spark, made):
    store, nodes, edges, refs, files = made
    path = "d3/f3.go"
    new = spark.createDataFrame([(path, "file", "f3", path, 0, 0, "go", "", "", False, 1), (f"{path}::new", "function", "new", path, 1, 5, "go", "", "", True, 2), (f"{path}::new", "function", "later", path, 1, 5, "go", "", "", True, 3), ("d4/f4.go::m0", "function", "taken", path, 1, 5, "go", "", "", True, 4)], NODES_ORD)
    contains = spark.createDataFrame([(path, f"{path}::new", "contains", "low", 1), (path, f"{path}::new", "contains", "exact", 2)], "from_id string, to_id string, kind string, confidence string, ord long")
    new_refs = spark.createDataFrame([(f"{path}::new", "call", "y", 1, "")], REFS)
    gone = spark.createDataFrame([(path,)], "path string")
    before = state(store)
    want = graph_tables.replace_files(nodes, refs, edges, gone, new, new_refs, contains)
    touched = graph_store.replace_files(store, gone, new, new_refs, contains)
    same(store, want[0], want[2], want[1], files)
    assert len(touched["nodes"]) == 1 == len(touched["edges"]) and len(touched["edges_in"]) <= 4 and untouched(before, state(store), touched | {"files": []})


def test_a_deleted_file_takes_the_edges_at_either_end(spark, made):
    store, nodes, edges, refs, files = made
    gone = spark.createDataFrame([("d5/f5.go",), ("not/there.go",)], "path string")
    before = state(store)
    want = graph_tables.delete_files(files, nodes, refs, edges, gone)
    touched = graph_store.delete_files(store, gone)
    same(store, want[1], want[3], want[2], want[0])
    assert len(touched["edges"]) < 12 and untouched(before, state(store), touched)


def test_partitions_may_come_out_empty_and_be_filled_again(spark, made):
    store, nodes, edges, refs, files = made
    graph_store.delete_files(store, files.select("path"))
    same(store, nodes.limit(0), edges.limit(0), refs.limit(0), files.limit(0))
    graph_store.upsert_files(store, files)
    assert rows(graph_store.table(store, "files")) == rows(files)


def test_what_is_resolved_anew_rewrites_partitions_that_change(spark, made):
    store, nodes, edges, refs, _ = made
    before = state(store)
    assert graph_store.put_changed(store, nodes, edges) == {"nodes": [], "edges": [], "edges_in": []} and state(store) == before
    other = edges.withColumn("confidence", F.when(F.col("from_id") == "d1/f1.go::m1", "low").otherwise(F.col("confidence")))
    touched = graph_store.put_changed(store, nodes, other)
    same(store, nodes, other, refs)
    assert [len(touched[n]) for n in ("nodes", "edges", "edges_in")] == [0, 1, 1] and untouched(before, state(store), touched | {"refs": [], "files": []})


def test_lookups_read_their_partitions_and_buckets(spark, made):
    store, nodes, edges, _, _ = made
    target = spark.createDataFrame([("d2/f2.go::m0",)], "id string")
    found = graph_store.callers_of(store, target)
    assert rows(found) == rows(graph_joins.callers(nodes, edges, target)) and re.search(r"PartitionFilters: \[[^\]]*part", found._jdf.queryExecution().executedPlan().toString())
    up = graph_store.save_lookup(edges, "up", 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    try:
        plan = up.filter("to_id = 'd2/f2.go::m0'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    assert rows(impact.impact(nodes, up, target, 2)) == rows(impact.impact(nodes, edges, target, 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = target.join(impact.steps(up), F.col("id") == F.col("at"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # of the walk's nodes
