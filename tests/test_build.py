"""The incremental build end to end, and the tools as calls."""

from pyspark.sql import functions as F

from cairnspark.api import Engine
from cairnspark.plans.build import Store, build

BASE = {"src/a/Base.java": "package a;\npublic class Base {\n  public void run() {\n  }\n}\n", "src/a/Child.java": "package a;\npublic class Child extends Base {\n  public void go() {\n    run();\n  }\n}\n", "src/b/bad.py": "def (:\n", "lib/m.py": "class M:\n    def f(self):\n        return 1\n"}


def sources(spark, texts, time=1):
    rows = [(p, len(t.encode()), time, bytearray(t.encode())) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, size long, mtime_ns long, content binary")


def facts(store):
    nodes = {(r["id"], r["kind"]) for r in store.nodes.collect()}
    edges = {(r["from_id"], r["to_id"], r["kind"]) for r in store.edges.collect()}
    return nodes, edges


def test_build_parses_what_has_changed(spark):
    store, done = build(Store.empty(spark), sources(spark, BASE))
    assert done == {"parsed": 3, "unchanged": 0, "deleted": 0, "failed": 1}
    nodes, edges = facts(store)
    assert ("src/a/Base.java::Base", "class") in nodes and not any(i.startswith("src/b/bad.py") for i, _ in nodes)
    assert ("src/a/Child.java::Child", "src/a/Base.java::Base", "extends") in edges
    assert {r["path"]: r["status"] for r in store.files.collect()} == {"src/a/Base.java": "ok", "src/a/Child.java": "ok", "src/b/bad.py": "failed", "lib/m.py": "ok"}

    again, done = build(store, sources(spark, BASE, 2))  # touched, but equal
    assert done == {"parsed": 0, "unchanged": 4, "deleted": 0, "failed": 0} and facts(again) == (nodes, edges)
    assert {r["mtime_ns"] for r in again.files.collect()} == {2}

    changed = {p: t for p, t in BASE.items() if p != "lib/m.py"} | {"src/a/Base.java": BASE["src/a/Base.java"].replace("Base", "Root")}
    after, done = build(again, sources(spark, changed, 3))
    assert done["parsed"] == 1 and done["deleted"] == 1
    nodes, edges = facts(after)
    assert ("src/a/Base.java::Root", "class") in nodes and not any(i.startswith("lib/") or i.endswith("::Base") for i, _ in nodes)
    assert not any(k == "extends" for *_, k in edges)


def test_scope_and_empty_store(spark):
    store, _ = build(Store.empty(spark), sources(spark, BASE))
    part, done = build(store, sources(spark, {}), scope="src/a")
    assert done["deleted"] == 2 and {r["path"] for r in part.files.collect()} == {"src/b/bad.py", "lib/m.py"}
    wiped = Store(store.files, store.nodes.filter("false"), store.refs, store.edges)
    healed, done = build(wiped, sources(spark, BASE))
    assert done["parsed"] == 3 and facts(healed) == facts(store)


def test_tools(spark):
    store, _ = build(Store.empty(spark), sources(spark, BASE))
    e = Engine(spark, {"nodes": store.nodes, "edges": store.edges, "files": store.files}, author="me", project="p")
    assert {r["node_id"] for r in e.get_impact("Base").collect()} >= {"src/a/Child.java::Child"}
    assert [r["id"] for r in e.find_symbol("child").collect()][0].startswith("src/a/Child.java")
    assert {r["id"] for r in e.get_context("Base")["hits"].withColumnRenamed("node_id", "id").collect()} and e.get_cycles().count() == 0
    try:
        e.get_impact("Nothing")
    except ValueError as x:
        assert "Nothing" in str(x)
    else:
        raise AssertionError
    saves = spark.createDataFrame([("decision/x", "project", "", "t", "first words", "decision", "s", "me"), ("", "project", "", "t", "c", "", "s", "me")], "topic_key string, scope string, project string, title string, content string, type string, source string, author string").withColumn("saved_at", F.current_timestamp())
    assert e.mem_save(saves).count() == 1 and [r["topic_key"] for r in e.mem_search("WORDS").collect()] == ["decision/x"]
    e.crystallize_save("x", "# Body", "ab12")
    assert {r["topic_key"] for r in e.mem_recent().collect()} == {"decision/x", "skill/x"}
    e.mem_session_start()
    e.mem_session_end("done")
    assert [r["summary"] for r in e.mem_session_list().collect()] == ["done"]
    e.set_architecture("---\nname: a\n---\nText")
    assert [r["content"] for r in e.get_architecture().collect()] == ["Text"] and e.get_concept().count() == 0
    assert e.advise(clusters_ready=2).first()["rule_id"] == "crystallize-ready"
    tools = "get_impact get_context find_symbol mem_save mem_rescope mem_delete mem_reconcile mem_search mem_recent mem_clusters mem_conflicts crystallize_save mem_export mem_import test_gaps test_scaffold test_mutation get_concept set_concept_definition get_architecture set_architecture get_traits get_flow get_bridges get_cycles mem_relate mem_related mem_session_start mem_session_end mem_session_list advise"
    assert all(callable(getattr(Engine, t)) for t in tools.split()) and len(tools.split()) == 31
