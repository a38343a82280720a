"""Operators on notes, reports, domains and cards that the queries don't reach."""

from datetime import datetime

from pyspark.sql import functions as F

from cairnspark.functions import paths, text
from cairnspark.model import NOTES
from cairnspark.operators import coverage, graph_tables, logs, notes, rules, search
from cairnspark.plans import cards, domains, note_clusters

T = datetime(2024, 1, 1)


def note_table(spark, *rows):
    base = {"scope": "project", "project": "", "title": "", "content": "", "type": "", "source": "", "revision": 1, "created_at": T, "updated_at": T, "author": "", "sync_id": "", "imported": False, "deleted_at": None}
    return spark.createDataFrame([tuple(({"id": f"n{i}", "topic_key": ""} | base | r)[c] for c in NOTES.names) for i, r in enumerate(rows)], NOTES)


def test_batch_of_saves_is_folded_in_order(spark):
    kind = "topic_key string, scope string, project string, title string, content string, type string, source string, author string, saved_at long, ord long"
    rows = [("decision/a", "", "", "", "one", "", "", "x", 1, 1), ("decision/a", "", "", "T", "two", "", "", "", 2, 2), ("decision/a", "", "", "U", "two", "", "", "y", 3, 3)]
    r = notes.fold_saves(spark.createDataFrame(rows, kind)).first()
    assert (r["revision"], r["title"], r["content"], r["type"], r["author"], r["saved_at"]) == (2, "T", "two", "decision", "x", 3)


def test_rejected_saves_and_collisions(spark):
    kind = "topic_key string, scope string, project string, title string, content string, type string, source string, author string, saved_at timestamp"
    bad = [("", "", "", "", "c", "", "", "", T), ("a", "", "", "", "c", "nonsense", "", "", T)]
    saves = spark.createDataFrame([*bad, ("misc/b", "", "", "", "c", "", "", "", T)], kind)
    assert notes.invalid_saves(saves).count() == 2
    got = notes.upsert(note_table(spark), saves).collect()
    assert [(r["topic_key"], r["revision"], r["type"], r["title"]) for r in got] == [("misc/b", 1, "", "misc/b")]
    n = note_table(spark, {"topic_key": "a"}, {"topic_key": "a", "scope": "personal"}, {"topic_key": "b"})
    moves = spark.createDataFrame([("a", "project", "", "personal"), ("b", "project", "", "personal")], "topic_key string, scope string, project string, new_scope string")
    assert notes.collisions(n, moves, "scope").count() == 1
    got = {(r["id"], r["scope"]) for r in notes.rescope(n, moves, F.lit(T)).collect()}
    assert got == {("n0", "project"), ("n1", "personal"), ("n2", "personal")}


def test_chunks_are_written_once(spark, tmp_path):
    n = note_table(spark, {"topic_key": "a", "sync_id": "s1", "content": "x"}, {"topic_key": "p", "scope": "personal"}, {"topic_key": "o", "author": "other"})
    records = notes.export_records(n, "Jo Doe")
    folder = f"file://{tmp_path}"
    assert notes.write_chunk(records, folder, "Jo Doe") and not notes.write_chunk(records, folder, "Jo Doe")
    assert notes.write_chunk(records.withColumn("revision", F.col("revision") + 1), folder, "Jo Doe")
    from cairnspark.sources.chunks import read_chunks

    assert [(r["sync_id"], r["author"], r["revision"]) for r in read_chunks(spark, folder).collect()] == [("s1", "Jo Doe", 2)]


def test_sessions_start_by_ending_the_open_one(spark):
    s = spark.createDataFrame([("s0", "p", T, None, "")], "id string, project string, started_at timestamp, ended_at timestamp, summary string")
    n = note_table(spark, {"topic_key": "k1"})
    got = notes.start_sessions(s, n, spark.createDataFrame([("p",)], "project string"), F.lit(T)).collect()
    assert {(r["id"] == "s0", r["ended_at"] is None, r["summary"]) for r in got} == {(True, False, "1 observation(s): k1"), (False, True, "")}


def test_index_drift_and_links(spark):
    n = note_table(spark, {"topic_key": "a", "content": "see Order now"}, {"topic_key": "b", "content": "x"})
    index = search.build_index(n)
    assert not search.index_drifted(index, n).first()["drifted"]
    assert search.index_drifted(index.filter("id <> 'n1'"), n).first()["drifted"]
    nodes = spark.createDataFrame([("p::Order", "class", "Order")], "id string, kind string, name string")
    old = spark.createDataFrame([("r", "n0", "gone", "documents_auto"), ("k", "n0", "kept", "related")], "id string, from_id string, to_id string, relation_type string")
    assert {(r["to_id"], r["relation_type"]) for r in search.relink(old, n, nodes).collect()} == {("p::Order", "documents_auto"), ("kept", "related")}


def test_percentiles_are_nearest_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50)], "v long")
    assert tuple(df.agg(logs.percentile("v", 50), logs.percentile("v", 95)).first()) == (30, 50)
    assert df.limit(0).agg(logs.percentile("v", 50)).first()[0] == 0


def test_rule_state_round_trip(spark):
    state = spark.createDataFrame([("a", 3, True), ("b", 0, False)], "rule_id string, last_shown long, dismissed boolean")
    back = rules.read_state(rules.write_state(state))
    assert sorted(map(tuple, back.collect())) == [("a", 3, True), ("b", 0, False)]


def test_gates(spark):
    cases = spark.createDataFrame([("org.FooTest", "a", "pass"), ("org.BarTest", "b", "fail")], "class string, name string, status string")
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "file string")
    assert tuple(coverage.red_gate(cases, f("src/org/BarTest.java", "src/org/NewTest.java"), False).first()) == (True, "")
    assert tuple(coverage.red_gate(cases, f("src/org/FooTest.java"), False).first()) == (False, "src/org/FooTest.java")
    assert coverage.red_gate(cases, f("src/org/BarTest.java"), True).first()["ok"] is False
    assert not coverage.cases_of_files(cases, f("src/org/AFooTest.java")).count()
    states = spark.createDataFrame([("x", "pass", 1), ("y", "pending", 2)], "feature string, status string, ord int")
    assert tuple(coverage.next_pending(states).first()) == ("y", True)


def test_longest_suffix_matches(spark):
    p = spark.createDataFrame([("root/src/a/b.go",), ("b.go",)], "path string")
    k = spark.createDataFrame([("b.go",), ("a/b.go",), ("xa/b.go",)], "file string")
    assert {(r["path"], r["file"]) for r in coverage.match_paths(p, k).collect()} == {("root/src/a/b.go", "a/b.go"), ("b.go", "b.go")}


def test_text_functions(spark):
    df = spark.createDataFrame([("añb c", "decision/The-oauth2 99 the", "OrderTests")], "s string, t string, n string")
    got = df.select(text.truncate_bytes(F.col("s"), 2), text.truncate_bytes(F.col("s"), 3), text.domain_tokens(F.col("t"), F.lit("T x"), F.lit("Caché")), text.strip_test_suffix(F.col("n")), text.search_terms(F.lit(' a "b  c ')), text.tag(F.lit(" @s1 "))).first()
    assert tuple(got) == ("a", "añ", ["oauth2", "cach"], "Order", '"a" OR """b" OR "c"', "s1")


def test_path_functions(spark):
    rows = ["a/x_test.go", "test_y.py", "w/b.spec.ts", "w/__tests__/c.ts", "K.java", "a/FooTest.java"]
    df = spark.createDataFrame([(x,) for x in rows], "p string")
    assert [r[0] for r in df.select(paths.is_test_path(df.p)).collect()] == [True, True, True, True, False, False]
    assert [r[0] for r in df.select(paths.is_test_file(df.p)).collect()] == [True, True, True, False, False, True]
    assert [r[0] for r in df.select(paths.test_sources(df.p)).collect()][2:4] == [["w/b.ts"], ["w/c.ts"]]
    d = spark.createDataFrame([("Com.Acme.x", "p"), ("", "A/B/c"), ("", "")], "k string, p string")
    assert [r[0] for r in d.select(paths.domain(d.k, d.p)).collect()] == ["com/acme", "a/b", "external"]


def test_small_domains_merge_and_large_ones_split(spark):
    rows = [(f"f{i}", "r.a" if i < 8 else "r.b", 10) for i in range(10)] + [("g0", "r.a.x", 10)]
    files = spark.createDataFrame(rows, "path string, package string, size long")
    e = spark.createDataFrame([("f8", "f0"), ("f9", "f1")], "from_id string, to_id string")
    got = domains.domain_map(files, e, domains.Limits(min_files=3)).groupBy("domain").count().collect()
    assert {tuple(r) for r in got} == {("a", 11)}
    got = domains.domain_map(files, e, domains.Limits(max_bytes=40)).collect()
    assert {r["domain"] for r in got} == {"a-x", "a-1", "a-2", "b"} or {r["domain"] for r in got} == {"a-x", "a-1", "a-2", "b", "a"}


def test_topology_map_and_names(spark):
    rows = [(f"k{i:02}", f"z.{'p' if i < 12 else 'q'}", 1) for i in range(24)]
    files = spark.createDataFrame(rows, "path string, package string, size long")
    w = spark.createDataFrame([(f"k{a:02}", f"k{b:02}", 5) for g in (range(12), range(12, 24)) for a in g for b in g if a < b], "a string, b string, weight long")
    none = spark.createDataFrame([], "from_id string, to_id string")
    got = domains.clustered_domain_map(files, none, w).groupBy("domain").count().collect()
    assert {tuple(r) for r in got} == {("p", 12), ("q", 12)}


def test_cards_fit(spark):
    rows = [("c", "p.c", "", [f"landmark number {i} " + "x" * 60 for i in range(20)], [f"trait {i}" for i in range(9)])]
    df = spark.createDataFrame(rows, "name string, package string, description string, landmarks array<string>, traits array<string>")
    card = cards.render_cards(df).first()["card"]
    assert len(card.encode()) <= 1024 and card.count("\n") <= 30 and "landmark number 0" in card
    parts = spark.createDataFrame([("t", "body", 0, "b" * 50), ("t", "call_site", 0, "c" * 60), ("t", "call_site", 1, "d" * 10), ("t", "callee", 0, "e" * 20), ("t", "callee", 1, "f" * 90), ("t", "skill", 0, "g" * 90)], "target string, kind string, ord int, text string")
    got = [(r["kind"], len(r["text"])) for r in cards.context_within(parts, 100).collect()]
    assert got == [("body", 50), ("call_site", 10), ("callee", 20), ("skill", 20)]


def test_note_clusters_have_labels_of_their_own(spark):
    words = ["checkout payment refund", "checkout payment card", "checkout payment limit", "lorem ipsum dolor"]
    n = note_table(spark, *({"topic_key": f"misc/t{i}x", "content": w} for i, w in enumerate(words)))
    got = note_clusters.note_clusters(n, 3)
    assert [tuple(r) for r in got[0].collect()] == [("checkout", 3)] and got[1].count() == 3


def test_concepts_and_store_changes(spark):
    c = spark.createDataFrame([("a", "d", "c")], "name string, description string, content string")
    cf = spark.createDataFrame([("a", "p1"), ("b", "p2")], "concept string, path string")
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "name string")
    rec = spark.createDataFrame([("p1", "h"), ("p2", "h")], "path string, sha256 string")
    cur = spark.createDataFrame([("p1", "h"), ("p2", "other")], "path string, sha256 string")
    assert {tuple(r) for r in graph_tables.concept_freshness(cf, names, rec, cur).collect()} == {("a", "up-to-date"), ("b", "stale"), ("z", "new")}
    assert graph_tables.uncovered_files(spark.createDataFrame([("p1",), ("p9",)], "path string"), c, cf).count() == 1
    assert graph_tables.uncovered_files(spark.createDataFrame([("p1",)], "path string"), c.limit(0), cf).count() == 0
    nodes, edges = graph_tables.knowledge(cf)
    assert nodes.count() == 2 and edges.filter("to_id = 'p1'").first()["from_id"] == "skill::a"
