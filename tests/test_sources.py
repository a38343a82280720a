"""Readers on small files and texts."""

import gzip
import json

from cairnspark.sources import chunks, code, files, logs, reports, tables
from cairnspark.streaming import logs as stream


def test_log_reads_in_order_and_skips_what_is_malformed(spark, tmp_path):
    lines = ['{"event":"hook","duration_ms":5,"ok":true}', "not json", '{"event":"prompt","session_id":"a","unknown":1}', "", '{"provider":"p"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = logs.read_log(spark, f"file://{tmp_path}/log.jsonl").orderBy("ord").collect()
    assert [(r["event"], r["ok"], r["duration_ms"]) for r in got] == [("hook", True, 5), ("prompt", False, 0), ("", False, 0)]
    assert [r["event"] for r in logs.last_rows(logs.read_log(spark, f"file://{tmp_path}/log.jsonl"), 2).collect()] == ["prompt", ""]
    assert logs.read_log(spark, f"file://{tmp_path}/none.jsonl").count() == 0


def test_chunks(spark, tmp_path):
    for author, ids in (("a", ["obs-2", "obs-1"]), ("b", ["obs-3"])):
        doc = {"observations": [{"sync_id": i, "topic_key": "t", "revision": 2} for i in ids]}
        (tmp_path / f"chunk-{author}.jsonl.gz").write_bytes(gzip.compress(json.dumps(doc, indent=1).encode()))
    got = chunks.read_chunks(spark, f"file://{tmp_path}").collect()
    assert [(r["sync_id"], r["revision"], r["author"]) for r in got] == [("obs-1", 2, ""), ("obs-2", 2, ""), ("obs-3", 2, "")]


def test_source_listing(spark, tmp_path):
    for p in ("a/x.py", "a/.git/y.py", "a/testdata/z.py", "b/w.go", "v.py", "b/q.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1")
    root = f"file://{tmp_path}"
    names = lambda **k: [r["path"] for r in files.list_sources(spark, root, [".py", ".go"], **k).collect()]
    assert names() == ["a/x.py", "b/w.go", "v.py"]
    assert names(excludes=["a"]) == ["b/w.go", "v.py"] and names(recursive=False) == ["v.py"] and names(subpath="b") == ["b/w.go"]


def texts(spark, *rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "path string, text string")


def test_scenarios_markers_and_front_matter(spark):
    t = texts(spark, "Feature: x\n  @s1\n  Scenario: one\n  Scenario: none\n @s2 @slow\n\nScenario:  two \n@s3", "---\nname: n\ndescription: \"d e\"\n---\nmade-by label=ab-c source-hash=00ff\n<open>\na\n<close>")
    assert [(r["tag"], r["title"]) for r in files.scenarios(t).orderBy("line").collect()] == [("@s1", "one"), ("@s2", "two")]
    m = files.provenance(files.front_matter(t), "made-by").filter("path = '1'").first()
    assert (m["name"], m["description"], m["source_hash"], m["label"]) == ("n", "d e", "00ff", "ab-c")
    r = files.marker_range(t, "path", "<open>", "<close>").first()
    assert (r["start_line"], r["end_line"]) == (6, 8)


def test_reports(spark):
    go = "mode: set\nex.org/m/a.go:1.1,2.5 2 1\nex.org/m/a.go:2.1,3.5 1 0\nbroken"
    cob = '<?xml version="1.0"?><coverage><packages><package><classes><class filename="b.py"><lines><line number="4" hits="0"/><line number="5" hits="2"/></lines></class></classes></package></packages></coverage>'
    got = {(r["file"], r["line"], r["covered"]) for r in reports.load_coverage(texts(spark, go, cob, "nothing"), "ex.org/m").collect()}
    assert got == {("a.go", 1, True), ("a.go", 2, True), ("a.go", 2, False), ("a.go", 3, False), ("b.py", 4, False), ("b.py", 5, True)}
    junit = "<testsuite><testcase classname='K' name='a'><failure/></testcase><testsuite><testcase classname='K' name='b'><skipped/></testcase></testsuite></testsuite>"
    assert {(r["name"], r["status"]) for r in reports.junit(texts(spark, junit)).collect()} == {("a", "fail"), ("b", "skipped")}
    out = 'PASS "x.go.3" with checksum 1\nFAIL "x.go.4" with checksum 2\nThe score is 0.5 (1 passed, 1 failed, 0 skipped, total is 2)'
    assert {(r["file"], r["killed"]) for r in reports.go_mutants(texts(spark, out)).collect()} == {("x.go", False), ("x.go", True)}
    assert tuple(reports.go_mutation_summary(texts(spark, out)).first())[1:] == (1, 1, 2)
    py = "  calc.x_f__mutmut_1: survived\n  calc.x_f__mutmut_2: killed\n12 mutations/second"
    assert {(r["file"], r["killed"]) for r in reports.python_mutants(texts(spark, py)).collect()} == {("calc", False), ("calc", True)}
    java = "<mutations><mutation detected='true' status='KILLED'><sourceFile>A.java</sourceFile><lineNumber>3</lineNumber></mutation></mutations>"
    assert tuple(reports.java_mutants(texts(spark, java)).select("file", "line", "killed").first()) == ("A.java", 3, True)


def test_tables(spark):
    f = spark.createDataFrame([("p", '["a","b"]'), ("q", None)], "path string, imports string")
    assert [r["imports"] for r in tables.decoded_files(f).orderBy("path").collect()] == [["a", "b"], []]
    m = spark.createDataFrame([("k", "v")], "key string, value string")
    assert [tables.metadata_value(m, k).first()["value"] for k in ("k", "none")] == ["v", ""]


PY = "import os.path\nfrom a.b import c as d\nclass Base: pass\nclass K(Base):\n    def go(self, n: int) -> str:\n        return d.run(n)\n    def _own(self): pass\ndef test_x():\n    K().go(1)\n"
JAVA = "package a.b;\nimport c.D;\npublic class K extends Base implements I, J {\n  /* void no() { } */\n  public int go(int n) {\n    return d.run(n);\n  }\n}\ninterface I { void go(int n); }\n"
GO = 'package x\nimport (\n "m/y"\n)\ntype K struct {\n\tBase\n}\nfunc (k *K) Go(n int) error {\n\treturn y.Run(n)\n}\nfunc TestK(t *T) { k.Go(1) }\n'
TS = "import { d } from './d';\nexport class K extends Base implements I {\n  go(n: number): string {\n    return d.run(n);\n  }\n}\nexport const f = (x) => { k.go(x); };\n"
GQL = "fragment F on User { id ...G }\nquery Q { me { ...F } }\ntype User { id: ID }\n"


def test_code(spark):
    src = [("p/k.py", PY), ("p/K.java", JAVA), ("p/k_test.go", GO), ("p/k.ts", TS), ("q.graphql", GQL), ("bad.py", "def (")]
    facts = code.parse_files(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in src], "path string, content binary"))
    nodes, contains, refs, metas = code.tables(facts)
    kinds = {(r["id"], r["kind"]) for r in nodes.collect()}
    assert {("p/k.py::K.go", "function"), ("p/k.py::test_x", "test"), ("p/K.java::K.go", "function"), ("p/K.java::I", "class"), ("p/k_test.go::K.Go", "function"), ("p/k_test.go::TestK", "test"), ("p/k.ts::K.go", "function"), ("p/k.ts::f", "function"), ("q.graphql::gql::F", "graphql_fragment"), ("q.graphql::gql::User", "graphql_type")} <= kinds
    assert not any("no" == i.rsplit(".", 1)[-1] for i, _ in kinds)
    got = {(r["from_id"], r["kind"], r["name"]) for r in refs.collect()}
    assert {("p/k.py::K", "extends", "Base"), ("p/k.py::K.go", "calls", "run"), ("p/K.java::K", "implements", "J"), ("p/K.java::K.go", "calls", "run"), ("p/k_test.go::K", "extends", "Base"), ("p/k_test.go::K.Go", "calls", "Run"), ("p/k.ts::K", "implements", "I"), ("p/k.ts::f", "calls", "go"), ("q.graphql::gql::Q", "spreads", "F")} <= got
    files_ = {r["path"]: r for r in metas.collect()}
    assert files_["bad.py"]["status"] == "failed" and files_["p/K.java"]["package"] == "a.b" and files_["p/k_test.go"]["imports"] == ["m/y"]
    assert ("p/k.py::K", "p/k.py::K.go") in {(r["from_id"], r["to_id"]) for r in contains.collect()}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"provider":"p","cost_usd":1.0,"input_tokens":2}\n{"provider":"p","cost_usd":2.0}\nbroken\n{"event":"hook"}\n')
    entries = stream.log_stream(spark, f"file://{tmp_path}/in")
    q = stream.usage_stream(entries).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["provider"], r["calls"], r["cost_usd"]) for r in spark.table("usage").collect()] == [("p", 2, 3.0)]
