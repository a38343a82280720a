"""Lines of growing files: every line once, wherever ranges are cut, and followed as files grow."""

import pytest

from cairnspark.sources import line_source


@pytest.mark.parametrize("size", [1, 7, 16, 1000])
def test_ranges_give_every_line_once(spark, tmp_path, size):
    texts = {"a.log": "one\n\ntwo é\nthree without end", "b.log": "x" * 40 + "\ny\n", "c.txt": "not this\n", "d.log": ""}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    got = sorted((r.file.split("/")[-1], r["at"], r.value) for r in line_source.read_lines(spark, f"file://{tmp_path}", suffix=".log", rangeBytes=str(size)).collect())
    assert got == [("a.log", 0, "one"), ("a.log", 4, ""), ("a.log", 5, "two é"), ("a.log", 12, "three without end"), ("b.log", 0, "x" * 40), ("b.log", 41, "y")]


def test_a_file_is_followed_as_it_grows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, seen = tmp_path / "in" / "a.log", []

    def run():
        lines = line_source.read_lines(spark, f"file://{tmp_path}/in", stream=True)
        lines.writeStream.foreachBatch(lambda df, n: seen.extend(r.value for r in df.orderBy("file", "at").collect())).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    log.write_text('{"event":"a"}\n{"event":"b"}\n{"ev')
    run()
    assert seen == ['{"event":"a"}', '{"event":"b"}']
    with log.open("a") as f:
        f.write('ent":"c"}\n')
    (tmp_path / "in" / "b.log").write_text("broken\n")
    run()
    assert seen[2:] == ['{"event":"c"}', "broken"]
    run()
    assert len(seen) == 4


def test_entries_are_those_of_the_log(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event":"hook","input_tokens":3}\n[1]\nbroken\n\n{"provider":"p"}\n')
    got = line_source.log_entries(line_source.read_lines(spark, str(tmp_path / "x.jsonl"))).orderBy("at").collect()
    assert [(r.event, r.provider, r.input_tokens, r.ok) for r in got] == [("hook", "", 3, False), ("", "p", 0, False)]
