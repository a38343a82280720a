"""Streams with keyed state, against plain Python and the batch forms, over restarts and replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import rules
from cairnspark.queries.streams import in_two_runs
from cairnspark.streaming import logs, state

T0 = datetime(2024, 1, 1)
ACTIONS = "project string, at timestamp, ord long, action string, text string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def by_hand(rows):
    out, open_, notes = [], {}, {}
    for p, t, o, action, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if action in ("start", "end") and p in open_:
            said = [x for _, _, x in sorted(notes.pop(p, []), reverse=True)[:10]]
            out.append((p, open_.pop(p), t, (text if action == "end" else "") or (f"{len(said)} observation(s): {'; '.join(said)}" if said else state.NOTHING)))
        if action == "start":
            open_[p], notes[p] = t, []
        if action == "note" and p in open_ and text:
            notes[p].append((t, str(o), text))
    return sorted(out + [(p, t, None, "") for p, t in open_.items()], key=str)


def told(df):
    return sorted(((r.project, r.started_at, r.ended_at, r.summary) for r in state.sessions_so_far(df).collect()), key=str)


@pytest.fixture(scope="module")
def actions():
    r = random.Random(6)
    kinds = ["start", "end", "note", "note", "note", "note"]
    return [(f"p{r.randrange(3)}", at(i // 2), i, k, r.choice(["", None, f"own {i}"]) if k == "end" else f"n{i}" if k == "note" and i % 9 else None) for i in range(300) for k in [r.choice(kinds)]]


def test_sessions_go_on_after_a_restart(spark, actions):
    df = spark.createDataFrame(actions, ACTIONS)
    early = F.col("ord") < 140
    assert told(in_two_runs([df.filter(early), df.filter(~early)], state.session_stream)) == by_hand(actions)


def test_sessions_ask_the_state_store_once_a_batch(spark, monkeypatch):
    import pandas as pd

    class Held:
        """A state variable that counts how often it is asked."""

        def __init__(self):
            self.value, self.asked = None, 0

        def exists(self):
            self.asked += 1
            return self.value is not None

        def get(self):
            self.asked += 1
            return iter(self.value) if isinstance(self.value, list) else self.value

        def update(self, value):
            self.asked, self.value = self.asked + 1, value

        put = update

        def clear(self):
            self.update(None)

    r = random.Random(8)
    rows = [("p", at(i // 40), i, r.choice(["start", "end", *["note"] * 30]), r.choice([f"n{i}", f"n{i}", None])) for i in range(3000)]
    sessions, out = state._Sessions(None), []
    sessions.handle, sessions.open, sessions.notes = None, Held(), Held()
    batches = 3
    for k in range(batches):
        part = rows[k * 1000 : (k + 1) * 1000]
        r.shuffle(part)
        halves = [pd.DataFrame(part[i::2], columns=["project", "at", "ord", "action", "text"]) for i in range(2)]
        out += [tuple(x) for df in sessions.handleInputRows(("p",), iter(halves), None) for x in df.itertuples(index=False)]
    last = {}
    for p, name, began, ended, summary in out:
        if name not in last or not pd.isna(ended):
            last[name] = (p, began.to_pydatetime(), None if pd.isna(ended) else ended.to_pydatetime(), summary)
    got = sorted(last.values(), key=str)
    assert got == by_hand(rows)
    assert sessions.open.asked + sessions.notes.asked <= 6 * batches


def test_sessions_that_nobody_ends_end_by_a_timer(spark):
    rows = [("a", at(0), 1, "start", None), ("a", at(5), 2, "note", "x"), ("b", at(200), 3, "start", None), ("a", at(300), 4, "note", "late"), ("c", at(400), 5, "start", None)]
    parts = [spark.createDataFrame(rows[:2], ACTIONS), spark.createDataFrame(rows[2:], ACTIONS)]
    out = in_two_runs(parts, lambda r: state.session_stream(r, timedelta(minutes=60)))
    assert told(out) == sorted([("a", at(0), at(60), "1 observation(s): x"), ("b", at(200), at(260), state.NOTHING), ("c", at(400), None, "")], key=str)


def test_alerts_equal_the_state_table_run_by_run(spark):
    r = random.Random(3)
    names = ["r1", "r2", "r3", "r4"]
    rows = [("p", run, n, r.randrange(1, 9), f"m{run}", False) for run in range(8) for n in names if r.random() < 0.8]
    dismissals = [("p", 3, "r2", 0, "", True)]
    shown, held = [], {n: (0, False) for n in names}
    for run in range(8):
        if run == 3:
            held["r2"] = (held["r2"][0], True)
        found = spark.createDataFrame([(n, e, m) for _, k, n, e, m, _ in rows if k == run], "rule_id string, evidence long, message string")
        now, after = rules.to_show(found, spark.createDataFrame([(n, *v) for n, v in held.items()], "rule_id string, last_shown long, dismissed boolean"), 2)
        shown += [("p", run, *x) for x in now.collect()]
        held = {x.rule_id: (x.last_shown, x.dismissed) for x in after.collect()}
    df = spark.createDataFrame(rows + dismissals, "project string, run long, rule_id string, evidence long, message string, dismiss boolean")
    out = in_two_runs([df.filter("run < 4"), df.filter("run >= 4")], lambda x: state.alert_stream(x, 2))
    assert sorted(map(tuple, out.collect())) == sorted(shown) and len(shown) > 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, ledger, calls = str(tmp_path / "in"), f"file://{tmp_path}/ledger", []
    spark.createDataFrame([("a",), ("b",), ("a",)], "path string").write.parquet(source)
    for k in range(2):  # the second query has lost its checkpoint
        changed = spark.readStream.schema("path string").parquet(source)
        logs.refresh_stream(changed, lambda rows: calls.append(sorted(r.path for r in rows.collect())), str(tmp_path / f"state{k}"), ledger, once=True).awaitTermination()
    assert calls == [["a", "b"]]
    # A batch that failed has no entry and is refreshed again.
    changed = spark.readStream.schema("path string").parquet(source)
    with pytest.raises(Exception, match="broken"):
        logs.refresh_stream(changed, lambda rows: (_ for _ in ()).throw(ValueError("broken")), str(tmp_path / "s2"), f"{ledger}2", once=True).awaitTermination()
    logs.refresh_stream(changed, lambda rows: calls.append(1), str(tmp_path / "s2"), f"{ledger}2", once=True).awaitTermination()
    assert calls[1:] == [1]
