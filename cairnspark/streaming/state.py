"""Streams with keyed state: work sessions, and alerts that are shown again only as their evidence grows.

Both keep their state in the state store (RocksDB), so a restarted query goes on where it was; a batch that is run
again gives the same rows. A project is a key.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Notes that a composed summary names.
NAMED = 10
#: Rows of sessions that are given back at a time.
STEPS = 10_000
NOTHING = "(no observations recorded)"
SESSIONS = "project string, id string, started_at timestamp, ended_at timestamp, summary string"
SHOWN = "project string, run long, rule_id string, evidence long, message string"


def keep_state(spark: SparkSession) -> None:
    """Name the state store that keyed state needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(frames: Iterable[pd.DataFrame], *order: str) -> list:
    frames = list(frames)
    return list(pd.concat(frames).sort_values(list(order), kind="stable").itertuples(index=False)) if frames else []


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["project", "id", "started_at", "ended_at", "summary"]).astype({"started_at": "datetime64[us]", "ended_at": "datetime64[us]"})


def session_id(project: str, at: datetime, number: int) -> str:
    return "session-" + hashlib.sha256(f"{project}\0{at.isoformat(sep=' ')}\0{number}".encode()).hexdigest()[:12]


class _Sessions(StatefulProcessor):
    """At most one open session a project, with its newest notes. The state store is asked once a batch, not once a row:
    a batch's rows are sorted as columns, and Python takes a step a start or end, with the newest notes before it."""

    def __init__(self, longest: timedelta | None) -> None:
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "id string, started_at timestamp")
        self.notes = handle.getListState("notes", "at timestamp, note string, label string")

    def _load(self) -> None:
        self.session = tuple(self.open.get()) if self.open.exists() else None
        self.newest = [(n[0], n[1], n[2]) for n in self.notes.get()] if self.notes.exists() else []

    def _save(self) -> None:
        if self.session is None:
            self.open.clear()
        else:
            self.open.update(self.session)
        if self.newest:
            self.notes.put(self.newest)
        else:
            self.notes.clear()

    def _end(self, project: str, at: datetime, summary: str) -> tuple:
        name, started = self.session
        said = [label for when, _, label in sorted(self.newest, reverse=True) if when <= at][:NAMED]
        self.session, self.newest = None, []
        return project, name, started, at, summary or (f"{len(said)} observation(s): {'; '.join(said)}" if said else NOTHING)

    def _expired(self, project: str, now: datetime) -> list[tuple]:
        if self.longest is None or self.session is None:
            return []
        until = self.session[1] + self.longest
        return [self._end(project, until, "")] if until <= now else []

    def _add(self, times: np.ndarray, ords: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Notes in the order of their times. Only the newest can be named; the others are let go."""
        if len(rows) > NAMED:
            rows = rows[np.searchsorted(times[rows], times[rows[-NAMED]]) :]
        found = [(at, str(int(o)), label) for at, o, label in zip(times[rows].tolist(), ords[rows], labels[rows])]
        self.newest = sorted([*self.newest, *found], reverse=True)[:NAMED]

    def _steps(self, project: str, df: pd.DataFrame) -> Iterator[tuple]:
        """What a batch's rows, in order, say of sessions."""
        times, ords = df["at"].to_numpy().astype("datetime64[us]"), df["ord"].to_numpy()
        actions, texts = df["action"].to_numpy(dtype=object), df["text"].to_numpy(dtype=object)
        bounds = np.flatnonzero((actions == "start") | (actions == "end"))
        notes = np.flatnonzero((actions == "note") & (df["text"].fillna("") != "").to_numpy())
        began = 0
        for i, at in zip([*bounds.tolist(), len(df)], [*times[bounds].tolist(), None]):
            if self.session is not None:
                last = i
                if self.longest is not None:
                    last = began + int(np.searchsorted(times[began:i], np.datetime64(self.session[1] + self.longest, "us")))
                self._add(times, ords, texts, notes[np.searchsorted(notes, began) : np.searchsorted(notes, last)])
                if last < i:
                    yield from self._expired(project, times[last].item())
            if at is None:
                break
            began = i + 1
            yield from self._expired(project, at)
            if actions[i] == "start":
                if self.session is not None:
                    yield self._end(project, at, "")
                self.session = session_id(project, at, int(ords[i])), at
                yield project, self.session[0], at, None, ""
            elif self.session is not None:
                yield self._end(project, at, texts[i] or "")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        before = self.session
        df = pd.concat([x[["at", "ord", "action", "text"]] for x in rows]).sort_values(["at", "ord"], kind="stable")
        steps = self._steps(key[0], df)
        while some := list(itertools.islice(steps, STEPS)):
            yield _told(some)
        if self.longest is not None and self.session is not None and self.session != before:
            self.handle.registerTimer(int((self.session[1] + self.longest).timestamp() * 1000))
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = self._expired(key[0], datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000))
        if out:
            self._save()
        yield _told(out)

    def close(self) -> None:
        pass


def session_stream(actions: DataFrame, longest: timedelta | None = None, late: str = "10 minutes") -> DataFrame:
    """(project, id, started_at, ended_at, summary) as sessions begin (no end yet) and end.

    actions: (project, at, ord, action, text), action one of start, end (text: a summary, or empty for one composed of
    the newest notes) and note (text: its label). A start ends an open session first; an end without one, and notes
    outside of sessions, do nothing. Rows of a batch go by time, then ord; what comes in a later batch comes after.
    longest: a session that nobody ends ends after so long, at the latest when the watermark passes that time (by
    default never).
    """
    keep_state(actions.sparkSession)
    timed = actions.withWatermark("at", late) if longest is not None else actions
    mode = "EventTime" if longest is not None else "None"
    return timed.groupBy("project").transformWithStateInPandas(_Sessions(longest), SESSIONS, "Append", mode)


def sessions_so_far(rows: DataFrame) -> DataFrame:
    """Each session once, as last told."""
    return rows.groupBy("project", "id", "started_at").agg(F.max("ended_at").alias("ended_at"), F.coalesce(F.max_by("summary", "ended_at"), F.lit("")).alias("summary"))


class _Alerts(StatefulProcessor):
    """Of each rule the evidence with which it was last shown, and whether it is dismissed."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("rules", "rule_id string", "last_shown long, dismissed boolean")

    def _of(self, rule: str) -> tuple[int, bool]:
        held = self.state.getValue((rule,)) if self.state.containsKey((rule,)) else (0, False)
        return held[0], held[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, runs = [], {}
        for r in _rows(rows, "run", "rule_id"):
            runs.setdefault(int(r.run), []).append(r)
        for run, found in sorted(runs.items()):
            for r in found:
                if r.dismiss:
                    self.state.updateValue((r.rule_id,), (self._of(r.rule_id)[0], True))
            grown = [r for r in found if not r.dismiss and int(r.evidence) > self._of(r.rule_id)[0] and not self._of(r.rule_id)[1]]
            for r in sorted(grown, key=lambda r: (-int(r.evidence), r.rule_id))[: self.budget]:
                self.state.updateValue((r.rule_id,), (int(r.evidence), False))
                out.append((key[0], run, r.rule_id, int(r.evidence), r.message or ""))
        yield pd.DataFrame(out, columns=["project", "run", "rule_id", "evidence", "message"])

    def close(self) -> None:
        pass


def alert_stream(suggestions: DataFrame, budget: int) -> DataFrame:
    """(project, run, rule_id, evidence, message) of the alerts to show: those with more evidence than when last
    shown, of each run the `budget` with the most, none that was dismissed.

    suggestions: (project, run, rule_id, evidence, message, dismiss): what fires in each run, and dismissals, which
    hold from their own run on. Runs of a batch go by number; those of a later batch come after.
    """
    keep_state(suggestions.sparkSession)
    return suggestions.groupBy("project").transformWithStateInPandas(_Alerts(budget), SHOWN, "Append", "None")
