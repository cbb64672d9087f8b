"""Held rows and joint windows over streams of several files, with late rows and bounded state."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from strandlake.streaming import held, windows

SCHEMA = "user string, id long, ts timestamp, value double"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def folder(spark, tmp_path):
    """A function that writes batches of (user, id, minute, value) as files, which a stream reads one by one."""
    import os

    def write(name, *batches):
        path = tmp_path / name
        path.mkdir()
        for k, rows in enumerate(batches):
            file = path / f"{k:03d}.parquet"
            spark.createDataFrame([(u, i, at(m), v) for u, i, m, v in rows], SCHEMA).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(file)
            os.utime(file, (1_000_000 + k, 1_000_000 + k))
        return str(path)

    return write


def stream(spark, path):
    return windows.stream(spark, path, SCHEMA, 1)


def test_late_rows_count_up_to_the_bound(spark, folder, tmp_path):
    """Hold 10 minutes, lateness 5: a row 5 minutes late still counts, one that is later doesn't come in."""
    batches = [
        [("a", 1, 0, 1.0), ("b", 2, 1, 1.0)],
        [("a", 3, 8, 2.0)],
        [("a", 4, 4, 4.0)],  # the watermark stands at 3 minutes
        [("a", 5, 30, 8.0)],
        [("z", 9, 30, 0.0)],  # rows are called late by the mark of the batch before
        [("a", 6, 20, 16.0), ("a", 7, 26, 32.0)],  # it stands at 25: 6 is too late
        [("z", 8, 100, 0.0)],
    ]
    made = held.held(stream(spark, folder("in", *batches)), "user", "id", "ts", "value", 600_000_000, "5 minutes")
    rows = windows.drained(made, "append", lambda: str(tmp_path / "out")).collect()
    found = {r["id"]: (r["key"], r["n_followers"], r["amount"]) for r in rows}
    assert found == {1: ("a", 2, 6.0), 2: ("b", 0, 0.0), 4: ("a", 1, 2.0), 3: ("a", 0, 0.0), 7: ("a", 1, 8.0), 5: ("a", 0, 0.0), 9: ("z", 0, 0.0)}
    assert len(rows) == 7


def test_state_is_let_go(spark, folder, tmp_path):
    """Many batches of a long stream: what is held at a time stays small, and nothing comes twice."""
    batches = [[(f"u{k % 3}", 100 * b + k, 20 * b + k, 1.0) for k in range(12)] for b in range(8)]
    made = held.held(stream(spark, folder("in", *batches)), "user", "id", "ts", "value", 300_000_000, "2 minutes")
    query = made.writeStream.format("memory").queryName("held_rows").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("held_rows").collect()
    every = [(u, i, m) for b in batches for u, i, m, _ in b]
    expected = {i: sum(u2 == u and m < m2 <= m + 5 for u2, _, m2 in every) for u, i, m in every if m + 5 <= 20 * 7 + 11 - 2}
    assert {r["id"]: r["n_followers"] for r in rows} == expected and len(rows) == len(expected)
    kept = [json.loads(p.json)["stateOperators"][0]["customMetrics"] for p in query.recentProgress if json.loads(p.json)["stateOperators"]]
    assert max(m.get("numListStateWithTTLVars", 0) for m in kept) == 0
    assert any(m.get("numDeletedTimers", 0) or m.get("numExpiredTimers", 0) or m.get("timerProcessingTimeMs", 0) for m in kept)


def test_windows_wait_for_the_slowest_stream(spark, folder, tmp_path):
    fast = folder("fast", [("f", k, k, 1.0) for k in range(0, 60, 5)], [("f", 99, 200, 1.0)], [("f", 98, 201, 1.0)])
    slow = folder("slow", [("s", k, k, 1.0) for k in range(0, 25, 5)], [("s", 50, 26, 1.0)], [("s", 51, 27, 1.0)])
    made = held.together([stream(spark, fast), stream(spark, slow)], "ts", "10 minutes", "1 minute", {"n": F.count("*")})
    rows = windows.drained(made, "append", lambda: str(tmp_path / "out")).collect()
    assert sorted((r["window_start"].minute, r["n"]) for r in rows) == [(0, 4), (10, 4)]


class Packs:
    """A key's list state, and its timers."""

    def __init__(self):
        self.packs, self.timers, self.moved = [], [], 0
        self.get, self.exists = lambda: iter(list(self.packs)), lambda: bool(self.packs)

    def getListState(self, name, schema):  # noqa: N802
        return self

    def appendList(self, made):  # noqa: N802
        self.packs += made
        self.moved += len(made)

    def put(self, made):
        self.packs, self.moved = list(made), self.moved + len(made)

    def clear(self):
        self.packs = []

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 12


def test_state_moves_by_packs_and_nothing_gives_no_frame():
    """A key's 50 rows of a batch were 50 calls' worth of state, and each key gave an empty frame."""
    import pandas as pd

    state = Packs()
    holder = held.Holder("key", 10_000)
    holder.init(state)
    batch = pd.DataFrame({"id": range(50), "us": [k * 100 for k in range(50)], "amount": [1.0] * 50})
    assert list(holder.handleInputRows(("a",), iter([batch]), state)) == []
    assert state.moved == 1 and state.timers == [10]
    out = list(holder.handleExpiredTimer(("a",), state, None))
    # the mark stands at 12 ms: rows up to 2 ms go, and have all later rows for followers
    assert [(r.id, r.n_followers) for f in out for r in f.itertuples()] == [(k, 49 - k) for k in range(21)]
    assert state.moved == 2 and state.timers[1:] == [13] and [len(c) for c in state.packs[0]] == [29] * 3
    state.getCurrentWatermarkInMs = lambda: 5
    assert list(holder.handleExpiredTimer(("a",), state, None)) == []
