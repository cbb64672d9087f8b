"""Queries that run as streams over `events` and must equal their batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import held
from ..streaming import windows as W
from .registry import query


def _folder(spark) -> str:
    """A new folder beside the shared checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return W.stream(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(rows):
    """Window starts without a time zone, as the tables have their times."""
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("T02_tumbling_windows", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t02(spark, sf):
    made = W.tumbling(_events(spark, sf), "ts", "6 hours", "1 day", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})
    return _plain(W.drained(made, "complete", lambda: _folder(spark)))


@query("T04_evicted_windows", """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING window_start + INTERVAL '6 hours' <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL '1 hour'""")
def t04(spark, sf):
    """Windows that the watermark has closed; the last ones stay open until later rows come."""
    made = W.tumbling(_events(spark, sf), "ts", "6 hours", "1 hour", ["event_type"], {"n": F.count("*")})
    return _plain(W.drained(made, "append", lambda: _folder(spark)))


@query("T04_held_rows", """WITH e AS (SELECT user_id AS key, event_id AS id, ts AS time, value FROM events)
SELECT a.key, a.id, a.time, count(b.id) AS n_followers, round(coalesce(sum(b.value), 0), 4) AS amount FROM e a LEFT JOIN e b ON a.key = b.key AND b.time > a.time AND b.time <= a.time + INTERVAL '6 hours'
WHERE a.time + INTERVAL '6 hours' <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL '1 hour' GROUP BY a.key, a.id, a.time""")
def t04_held(spark, sf):
    """Events with their followers of six hours, each held in state until no more of them can come."""
    made = held.held(_events(spark, sf), "user_id", "event_id", "ts", "value", 6 * 3_600_000_000, "1 hour")
    rows = W.drained(made, "append", lambda: _folder(spark))
    return rows.withColumns({"time": F.col("time").cast("timestamp_ntz"), "amount": F.round("amount", 4)})


@query("T06_streams_together", """WITH b AS (SELECT min(last) AS passed FROM (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' AS last FROM events GROUP BY event_type))
SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(max(value), 4) AS most FROM events, b GROUP BY 1 HAVING window_start + INTERVAL '6 hours' <= any_value(passed)""")
def t06_streams(spark, sf):
    """A stream for each kind of event; windows come when all of them have passed."""
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(100).collect()]
    streams = [_events(spark, sf).where(F.col("event_type") == k) for k in kinds]
    made = held.together(streams, "ts", "6 hours", "1 hour", {"n": F.count("*"), "most": F.round(F.max("value"), 4)})
    return _plain(W.drained(made, "append", lambda: _folder(spark)))


@query("T03_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '12 hours' AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def t03(spark, sf):
    made = W.sessions(_events(spark, sf), "ts", "12 hours", "1 day", ["user_id"], {"n": F.count("*")})
    return _plain(W.drained(made, "complete", lambda: _folder(spark))).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("T01_positions_as_time", "SELECT make_timestamp((l_partkey // 160 * 160 * 1000000)::BIGINT) AS window_start, count(*) AS total FROM lineitem GROUP BY ALL")
def t01(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    rows = W.position_time(W.stream(spark, f"{sf}/lineitem.parquet", schema), "l_partkey")
    return _plain(W.drained(W.tumbling(rows, "at", "160 seconds", "100000 seconds", [], {"total": F.count("*")}), "complete", lambda: _folder(spark)))


@query("T05_ordered_events", "SELECT event_id, ts FROM events")
def t05(spark, sf):
    """Events in the order of their ids, which must be that of their times for each user; else it is an error."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts").withColumn("sequence", F.col("event_id"))
    return W.ordered_or_error(rows, ["user_id"], "ts").select("event_id", "ts")


@query("T06_samples_together", """WITH m AS (SELECT min(p) AS barrier FROM (SELECT max(pos) AS p FROM bases_v GROUP BY sample))
SELECT pos // 40 AS chunk, count(DISTINCT sample) AS samples, count(*) AS n FROM bases_v, m WHERE (pos // 40 + 1) * 40 <= barrier GROUP BY ALL""")
def t06(spark, sf):
    from ..standins import view

    ready = W.ready_chunks(view(spark, sf, "bases_v"), "pos", 40)
    return ready.groupBy("chunk").agg(F.countDistinct("sample").alias("samples"), F.count("*").alias("n"))


@query("T07_overlapping_chunks", """WITH c AS (SELECT start, unnest(range(start // 160, (start + 250) // 160 + 1)) AS chunk FROM reads_v)
SELECT chunk, count(*) FILTER (chunk = start // 160) AS own, count(*) FILTER (chunk <> start // 160) AS early FROM c GROUP BY chunk""")
def t07(spark, sf):
    from ..standins import view

    rows = W.overlapping_chunks(view(spark, sf, "reads_v").select("start"), "start", 160, 250)
    return rows.groupBy("chunk").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("early"))


@query("T08_drained_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def t08(spark, sf):
    made = _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return W.drained(made, "complete", lambda: _folder(spark))
