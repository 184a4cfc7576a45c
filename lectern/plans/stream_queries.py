"""Batch twins of the streaming operators over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import Tables, query


@query("x_tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t: Tables):
    return S.tumbling(t.events).withColumn("total", F.round("total", 4))


@query("x_sliding_windows", "SELECT time_bucket(INTERVAL '15 minutes', ts) - INTERVAL (15 * k) MINUTE AS start, count(*) AS n FROM events, range(4) r(k) GROUP BY 1")
def sliding(t: Tables):
    return S.sliding(t.events)


@query("s13_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def sessions(t: Tables):
    return S.sessions(t.events)


@query("x_event_dedup", "SELECT DISTINCT event_id FROM events")
def once(t: Tables):
    return S.once(t.events).select("event_id")


@query("x_followed_by", "SELECT a.event_id AS a, b.event_id AS b, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1 hour' WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def followed(t: Tables):
    return S.followed(t.events.where("event_type = 'click'"), t.events.where("event_type = 'purchase'"))
