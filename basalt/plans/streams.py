"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.sessions import distinct_events, run_to_table, sessionised


def session_runs(spark, d):
    s = sessionised(table(spark, d, "events"))
    return s.select("user_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "events")


_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS events FROM s GROUP BY user_id, run
"""


def stream_distinct_events(spark, d):
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return run_to_table(distinct_events(source, "event_id").select("event_id", "user_id", "event_type"))


QUERIES = {"stream_session_runs": session_runs, "stream_distinct_events": stream_distinct_events}
SQL = {"stream_session_runs": _SESSIONS, "stream_distinct_events": "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events"}
