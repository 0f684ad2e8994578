"""Streaming queries, run to the end of what is available; the oracle gives the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans import model as m
from marlstone.plans import sessions
from marlstone.registry import query
from marlstone.streaming import events as ev


def _stream(spark, sf) -> DataFrame:
    return ev.events_stream(spark, f"{sf}/events.parque[t]")  # a pattern: a stream source takes a folder or a pattern, not one file


@query("stream_type_totals", "SELECT event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_type_totals(spark, sf) -> DataFrame:
    return ev.run_available(ev.error_stats(_stream(spark, sf)), "complete")


@query("stream_tumbling_sessions", f"WITH {m.LOG} SELECT session_id, count(*) AS n, (floor(ts / 300) * 300)::BIGINT AS start FROM ev GROUP BY 1, 3")
def stream_tumbling_sessions(spark, sf) -> DataFrame:
    out = ev.run_available(ev.tumbling_sessions(_stream(spark, sf)), "complete")
    return out.select("session_id", "n", F.unix_timestamp("start").alias("start"))


@query("stream_sliding_rates", f"WITH {m.LOG} SELECT doc_id, (floor(ts / 21600) * 21600 - k * 21600)::BIGINT AS start, count(*) AS n FROM ev, range(0, 4) r(k) GROUP BY 1, 2")
def stream_sliding_rates(spark, sf) -> DataFrame:
    out = ev.run_available(ev.sliding_rates(_stream(spark, sf)), "complete")
    return out.select("doc_id", F.unix_timestamp("start").alias("start"), "n")


@query("stream_first_deliveries", f"WITH {m.LOG} SELECT DISTINCT session_id, doc_id FROM ev")
def stream_first_deliveries(spark, sf) -> DataFrame:
    return ev.run_available(ev.first_deliveries(_stream(spark, sf)))


@query("stream_requeries", f"WITH {m.LOG} SELECT a.session_id, a.event_id, b.event_id AS later_id FROM ev a JOIN ev b ON a.session_id = b.session_id AND b.ts > a.ts AND b.ts <= a.ts + 3600")
def stream_requeries(spark, sf) -> DataFrame:
    return ev.run_available(ev.requeries(_stream(spark, sf), _stream(spark, sf)))


@query("stream_last_seen", f"WITH {m.LOG} SELECT session_id, round_even(max(ts), 3) AS last_seen, least(count(*), 100) AS held, count(*) AS total FROM ev GROUP BY 1")
def stream_last_seen(spark, sf) -> DataFrame:
    out = ev.run_available(ev.last_seen(_stream(spark, sf)), "update", ["session_id"])
    return out.select("session_id", F.bround("last_seen", 3).alias("last_seen"), "held", "total")


@query("stream_presence_changes", sessions.changes_sql("max(us) // 1000 * 1000 - 86400000000"))
def stream_presence_changes(spark, sf) -> DataFrame:
    """Changes of status by timers, up to the watermark, a day behind the last heartbeat."""
    return ev.run_available(ev.presence_changes(_stream(spark, sf), *sessions.AGES, "1 day"))
