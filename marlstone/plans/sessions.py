"""Session queries over the events (as query log, deliveries, heartbeats) and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import sessions as s
from marlstone.plans import model as m
from marlstone.registry import query

HOUR = 3600.0


@query("requery_buckets", f"WITH {m.LOG} SELECT event_id, session_id, ts, CASE WHEN lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) - ts <= 3600 THEN 'B' ELSE 'A' END AS bucket FROM ev")
def requery_buckets(spark, sf) -> DataFrame:
    return s.requery_bucket(m.query_log(spark, sf), HOUR).select("event_id", "session_id", "ts", "bucket")


B = f"{m.LOG}, b AS (SELECT *, CASE WHEN ts <= (SELECT max(ts) FROM ev) - 3600 THEN CASE WHEN lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) - ts <= 3600 THEN 'B' ELSE 'A' END END AS bucket FROM ev)"


@query(
    "bucket_gap",
    f"WITH {B}, g AS (SELECT session_id, count(*) FILTER (WHERE bucket = 'A') AS n_a, count(bucket) - count(*) FILTER (WHERE bucket = 'A') AS n_b FROM b GROUP BY 1) SELECT *, CASE WHEN n_a + n_b >= 2 THEN round_even(pow((n_a - n_b) / (n_a + n_b)::DOUBLE, 2), 6) END AS f_gap_sq FROM g",
)
def bucket_gap(spark, sf) -> DataFrame:
    log = m.query_log(spark, sf)
    return s.bucket_gap(s.requery_bucket(log, HOUR, now=log.agg(F.max("ts")).first()[0]))


@query("latest_delivery", f"WITH {m.LOG} SELECT session_id, doc_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY session_id, doc_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1")
def latest_delivery(spark, sf) -> DataFrame:
    return s.latest(m.query_log(spark, sf), ["session_id", "doc_id"], ["ts", "event_id"]).select("session_id", "doc_id", "event_id", "ts")


@query("delivery_elision", f"WITH {m.LOG} SELECT event_id, session_id, doc_id, row_number() OVER w > 1 AS repeat, first_value(ts) OVER w AS first_at FROM ev WINDOW w AS (PARTITION BY session_id, doc_id ORDER BY ts, event_id)")
def delivery_elision(spark, sf) -> DataFrame:
    return s.elide(m.query_log(spark, sf)).select("event_id", "session_id", "doc_id", "repeat", "first_at")


@query("session_manifest", f"WITH {m.LOG} SELECT * FROM (SELECT session_id, event_id, doc_id, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS position FROM ev) WHERE position <= 500")
def session_manifest(spark, sf) -> DataFrame:
    """Each session's deliveries, newest first, 500 at most (the listing's size)."""
    from marlstone.operators.tiers import top

    return top(m.query_log(spark, sf).select("session_id", "event_id", "doc_id", "ts", F.negative("event_id").alias("_e")), 500, "session_id", "ts", "_e").select("session_id", "event_id", "doc_id", "ts", F.col("rank").alias("position"))


@query("session_mean_gap", f"WITH {m.LOG}, g AS (SELECT session_id, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS gap FROM ev) SELECT session_id, count(*) AS n, round_even(avg(gap), 6) AS mean_gap FROM g GROUP BY 1")
def session_mean_gap(spark, sf) -> DataFrame:
    return s.mean_gap(m.query_log(spark, sf))


@query("sliding_access_rate", f"WITH {m.LOG} SELECT event_id, session_id, round_even(count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 86400.0::DOUBLE, 6) AS rate FROM ev")
def sliding_access_rate(spark, sf) -> DataFrame:
    return s.sliding_rate(m.query_log(spark, sf), 86400).select("event_id", "session_id", "rate")


FEATURES = ["f0", "f1", "f2"]
FEAT = "fe AS (SELECT event_id, session_id, ts, value AS f0, (doc_id % 10)::DOUBLE AS f1, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::DOUBLE AS f2 FROM ev)"


def _corr_sql() -> str:
    one = lambda x, y: f"SELECT session_id, '{x}' AS x, '{y}' AS y, CASE WHEN sum({x} * {x}) / count(*) - avg({x}) * avg({x}) > 1e-9 AND sum({y} * {y}) / count(*) - avg({y}) * avg({y}) > 1e-9 THEN round_even((sum({x} * {y}) / count(*) - avg({x}) * avg({y})) / sqrt((sum({x} * {x}) / count(*) - avg({x}) * avg({x})) * (sum({y} * {y}) / count(*) - avg({y}) * avg({y}))), 4) ELSE 0.0 END AS corr FROM last GROUP BY session_id"
    return f"WITH {m.LOG}, {FEAT}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM fe) WHERE r <= 50) " + " UNION ALL ".join(one(x, y) for x, y in (("f0", "f1"), ("f0", "f2"), ("f1", "f2")))


@query("feature_correlations", _corr_sql())
def feature_correlations(spark, sf) -> DataFrame:
    rows = m.query_log(spark, sf).select("event_id", "session_id", "ts", F.col("value").alias("f0"), (F.col("doc_id") % 10).cast("double").alias("f1"), F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("f2"))
    return s.correlations(rows, FEATURES)


@query("synthetic_sessions", f"WITH {m.LOG} SELECT sha1(session_id || ':' || (floor(ts / 300) * 300)::BIGINT) AS synthetic_id, session_id, count(*) AS n FROM ev GROUP BY ALL")
def synthetic_sessions(spark, sf) -> DataFrame:
    """Sessions of 300-second windows."""
    key = s.synthetic_session(F.col("session_id"), F.col("ts"))
    return m.query_log(spark, sf).select(key.alias("synthetic_id"), "session_id").groupBy("synthetic_id", "session_id").agg(F.count("*").alias("n"))


@query("presence_status", f"WITH {m.LOG}, n AS (SELECT max(ts) AS now FROM ev), l AS (SELECT session_id, max(ts) AS last_seen FROM ev GROUP BY 1) SELECT session_id, last_seen, CASE WHEN now - last_seen <= 3600 THEN 'active' WHEN now - last_seen <= 14400 THEN 'idle' WHEN now - last_seen <= 86400 THEN 'stale' ELSE 'gone' END AS status FROM l, n WHERE now - last_seen <= 604800")
def presence_status(spark, sf) -> DataFrame:
    log = m.query_log(spark, sf)
    return s.presence(log, log.agg(F.max("ts")).first()[0], 3600.0, 14400.0, 86400.0)


def changes_sql(until: str) -> str:
    """The changes of presence before ``until``, an expression over the heartbeats ``b``."""
    ages = "(VALUES (3600000000, 'idle'), (14400000000, 'stale'), (86400000000, 'gone'), (604800000000, 'deleted')) a(age, status)"
    return f"""WITH b AS (SELECT DISTINCT user_id AS session_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, lag(us) OVER w AS before, lead(us) OVER w AS after FROM b WINDOW w AS (PARTITION BY session_id ORDER BY us)),
c AS (SELECT session_id, us AS at_us, 'active' AS status FROM g WHERE before IS NULL OR us - before > 3600000000
UNION ALL SELECT session_id, us + age, status FROM g, {ages} WHERE after IS NULL OR after > us + age)
SELECT session_id, at_us, status FROM c WHERE at_us < (SELECT {until} FROM b)"""


AGES = (3600.0, 14400.0, 86400.0, 604800.0)


@query("presence_changes", changes_sql("max(us) + 1"))
def presence_changes(spark, sf) -> DataFrame:
    """All changes of status up to the last heartbeat."""
    beats = m.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return s.presence_changes(beats, (beats.agg(F.max("us")).first()[0] or 0) + 1, *AGES)


@query(
    "hitl_stats",
    f"WITH {m.LOG} SELECT session_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS of_kind, round_even(avg(value) FILTER (WHERE event_type = 'error'), 6) AS mean_value, round_even(CASE WHEN max(ts) - min(ts) > 0 THEN count(*) FILTER (WHERE event_type = 'error') * 3600.0 / (max(ts) - min(ts)) END, 6) AS per_hour FROM ev GROUP BY 1",
)
def hitl_stats(spark, sf) -> DataFrame:
    return s.hitl_stats(m.query_log(spark, sf), "error")


@query("hitl_filter", f"WITH {m.LOG} SELECT event_id, session_id, ts, value FROM ev WHERE event_type = 'error' AND session_id < 50 AND value > 10 ORDER BY ts DESC, event_id DESC LIMIT 100")
def hitl_filter(spark, sf) -> DataFrame:
    """A listing: optional predicates together, newest first, 100 rows."""
    return m.query_log(spark, sf).where("event_type = 'error' AND session_id < 50 AND value > 10").select("event_id", "session_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("event_counts_since", f"WITH {m.LOG} SELECT session_id, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM ev) - 604800) AS last_week, count(*) AS n FROM ev GROUP BY 1")
def event_counts_since(spark, sf) -> DataFrame:
    log = m.query_log(spark, sf)
    now = F.broadcast(log.agg(F.max("ts").alias("now")))
    return log.join(now).groupBy("session_id").agg(F.count_if(F.col("ts") > F.col("now") - 604800).alias("last_week"), F.count("*").alias("n"))


@query("type_health", "SELECT event_type, count(*) AS n, round_even(avg(value), 6) AS avg_value, round_even(min(value), 6) AS min_value, round_even(max(value), 6) AS max_value, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def type_health(spark, sf) -> DataFrame:
    r = lambda c: F.bround(c, 6)
    return m.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("avg_value"), r(F.min("value")).alias("min_value"), r(F.max("value")).alias("max_value"), F.countDistinct("user_id").alias("sessions"))


@query("retention_rollup", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def retention_rollup(spark, sf) -> DataFrame:
    return m.table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total"))


@query("turn_pairs", "SELECT conv_id, turn, text AS prompt, reply FROM (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def turn_pairs(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = m.table(spark, sf, "conversations").withColumn("reply", F.lead("text").over(w)).withColumn("_n", F.lead("role").over(w))
    return c.where("role = 'user' AND _n = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "reply")


@query("temporal_context")
def temporal_context(spark, sf) -> DataFrame:
    """A recurrence over each conversation's turns; tested against a plain loop."""
    c = m.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", s.hash_vector(F.col("text")).alias("vector"))
    return s.temporal_context(c)
