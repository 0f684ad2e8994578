"""Session and event operators: windows over each session's events."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as fx


def requery_bucket(events: DataFrame, seconds: float = 60.0, now: float | None = None) -> DataFrame:
    """``bucket`` B if the session's next event follows within ``seconds`` (that bound included), else A.

    With ``now`` only events older than ``seconds`` are settled; younger ones get null.
    """
    after = F.lead("ts").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    bucket = F.when(after - F.col("ts") <= seconds, "B").otherwise("A")
    if now is not None:
        bucket = F.when(F.col("ts") <= now - seconds, bucket)
    return events.withColumn("bucket", bucket)


def bucket_gap(events: DataFrame) -> DataFrame:
    """Counts of A and B and the squared gap (f_A - f_B)^2 of each session with two settled events or more."""
    a, n = F.count_if(F.col("bucket") == "A"), F.count("bucket")
    g = events.groupBy("session_id").agg(a.alias("n_a"), (n - a).alias("n_b"))
    total = F.col("n_a") + F.col("n_b")
    return g.withColumn("f_gap_sq", F.when(total >= 2, fx.round6(F.pow((F.col("n_a") - F.col("n_b")) / total, 2))))


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key by ``by``, later columns breaking ties."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in by))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mean_gap(rows: DataFrame) -> DataFrame:
    """(session_id, n, mean_gap): mean time between a session's events."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    return rows.withColumn("_g", gap).groupBy("session_id").agg(F.count("*").alias("n"), fx.round6(F.avg("_g")).alias("mean_gap"))


def sliding_rate(rows: DataFrame, seconds: int) -> DataFrame:
    """``rate``: the session's events of the last ``seconds`` up to each event, a second."""
    w = Window.partitionBy("session_id").orderBy(F.round(F.col("ts") * 1_000_000).cast("long")).rangeBetween(-int(seconds) * 1_000_000, 0)
    return rows.withColumn("rate", fx.round6(F.count("*").over(w) / F.lit(float(seconds))))


def correlations(rows: DataFrame, features: list[str], last: int = 50) -> DataFrame:
    """(session_id, x, y, corr) of every two features over the session's last rows; 0 without variance."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    pairs = list(combinations(features, 2))
    n, out = F.count("*"), []
    for x, y in pairs:
        cov = F.sum(F.col(x) * F.col(y)) / n - F.avg(x) * F.avg(y)
        vx, vy = F.sum(F.col(x) * F.col(x)) / n - F.avg(x) * F.avg(x), F.sum(F.col(y) * F.col(y)) / n - F.avg(y) * F.avg(y)
        out.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when((vx > 1e-9) & (vy > 1e-9), F.bround(cov / F.sqrt(vx * vy), 4)).otherwise(0.0).alias("corr")))
    return few.groupBy("session_id").agg(F.array(*out).alias("c")).select("session_id", F.inline("c"))


def synthetic_session(client: Column, ts: Column, seconds: int = 300) -> Column:
    """A client's session id for its tumbling window of ``seconds``."""
    return F.sha1(F.concat_ws(":", client.cast("string"), (F.floor(ts / seconds) * seconds).cast("long").cast("string")))


def presence(beats: DataFrame, now: float, active: float = 120.0, idle: float = 240.0, gone: float = 86400.0, delete: float = 7 * 86400.0) -> DataFrame:
    """(session_id, last_seen, status) by the age of the last heartbeat: active, idle, stale, gone; older than ``delete`` there is no row."""
    age = F.lit(now) - F.col("last_seen")
    status = F.when(age <= active, "active").when(age <= idle, "idle").when(age <= gone, "stale").otherwise("gone")
    return beats.groupBy("session_id").agg(F.max("ts").alias("last_seen")).where(age <= delete).withColumn("status", status)


def presence_changes(beats: DataFrame, until_us: Column | int, active: float = 120.0, idle: float = 240.0, gone: float = 86400.0, delete: float = 7 * 86400.0) -> DataFrame:
    """Every change of status before ``until_us``: (session_id, at_us, status), from heartbeats (session_id, us).

    A run of heartbeats at most ``active`` seconds apart begins with the change to active; each later status
    follows when the last heartbeat is more than its age old and no heartbeat has come before. Rows without
    a session or a time are dropped, equal heartbeats count once.
    """
    by = Window.partitionBy("session_id").orderBy("us")
    ages = F.array(*(F.struct(F.lit(int(age * 1e6)).cast("long").alias("age"), F.lit(name).alias("status")) for age, name in ((active, "idle"), (idle, "stale"), (gone, "gone"), (delete, "deleted"))))
    near = beats.where("session_id IS NOT NULL AND us IS NOT NULL").select("session_id", "us").distinct()
    near = near.withColumn("before", F.lag("us").over(by)).withColumn("after", F.lead("us").over(by))
    begins = F.col("before").isNull() | (F.col("us") - F.col("before") > int(active * 1e6))
    start = F.when(begins, F.array(F.struct(F.lit(0).cast("long").alias("age"), F.lit("active").alias("status")))).otherwise(F.array().cast("array<struct<age:bigint,status:string>>"))
    rest = F.filter(ages, lambda x: F.col("after").isNull() | (F.col("after") > F.col("us") + x.age))
    return near.select("session_id", "us", F.explode(F.concat(start, rest)).alias("x")).select("session_id", (F.col("us") + F.col("x.age")).alias("at_us"), F.col("x.status").alias("status")).where(F.col("at_us") < until_us)


def elide(deliveries: DataFrame) -> DataFrame:
    """``repeat`` and the time of the first delivery of each document in its session."""
    w = Window.partitionBy("session_id", "doc_id").orderBy("ts", "event_id")
    return deliveries.withColumn("repeat", F.row_number().over(w) > 1).withColumn("first_at", F.first("ts").over(w))


def hitl_stats(rows: DataFrame, kind: str) -> DataFrame:
    """Per session: all events, those of ``kind``, their mean value, and the rate of ``kind`` an hour of its span."""
    of = F.col("event_type") == kind
    span = F.max("ts") - F.min("ts")
    return rows.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(of).alias("of_kind"), fx.round6(F.avg(F.when(of, F.col("value")))).alias("mean_value"), fx.round6(F.when(span > 0, F.count_if(of) * 3600.0 / span)).alias("per_hour"))


def temporal_context(turns: DataFrame, dim: int = 20, beta: float = 0.5) -> DataFrame:
    """Temporal context of each session: (session_id, turn, bonus).

    Context t <- rho t + beta v, with v the unit input vector of the turn made orthogonal to t and
    rho = sqrt(1 - beta^2); the bonus of a turn is max(0, 0.3 cos(input, context before)). A
    recurrence over a session's ordered turns (bounded by the session), so each session is one group.
    """

    def run(s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("turn")
        t, out = np.zeros(dim), []
        for vector in s["vector"]:
            v = np.asarray(vector, float)
            v = v / n if (n := np.linalg.norm(v)) else v
            c = np.linalg.norm(t)
            out.append(round(max(0.0, 0.3 * float(v @ t) / c), 6) if c else 0.0)
            u = v - (v @ t) / (c * c) * t if c else v
            u = u / k if (k := np.linalg.norm(u)) > 1e-12 else u
            t = np.sqrt(1 - beta * beta) * (t / c) + beta * u if c else u
        return pd.DataFrame({"session_id": s["session_id"], "turn": s["turn"], "bonus": out})

    return turns.select("session_id", "turn", "vector").groupBy("session_id").applyInPandas(run, "session_id long, turn long, bonus double")


def hash_vector(text: Column, dim: int = 20) -> Column:
    """A vector of a text without a model: each entry from a byte pair of hashes of text and place, -1 to 1."""
    entry = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", text, i.cast("string")).cast("binary")), 1, 4), 16, 10).cast("double") / 32767.5 - 1
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), entry)
