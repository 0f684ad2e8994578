"""Changes of presence: the batch form against a plain loop, the stream against the batch form at every watermark."""

import random

from pyspark.sql import functions as F

from marlstone.operators import sessions as s
from marlstone.streaming import events as ev

AGES = (60.0, 180.0, 900.0, 3600.0)
NAMES = ("idle", "stale", "gone", "deleted")


def plain(beats, until):
    out, by = [], {}
    for session, at in beats:
        if session is not None and at is not None:
            by.setdefault(session, set()).add(at)
    for session, stamps in by.items():
        status, last = None, None
        for at in [*sorted(stamps), 10**18]:
            if last is not None:
                for age, name in zip(AGES, NAMES, strict=True):
                    if at > last + int(age * 1e6):
                        status = name
                        out.append((session, last + int(age * 1e6), name))
            if status != "active" and at < 10**18:
                status = "active"
                out.append((session, at, "active"))
            last = at
    return sorted(x for x in out if x[1] < until)


def made(seed, sessions=12):
    rng, out = random.Random(seed), []
    for session in range(sessions):
        at = rng.randrange(10**9) * 1000
        for _ in range(rng.randrange(1, 40)):
            out.append((session, at))
            at += rng.choice([0, 1, 59_999_999, 60_000_000, 60_000_001, 180_000_000, rng.randrange(300) * 1_000_000, 900_000_001, 3_600_000_000, 3_600_000_001])
    return out


def test_batch_equals_a_plain_loop(spark):
    beats = [*made(1), (None, 5), (3, None), *made(1)[:10]]
    for until in (10**18, 800_000_000_000):
        found = s.presence_changes(spark.createDataFrame(beats, "session_id long, us long").withColumn("status", F.lit("x")), until, *AGES)
        assert sorted(map(tuple, found.collect())) == plain(beats, until)
    assert s.presence_changes(spark.createDataFrame([], "session_id long, us long"), 1, *AGES).count() == 0


def test_stream_equals_batch_at_every_watermark(spark, tmp_path):
    """Four files one after the other, each up to ten minutes out of order, the query stopped and started again between them."""
    beats = sorted(made(2), key=lambda x: x[1])
    rng = random.Random(3)
    mixed = sorted(beats, key=lambda x: x[1] + rng.randrange(600) * 1_000_000)
    given, late, folder = [], 1200, f"{tmp_path}/events"
    size = -(-len(mixed) // 4)
    for k in range(4):
        part = mixed[k * size : (k + 1) * size]
        given += part
        rows = [(i, us, session, "beat", 1.0, "{}") for i, (session, us) in enumerate(part)] + [(-1, part[0][1], None, "beat", 0.0, "{}")]
        spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string").select(
            "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props"
        ).coalesce(1).write.mode("append").parquet(folder)
        changes = ev.presence_changes(ev.events_stream(spark, folder, 1), *AGES, f"{late} seconds")
        q = changes.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
        until = (max(us for _, us in given) // 1000 - late * 1000) * 1000
        found = sorted(map(tuple, spark.read.schema("session_id long, at_us long, status string").parquet(f"{tmp_path}/out").collect()))
        assert found == plain(given, until), k
    assert {x[2] for x in found} == {"active", *NAMES}
