"""State machines with resets, changes of settings and states that age: batch, stream and the plain loop."""

import numpy as np
from pyspark.sql import functions as F

from brevia.streaming import keyed
from brevia.streaming.token_bucket import TokenBucket

FIRST, LATER = TokenBucket(2, 1 / 60), TokenBucket(1, 1 / 600)
CHANGES = ((2_000.0, FIRST), (4_000.0, LATER))
IDLE = 400.0


def loop(events, resets):
    """events: (user, second, id); resets: (user, second)."""
    out, held = {}, {}
    for t, is_event, user, k in sorted([(t, 0, u, -1) for u, t in resets] + [(t, 1, u, k) for u, t, k in events]):
        era = sum(t >= c[0] for c in CHANGES)
        if not is_event:
            held.pop(user, None)
            continue
        bucket = (FIRST, FIRST, LATER)[era]
        state, last, old = held.get(user, (None, None, None))
        if state is None or old != era or t - last > IDLE:
            state = bucket.start()
        state, (allowed,) = bucket.step(state, float(t))
        held[user], out[k] = (state, t, era), allowed
    return out


def made():
    rng = np.random.default_rng(10)
    times = np.sort(rng.integers(0, 6_000, 300))
    events = [(int(u), int(t), k) for k, (u, t) in enumerate(zip(rng.integers(0, 5, 300), times, strict=True))]
    return events, [(int(u), int(t)) for u, t in zip(rng.integers(0, 5, 25), rng.integers(0, 6_000, 25), strict=True)]


def tables(spark, events, resets):
    e = spark.createDataFrame([(u, t, k, True) for u, t, k in events], "user_id long, s long, event_id long, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    return e, spark.createDataFrame(resets, "user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_batch_as_the_loop(spark):
    events, resets = made()
    e, r = tables(spark, events, resets)
    got = {x.event_id: x.allowed for x in keyed.decide(e.repartition(3), "user_id", FIRST, resets=r, changes=CHANGES, idle=IDLE).collect()}
    assert got == loop(events, resets) and len(set(got.values())) == 2
    assert got != {x.event_id: x.allowed for x in keyed.decide(e, "user_id", FIRST).collect()}


def test_stream_as_the_loop(spark, tmp_path):
    """Three micro-batches in order of time; resets come in the same stream."""
    events, resets = made()
    for k in range(3):
        inside = lambda t: 2_000 * k <= t < 2_000 * (k + 1)  # noqa: B023, E731
        e, r = tables(spark, [x for x in events if inside(x[1])], [x for x in resets if inside(x[1])])
        both = e.withColumn("is_reset", F.lit(False)).unionByName(r.withColumns({"event_id": F.lit(None).cast("long"), "ok": F.lit(True), "is_reset": F.lit(True)}))
        both.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, s long, event_id long, ok boolean, ts timestamp, is_reset boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    said = keyed.decide_stream(stream.where("NOT is_reset"), "user_id", FIRST, IDLE, stream.where("is_reset"), CHANGES)
    q = said.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {x.event_id: x.allowed for x in spark.table("limited").collect()} == loop(events, resets)
