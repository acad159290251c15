"""Texts cut into pieces, and state machines as a batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from brevia.functions import pieces
from brevia.streaming import keyed
from brevia.streaming.circuit_breaker import CircuitBreaker
from brevia.streaming.token_bucket import TokenBucket


def cut(spark, text, most):
    return spark.createDataFrame([(text,)], "t string").select(pieces.messages(F.col("t"), most).alias("m")).first().m


def test_messages(spark):
    assert cut(spark, None, 10) == [] and cut(spark, "", 10) == []
    assert cut(spark, "short", 10) == ["short"] and cut(spark, "a" * 10, 10) == ["a" * 10]
    assert cut(spark, "a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert cut(spark, "aaa\n\nbbb\n\nccc", 8) == ["aaa\n\nbbb", "ccc"]


def run(machine, events):
    state, out = machine.start(), []
    for t, ok in events:
        state, said = machine.step(state, t, ok)
        out.append(said)
    return out


def test_circuit_breaker_opens_tries_and_closes():
    told = run(CircuitBreaker(2, 60.0), [(0.0, False), (1.0, False), (2.0, True), (61.0, False), (62.0, True), (122.0, True), (123.0, False)])
    assert told == [("closed", True), ("closed", True), ("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]


def test_token_bucket():
    told = run(TokenBucket(2, 1.0), [(0.0, True), (0.1, True), (0.2, True), (0.5, True), (1.3, True)])
    assert told == [(True,), (True,), (False,), (False,), (True,)]


@pytest.mark.parametrize("machine", [TokenBucket(2, 0.01), CircuitBreaker(2, 500.0)])
def test_batch_keeps_state_over_arrow_batches(spark, machine):
    rows = [(k % 3, 1000 * k // 3, k) for k in range(600)]
    events = spark.createDataFrame(rows, "user_id long, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.event_id: tuple(r)[2:] for r in keyed.decide(events, "user_id", machine, F.col("event_id") % 4 != 0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for user in range(3):
        own = [(s, i) for u, s, i in rows if u == user]
        want |= dict(zip([i for _, i in own], run(machine, [(float(s), i % 4 != 0) for s, i in own]), strict=True))
    assert got == want


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    rows = [(k % 2, 100 * k, k, k % 3 != 0) for k in range(40)]
    schema = "user_id long, s long, event_id long, ok boolean"
    for part in (rows[:15], rows[15:]):  # two micro-batches: states go on between them
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, s long, event_id long, ok boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    machine = CircuitBreaker(2, 300.0)
    q = keyed.decide_stream(stream, "user_id", machine).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: (r.state, r.allowed) for r in spark.table("told").collect()}
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    assert got == {r.event_id: (r.state, r.allowed) for r in keyed.decide(batch, "user_id", machine, F.col("ok")).collect()} and len(got) == 40
