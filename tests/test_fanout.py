"""A stream to two sinks, of which one fails, and a run that broke off."""

import pytest
from pyspark.sql import functions as F

from brevia.storage import scratch
from brevia.streaming import fanout


def rows_of(sink, spark, schema):
    return sorted(r.id for r in sink.read(spark, schema).collect())


def test_failing_sinks_are_brought_level(spark):
    place = scratch(spark, "fan")
    rows = spark.range(90).withColumn("x", F.col("id") * 2)
    rows.repartition(3, "id").write.parquet(f"{place}/in")
    down = [True]

    def prepared(df):
        if down[0]:
            raise OSError("unreachable")
        return df

    first, second, third = fanout.Sink(f"{place}/1"), fanout.Sink(f"{place}/2", "json", prepared), fanout.Sink(f"{place}/3", "csv")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    others = {"second": second, "third": third}
    fanout.run(stream(), first, others, f"{place}/checkpoint")
    assert rows_of(first, spark, rows.schema) == rows_of(third, spark, rows.schema) == list(range(90))
    assert rows_of(second, spark, rows.schema) == []
    assert {(r.sink, r.batch) for r in fanout.lag(spark, first, others).collect()} == {("second", k) for k in range(3)}
    with pytest.raises(OSError):
        fanout.level(spark, first, second, rows.schema)
    down[0] = False
    spark.range(90, 100).withColumn("x", F.col("id")).coalesce(1).write.mode("append").parquet(f"{place}/in")
    fanout.run(stream(), first, others, f"{place}/checkpoint")
    assert rows_of(second, spark, rows.schema) == list(range(90, 100))
    assert fanout.level(spark, first, second, rows.schema) == [0, 1, 2] and fanout.level(spark, first, second, rows.schema) == []
    assert rows_of(second, spark, rows.schema) == list(range(100))
    # the stream forgets where it was: its batches come again, and are passed over
    fanout.run(stream(), first, others, f"{place}/other")
    assert rows_of(first, spark, rows.schema) == rows_of(second, spark, rows.schema) == list(range(100))


def test_a_batch_that_was_not_noted_is_written_over(spark):
    sink = fanout.Sink(scratch(spark, "sink"))
    rows = spark.range(5)
    rows.write.parquet(f"{sink.path}/batches/batch=7")  # broke off before the note
    assert sink.read(spark, rows.schema).collect() == []
    sink.write(spark.range(3), 7)
    sink.write(spark.range(9), 7)
    assert rows_of(sink, spark, rows.schema) == [0, 1, 2]
    sink.write(spark.range(0), 8)
    assert sink.noted(spark) == {7, 8}
