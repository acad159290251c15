"""One stream to several sinks (SNK4): the first always, the others as well as they can.

Each micro-batch goes to the primary sink, then to the secondary ones. A sink keeps a batch as one folder, which is replaced as a
whole, and notes its number in a ledger when the folder is complete. A batch that the stream gives again (it broke off
before its own checkpoint) is written over itself or, if noted, passed over. A secondary sink that fails is only logged: it
lacks the batch in its ledger, and level() brings it from the primary, as often as it takes, without doubles.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
NOTE = "batch long, rows long"


@dataclass(frozen=True)
class Sink:
    """Batches of rows under a folder, in one of Spark's file formats. prepared: what is done to a batch before it is written."""

    path: str
    format: str = "parquet"
    prepared: Callable[[DataFrame], DataFrame] = lambda df: df

    def noted(self, spark: SparkSession) -> set[int]:
        """The numbers of the batches that are complete."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return set()
        return {r.batch for r in spark.read.schema(NOTE).parquet(f"{self.path}/ledger").select("batch").collect()}

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in self.noted(spark):
            return
        self.prepared(batch).write.mode("overwrite").format(self.format).save(f"{self.path}/batches/batch={number}")
        rows = self._read(spark, batch.schema, [number]).count()
        spark.createDataFrame([(number, rows)], NOTE).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def _read(self, spark: SparkSession, schema, numbers) -> DataFrame:
        paths = [f"{self.path}/batches/batch={k}" for k in sorted(numbers)]
        return spark.read.format(self.format).schema(schema).load(paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The rows of all complete batches."""
        return self._read(spark, schema, self.noted(spark))


def run(stream: DataFrame, primary: Sink, secondary: dict[str, Sink], checkpoint: str) -> None:
    """All that the stream holds now, micro-batch by micro-batch, to all sinks. An error of the primary ends the run."""

    def each(batch: DataFrame, number: int) -> None:
        primary.write(batch, number)
        for name, sink in secondary.items():
            try:
                sink.write(batch, number)
            except Exception:  # the primary has the batch: level() brings it later
                LOG.warning("sink %s lacks batch %d", name, number, exc_info=True)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def level(spark: SparkSession, primary: Sink, secondary: Sink, schema) -> list[int]:
    """Brings the batches that the secondary sink lacks, one by one, and returns their numbers."""
    lacking = sorted(primary.noted(spark) - secondary.noted(spark))
    for number in lacking:
        secondary.write(primary._read(spark, schema, [number]), number)
    return lacking


def lag(spark: SparkSession, primary: Sink, secondary: dict[str, Sink]) -> DataFrame:
    """(sink, batch, rows) of the batches that each secondary sink lacks."""
    notes = spark.read.schema(NOTE).parquet(f"{primary.path}/ledger")
    parts = [notes.where(~F.col("batch").isin(list(sink.noted(spark)))).select(F.lit(name).alias("sink"), "batch", "rows") for name, sink in secondary.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
