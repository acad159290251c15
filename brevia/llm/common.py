"""Helpers shared by the training-data operators: shared storage, lineage cuts, table access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
NOT_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one is set in local mode; on a
    cluster, whose machines don't share such folders, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="brevia-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/brevia/{uuid.uuid4().hex}/{name}"


#: Settings while a table is written: shuffle files go when the writing has ended, and few rows at a time go to Python,
#: since a batch of texts is held by the executor and by its worker alike.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH: BATCH_ROWS}


def small_batches(spark: SparkSession) -> None:
    """The same batches for a DataFrame that the caller will run: the session hands at most BATCH_ROWS rows at a time to
    Python from now on. It is a limit of memory; results don't depend on it."""
    if int(spark.conf.get(BATCH)) > int(BATCH_ROWS):
        spark.conf.set(BATCH, BATCH_ROWS)


#: Where cut() notes the tables that it writes, inside recorded().
_notes: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """A list of the folders of all tables that cut() writes meanwhile."""
    _notes.append(paths := [])
    try:
        yield paths
    finally:
        _notes.remove(paths)


def cut(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages survive lost executors without
    going back to df's inputs. Shuffle files of the writing go as soon as the table is there. The table `replaces`, which
    came from cut() too and which nothing reads any more, is deleted then. Other files stay until the folder is cleaned
    (see drop_tables)."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    was = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    if replaces is not None:
        delete(spark, replaces.written_at)
    for paths in _notes:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """In a Python worker: give freed memory back to the system. A worker lives on beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that cut() has written under this session's shared folder."""
    delete(spark, f"{shared_dir(spark).rstrip('/')}/brevia")


def words(col):
    """The words of a text: array of strings, empty for null."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), NOT_WORD), lambda w: w != "")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, cast: pick(df, doc_id="long", text="string"). A column that is missing is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])


def text_parts(b, characters: int = 200_000):
    """The rows (doc_id, text) of an Arrow batch as lists, in parts of about so many characters."""
    ids, texts, size = [], [], 0
    for k in range(b.num_rows):
        ids.append(b.column(0)[k].as_py())
        texts.append(b.column(1)[k].as_py())
        size += len(texts[-1] or "")
        if size >= characters:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
