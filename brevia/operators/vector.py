"""Vector search (V1-V5, C9). Query sets are broadcast, large ones in blocks; ties go to the smallest id."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries that are broadcast at once.
BLOCK = 1000


def in_blocks(queries: DataFrame, key: str, search) -> DataFrame:
    """The union of search(block) over blocks of about BLOCK queries; a query's rows are all in one block."""
    n = -(-queries.count() // BLOCK)
    if n <= 1:
        return search(queries)
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, [search(queries.where(block == k)) for k in range(n)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V1: 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = -1.0) -> DataFrame:
    """V2, V3: (query_id, vec_id, similarity, rank) of the k best rows at or over `least` for each query. The vectors of a
    block of queries go to the tasks; each Arrow batch is one product of matrices, of which only the k best for each query
    go on to the shuffle. Null vectors, and those of another length than the query's, are left out."""
    return _search(vectors, queries, k, least)


def within(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """V5: (query_id, vec_id, similarity) of all rows at or over `least`, however many; no shuffle."""
    return _search(vectors, queries, None, least)


def _search(vectors: DataFrame, queries: DataFrame, k: int | None, least: float) -> DataFrame:
    v = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    q = queries.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(block: DataFrame) -> DataFrame:
        by_length: dict[int, list] = {}
        for r in block.collect():  # BLOCK rows, about
            by_length.setdefault(len(r.embedding), []).append((r.query_id, r.embedding))
        asked = {n: (np.array([i for i, _ in rows], np.int64), unit(np.array([e for _, e in rows], np.float64).reshape(len(rows), n))) for n, rows in by_length.items()}

        def run(batches):
            for b in batches:
                lists = b.column(1)
                starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
                size, ids = np.diff(starts), b.column(0).to_numpy()
                for n, (query_ids, qs) in asked.items():
                    rows = np.flatnonzero(size == n)
                    if not len(rows):
                        continue
                    s = unit(values[starts[rows][:, None] + np.arange(n)]) @ qs.T
                    near = len(rows) if k is None else min(k, len(rows))
                    out = []
                    for j in range(len(query_ids)):
                        own = np.flatnonzero(s[:, j] >= max(least, np.partition(s[:, j], len(rows) - near)[len(rows) - near]))
                        own = own[np.lexsort([ids[rows[own]], -s[own, j]])[:near]]
                        out.append((np.full(len(own), query_ids[j]), ids[rows[own]], s[own, j]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "s"])

        found = v.mapInArrow(run, "query_id long, vec_id long, s double")
        if k is None:
            return found.select("query_id", "vec_id", F.round("s", 6).alias("similarity"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("s", 6).alias("similarity"), "rank")

    return in_blocks(q, "query_id", best)


def to_bytes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Df with a vector as bytes of little-endian 32-bit floats."""

    @F.arrow_udf("binary")
    def write(v: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else np.array(x.as_py(), "<f4").tobytes() for x in v], pa.binary())

    return df.withColumn(name, write(column))


def from_bytes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Df with the vector of a column of bytes."""

    @F.arrow_udf("array<float>")
    def read(b: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else np.frombuffer(x.as_py(), "<f4") for x in b], pa.list_(pa.float32()))

    return df.withColumn(name, read(column))


def centroids(vectors: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, pos, value): L2-normalised (weighted) mean vectors, a row for each coordinate."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    mean = vectors.select(key, w.alias("w"), F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return mean.select(key, "pos", F.round(F.when(norm == 0, 0.0).otherwise(F.col("m") / norm), 5).alias("value"))
