"""Approximate vector search (V11): balanced clusters, residuals as product-quantised codes, stored by cluster.

Centres and code books are fitted to a bounded sample (`sample` rows, chosen by the hash of their id); every row is then
assigned and coded in its task, and the table is written with a folder for each cluster, large clusters in many files. A query
probes the clusters whose centres fit it best: the scan reads only their folders, and of them only the codes. The best
`refine` rows of each query by the distance of the codes are then compared exactly. How many clusters have to be probed for the
recall asked for is measured on the sample when the index is built. With refine=None codes aren't used; then a search
of all clusters is exact.

Rows without id or vector, and vectors of another length than most of the sample has, are left out; a zero vector is similar to none (0).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.operators.vector import in_blocks
from brevia.storage import scratch

ROW = "vec_id long, code binary, embedding array<float>, cluster int"


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means: n centres of the rows of x; an empty one takes the place of a row."""
    centres = x[rng.choice(len(x), n, replace=len(x) < n)]
    for _ in range(rounds):
        own = np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=n)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), n)])
    return centres


def balanced(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """n centres for unit rows and a bias for each: a row belongs to the centre of the largest x @ centre - bias. Centres of the
    smallest clusters move into clusters of twice the mean; then a bias rises while its cluster is above the mean. Copies of
    one vector stay together."""

    def step(centres, bias):
        own = np.argmax(x @ centres.T - bias, axis=1)
        count = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        return own, count, np.where(count[:, None] > 0, unit(sums), centres)

    centres, bias, mean = unit(_means(x, n, rng)), np.zeros(n), len(x) / n
    for _ in range(rounds):
        own, count, _ = step(centres, bias)
        large, small = np.argsort(-count), np.argsort(count)
        large = large[count[large] > 2 * mean][: n // 2]
        if not len(large):
            break
        for big, little in zip(large, small, strict=False):
            centres[little] = x[rng.choice(np.flatnonzero(own == big))]
        for _ in range(3):
            centres = step(centres, bias)[2]
    two = np.partition(x @ centres.T, -2, axis=1)[:, -2:] if n > 1 else np.zeros((1, 2))
    rate, best = np.median(two[:, 1] - two[:, 0]) / 5, None
    for _ in range(rounds):
        _, count, moved = step(centres, bias)
        if best is None or count.max() < best[0]:
            best = count.max(), centres, bias
        bias = bias + rate * np.clip(count / mean - 1, -1, 1)
        centres = moved
    return best[1:]


@dataclass
class Books:
    """What tasks need: centres with biases, and for each part of a residual its code words."""

    centres: np.ndarray
    bias: np.ndarray
    words: np.ndarray  # parts x codes x width of a part

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T - self.bias, axis=1)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        own = self._parts(residual)
        return np.stack([np.argmin((w * w).sum(axis=1) - 2 * own[:, j] @ w.T, axis=1) for j, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x parts x codes: what each code word adds to the similarity."""
        return np.einsum("qpw,pcw->qpc", self._parts(queries), self.words)

    def order(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centres.T - self.bias), axis=1, kind="stable")


def fit(x: np.ndarray, clusters: int, parts: int = 16, seed: int = 7) -> Books:
    rng = np.random.default_rng(seed)
    centres, bias = balanced(x, clusters, rng)
    books = Books(centres, bias, np.zeros((parts, 1, -(-x.shape[1] // parts))))
    residual = books._parts(x - centres[books.assign(x)])
    n = min(256, max(1, len(x) // 4))
    books.words = np.stack([_means(residual[:, j], n, rng) for j in range(parts)])
    return books


def probes_for(books: Books, x: np.ndarray, recall: float, k: int = 10, asked: int = 200) -> int:
    """How many clusters hold that share of the k nearest rows of the sample, for rows of the sample as queries."""
    q = x[:: max(1, len(x) // asked)][:asked]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(books.order(q), axis=1)  # a cluster's place in the order of probing
    ranks = np.sort(np.take_along_axis(place, books.assign(x)[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `width` values, and their values."""
    starts = lists.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(starts) == width) & ~np.asarray(lists.is_null()))
    return rows, lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[starts[rows][:, None] + np.arange(width)]


@dataclass
class Index:
    path: str
    books: Books
    probes: int

    def add(self, vectors: DataFrame) -> None:
        """Rows (vec_id, embedding) more; centres and code books stay."""
        books = self.books

        def run(batches):
            for b in batches:
                rows, x = _matrix(b.column(1), books.centres.shape[1])
                x = unit(x)
                own = books.assign(x) if len(x) else np.zeros(0, np.int64)
                codes = books.codes(x - books.centres[own])
                cols = [b.column(0).take(pa.array(rows)), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1).take(pa.array(rows)), pa.array(own, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "code", "embedding", "cluster"])

        v = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        v.mapInArrow(run, ROW).hint("rebalance", "cluster").write.mode("append").partitionBy("cluster").parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ROW).parquet(self.path)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int | None = 200) -> DataFrame:
        """(query_id, vec_id, similarity, rank) for queries (vec_id, embedding). probes: clusters, by default those for the recall
        that the index was built for."""
        q = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        return in_blocks(q, "query_id", lambda block: self._block(block, k, min(probes or self.probes, len(self.books.centres)), refine))

    def _block(self, block: DataFrame, k: int, probes: int, refine: int | None) -> DataFrame:
        books, spark = self.books, block.sparkSession
        got = [r for r in block.collect() if len(r.embedding) == books.centres.shape[1]]  # vector.BLOCK rows, about
        ids = np.array([r.query_id for r in got], np.int64)
        x = unit(np.array([r.embedding for r in got], np.float64).reshape(len(got), -1 if got else books.centres.shape[1]))
        probed = np.zeros((len(books.centres), len(got)), bool)
        for j, own in enumerate(books.order(x)[:, :probes] if len(got) else []):
            probed[own, j] = True
        clusters = self.rows(spark).where(F.col("cluster").isin(np.flatnonzero(probed.any(axis=1)).tolist()))

        def by_codes(b: pa.RecordBatch, tables: np.ndarray):
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            ids, own = b.column(0).to_numpy(), b.column(2).to_numpy()
            for c in np.unique(own):
                at, asking = np.flatnonzero(own == c), np.flatnonzero(probed[c])
                s = sum(tables[asking, p][:, codes[at, p]] for p in range(codes.shape[1])) + (x[asking] @ books.centres[c])[:, None]
                yield c, ids[at], asking, s

        def by_vectors(b: pa.RecordBatch, _):
            rows, values = _matrix(b.column(1), books.centres.shape[1])
            ids, own, values = b.column(0).to_numpy()[rows], b.column(2).to_numpy()[rows], unit(values)
            for c in np.unique(own):
                at, asking = np.flatnonzero(own == c), np.flatnonzero(probed[c])
                yield c, ids[at], asking, x[asking] @ values[at].T

        def best_of(scores, most: int):
            def run(batches):
                held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(ids)
                tables = books.tables(x) if len(ids) else None
                for b in batches:
                    for c, rows, asking, s in scores(b, tables):
                        for j, own in zip(asking, s, strict=True):
                            at = np.flatnonzero(own >= np.partition(own, len(own) - most)[len(own) - most]) if len(own) > most else np.arange(len(own))
                            all_s, all_rows = np.concatenate([held[j][0], own[at]]), np.concatenate([held[j][1], rows[at]])
                            all_c = np.concatenate([held[j][2], np.full(len(at), c, np.int32)])
                            first = np.lexsort([all_rows, -all_s])[:most]
                            held[j] = all_s[first], all_rows[first], all_c[first]
                cols = [np.concatenate([np.zeros(0, t), *c]).astype(t) for t, c in ((np.int64, [np.full(len(h[0]), i) for i, h in zip(ids, held, strict=True)]), (np.int64, [h[1] for h in held]), (np.int32, [h[2] for h in held]), (np.float64, [h[0] for h in held]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "cluster", "s"])

            return run

        order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
        top = lambda df, n: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        schema = "query_id long, vec_id long, cluster int, s double"
        if refine is None:
            return top(clusters.select("vec_id", "embedding", "cluster").mapInArrow(best_of(by_vectors, k), schema), k).select("query_id", "vec_id", F.round("s", 6).alias("similarity"), "rank")
        near = top(clusters.select("vec_id", "code", "cluster").mapInArrow(best_of(by_codes, max(refine, k)), schema), max(refine, k)).select("query_id", "vec_id", "cluster")
        # refine rows for each query of a block
        again = clusters.select("vec_id", "embedding", "cluster").join(F.broadcast(near), ["cluster", "vec_id"])
        asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "query_id long, q array<double>")
        return top(exact(again.join(F.broadcast(asked), "query_id")), k).select("query_id", "vec_id", F.round("s", 6).alias("similarity"), "rank")


def exact(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, s) of pairs with an embedding and the query's unit vector q."""

    @F.arrow_udf("double")
    def similarity(v: pa.Array, q: pa.Array) -> pa.Array:
        a, b = (np.stack([np.asarray(r.values, np.float64) for r in c]) if len(c) else np.zeros((0, 1)) for c in (v, q))
        return pa.array((unit(a) * b).sum(axis=1))

    return pairs.select("query_id", "vec_id", similarity(F.col("embedding"), F.col("q")).alias("s")).distinct()


def build(vectors: DataFrame, clusters: int | None = None, sample: int = 20_000, recall: float = 0.97) -> Index:
    """An index of all rows (vec_id, embedding) with a vector; by default half as many clusters as the root of the rows, 4 to 4,096."""
    spark = vectors.sparkSession
    v = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    got = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # the bounded sample
    widths = [len(r.embedding) for r in got]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if got else 1
    x = unit(np.array([r.embedding for r in got if len(r.embedding) == width], np.float64).reshape(-1, width))
    if clusters is None:
        clusters = int(min(4096, max(4, np.sqrt(v.count()) / 2)))
    x = x if len(x) else np.zeros((1, width))
    clusters = min(clusters, len(x))
    books = fit(x, clusters)
    index = Index(scratch(spark, "vectors"), books, probes_for(books, x, recall))
    index.add(v)
    return index
