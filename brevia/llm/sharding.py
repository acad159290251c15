"""Sharding by longest-processing-time scheduling.

Groups of equal texts must stay together. All groups are scheduled, from the largest to the smallest, each to the
least-loaded shard through a heap. The schedule needs only how many groups there are of each size: that histogram goes
to the driver (sizes are distinct numbers whose sum is within all bytes, so for B bytes it has fewer than sqrt(2 * B)
rows, and in practice as many as texts have lengths). The schedule says how many groups of each size each shard gets; the
groups of one size are dealt by their rank. Imbalance is at most one group.

Defined results: a null text counts as the empty text (size 1, CRC 0); repeated rows are rows of their own, next to
each other or not; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick

KEY = ["g", "text_crc32", "size"]
#: Rows of the schedule or groups of many rows that may be broadcast (fewer than 100 bytes each).
BROADCAST_ROWS = 200_000


def lpt(sizes: dict, n_shards: int) -> dict:
    """Unit -> shard: units by falling size (ties by key), each to the shard with the least load (ties: smallest)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` units of one size each shard gets: the unit that finds a load of x goes before any that finds
    more, so the loads found are the `count` smallest of load, load + size, load + 2 * size ... over the shards."""
    found = lambda x: [0 if x < load else (x - load) // size + 1 for load in loads]
    low, high = min(loads) - 1, max(loads) + size * count
    while high - low > 1:  # the highest load at which no more than `count` are found
        mid = (low + high) // 2
        low, high = (mid, high) if sum(found(mid)) <= count else (low, mid)
    got = found(low)
    for s in sorted(range(len(loads)), key=lambda s: (loads[s] + got[s] * size, s))[: count - sum(got)]:
        got[s] += 1
    return got


def schedule(histogram: dict[int, int], n_shards: int) -> dict[int, list[int]]:
    """Size -> how many of its groups each shard gets, as lpt() would deal them. Few groups of a size go through the heap
    one by one, many at once."""
    loads, out = [0] * n_shards, {}
    for size, count in sorted(histogram.items(), reverse=True):
        if count <= 8 * n_shards:
            heap, got = [(load, s) for s, load in enumerate(loads)], [0] * n_shards
            heapq.heapify(heap)
            for _ in range(count):
                load, s = heap[0]
                got[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        else:
            got = _level(loads, size, count)
        loads = [load + size * k for load, k in zip(loads, got, strict=True)]
        out[size] = got
    return out


def _ranked(df: DataFrame, by: str, order: list[str], name: str, rows: int, per_slice: int) -> DataFrame:
    """df with the rank of each row among those of the same `by`, from 0. No task orders all rows of one value: they are
    cut into slices by their hash, whose sizes are summed before."""
    slices = max(1, rows // per_slice)
    df = df.withColumn("slice", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(slices)))
    before = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(by, "slice").count().select(by, "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(by, "slice").orderBy(*order)
    return df.withColumn("at", F.row_number().over(within) - 1).join(offsets, [by, "slice"]).withColumn(name, (F.col("offset") + F.col("at")).cast("long")).drop("slice", "at", "offset")


def shard_documents(docs: DataFrame, n_shards: int = 8, rows_per_slice: int = 25_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slots number a shard's rows from 0 without gaps."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pick(docs, doc_id="long", text="string").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("g")
    )
    groups = cut(base.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size")), "groups")
    sizes = {r.bytes: r.groups for r in groups.groupBy("bytes").agg(F.count("*").alias("groups")).toLocalIterator()}
    n_groups = sum(sizes.values())
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    dealt = schedule(sizes, n_shards)
    ends = [(size, [sum(got[: k + 1]) for k in range(n_shards)]) for size, got in dealt.items()]
    ends = spark.createDataFrame(ends, "bytes long, ends array<long>")
    ends = F.broadcast(ends) if len(dealt) <= BROADCAST_ROWS else ends
    ranked = _ranked(groups, "bytes", KEY, "rank", n_groups, 200_000).join(ends, "bytes")
    placed = cut(ranked.select(*KEY, "n", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")), "placed", replaces=groups)
    # the rows of the largest groups, which no shuffle would spread, meet a broadcast; of the others each has few rows
    many = F.col("n") * 4096 >= F.lit(n_rows)  # 4,096 groups at most
    large, small = (placed.where(c).select(*KEY, F.col("shard").alias(f"{k}_shard")) for c, k in ((many, "large"), (~many, "small")))
    found = base.join(F.broadcast(large), KEY, "left")
    rest = found.where("large_shard IS NULL").drop("large_shard").join(small.withColumnRenamed("small_shard", "shard"), KEY)
    rows = rest.unionByName(found.where("large_shard IS NOT NULL").withColumnRenamed("large_shard", "shard")).select("doc_id", "size", "text_crc32", "shard")
    return _ranked(rows, "shard", ["doc_id", "text_crc32"], "slot", n_rows, rows_per_slice * n_shards).select("doc_id", "size", "text_crc32", "shard", "slot")
