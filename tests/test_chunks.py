"""Packing of blocks against the plain loop, and its time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.operators import chunks

BLOCKS = "b array<struct<tokens:int,level:int,p:array<struct<idx:bigint,text:string,tokens:int>>>>"


def made(rng, n):
    out, idx = [], 0
    for _ in range(n):
        sizes = rng.integers(1, 80, rng.integers(1, 4)).tolist()
        out.append((sum(sizes), rng.choice([1, 2, 3, None], p=[0.05, 0.05, 0.2, 0.7]), [(idx + k, f"t{idx + k}", s) for k, s in enumerate(sizes)]))
        idx += len(sizes)
    return out


def loop(blocks, most, least, overlap):
    out, now, n = [], [], 0
    for tokens, level, parts in blocks:
        if now and n >= least and (n + tokens > most or (level or 99) <= 2):
            out.append(now)
            kept = []
            for p in reversed(now):
                if sum(x[2] for x in kept) + p[2] > overlap:
                    break
                kept.insert(0, p)
            now = (kept or now[-1:]) if overlap > 0 else []
            n = sum(p[2] for p in now)
        now, n = now + parts, n + tokens
    return out + ([now] if now else [])


@pytest.mark.parametrize("most, least, overlap", [(500, 100, 50), (120, 10, 0), (60, 1, 200), (500, 0, 5)])
def test_packing_as_in_the_loop(spark, most, least, overlap):
    rng = np.random.default_rng(most)
    docs = [made(rng, n) for n in (0, 1, 2, 30, 200)]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(docs)], f"k int, {BLOCKS}")
    got = {r.k: [[tuple(p) for p in c] for c in r.c] for r in df.select("k", chunks.packed(F.col("b"), most, least, overlap).alias("c")).collect()}
    assert got == {k: loop(b, most, least, overlap) for k, b in enumerate(docs)}


def test_time_grows_with_a_documents_length(spark):
    block = F.struct(F.lit(60).alias("tokens"), F.lit(None).cast("int").alias("level"), F.array(F.struct(F.lit(1).cast("long").alias("idx"), F.repeat(F.lit("word "), 60).alias("text"), F.lit(60).alias("tokens"))).alias("p"))

    def seconds(n):
        df = spark.range(1).select(F.array_repeat(block, n).alias("b"))
        best = 9e9
        for _ in range(3):
            start = time.time()
            assert df.select(F.size(chunks.packed(F.col("b"))).alias("n")).first().n == pytest.approx(n / 7, rel=0.3)
            best = min(best, time.time() - start)
        return best

    seconds(1_000)
    assert seconds(64_000) < 10 * max(seconds(16_000), 0.3)
