"""The vector index: recall, exactness, insertions, odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.operators import ann, vector

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def rows():
    """Rows around 40 directions, a third of all the same vector."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3_000)] + rng.normal(size=(3_000, 24)) * 0.3
    x[::3] = x[0]
    return [(k, v.tolist()) for k, v in enumerate(x)]


@pytest.fixture(scope="module")
def index(spark, rows):
    return ann.build(spark.createDataFrame(rows, SCHEMA), clusters=20, sample=1_000)


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def test_few_probes_find_the_near_ones(spark, rows, index):
    v = spark.createDataFrame(rows, SCHEMA)
    asked = v.where("vec_id % 50 = 1")
    assert index.probes < 10
    near, found = vector.top_k(v, asked, 10), index.search(asked, 10)
    kth = {r.query_id: r.s for r in near.groupBy("query_id").agg(F.min("similarity").alias("s")).collect()}
    good = sum(r.similarity >= kth[r.query_id] - 1e-6 for r in found.collect())  # copies: which of them doesn't matter
    assert good >= 0.9 * near.count()


def test_all_clusters_are_exact(spark, rows, index):
    v = spark.createDataFrame(rows, SCHEMA)
    asked = v.where("vec_id % 50 = 1")
    assert pairs(index.search(asked, 10, probes=10**6, refine=None)) == pairs(vector.top_k(v, asked, 10))


def test_every_row_is_indexed_and_only_probed_folders_are_read(spark, rows, index):
    assert index.rows(spark).count() == len(rows)
    one = spark.createDataFrame(rows[1:2], SCHEMA)
    plan = index.search(one, 5, probes=1)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^]]*cluster#\d+ = \d+", line) for line in scans)
    assert any("code#" in line and "embedding#" not in line for line in scans)


def test_insertions_and_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (None, [1.0, 0.1])]
    index = ann.build(spark.createDataFrame(data, SCHEMA), clusters=3)
    index.add(spark.createDataFrame([(6, [0.9, 0.1])], SCHEMA))
    got = index.search(spark.createDataFrame([(9, [1.0, 0.0]), (8, None), (7, [1.0])], SCHEMA), 3, probes=9)
    assert [(r.vec_id, r.rank) for r in got.orderBy("rank").collect()] == [(1, 1), (6, 2), (2, 3)]
    empty = ann.build(spark.createDataFrame([], SCHEMA))
    assert empty.search(spark.createDataFrame(data, SCHEMA), 3).collect() == []


def test_balanced_clusters():
    rng = np.random.default_rng(6)
    x = ann.unit(np.concatenate([rng.normal(size=(900, 8)) * 0.2 + np.eye(8)[0], rng.normal(size=(300, 8))]))
    centres, bias = ann.balanced(x, 8, rng)
    count = np.bincount(np.argmax(x @ centres.T - bias, axis=1), minlength=8)
    assert count.max() < 2.5 * len(x) / 8 and count.min() > 0
