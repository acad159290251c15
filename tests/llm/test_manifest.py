"""The Merkle manifest against trees built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from brevia.llm import merkle
from test_edges import CLASHES, DOCUMENT, rows

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def steps(tree, p):
    for level in tree[:-1]:
        first = p - p % 3
        yield p % 3, [x for q, x in enumerate(level[first : first + 3], first) if q != p]
        p //= 3


def plain(table):
    by = {}
    for r in table:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = levels([leaf(r, r["text"]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for p, r in enumerate(by[s]):
            path, text = [*steps(trees[s], p), *steps(top, k)], r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            x = leaf(r, text)
            for slot, siblings in path:
                x = H(*siblings[:slot], x, *siblings[slot:])
            root = top[-1][0]
            yield r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], root, H(*[d for _, own in path for d in own]), x, x == root


def same(df):
    got = [tuple(r)[:7] for r in merkle.manifest(df).collect()]
    assert sorted(got, key=repr) == sorted(plain([r.asDict() for r in df.collect()]), key=repr)
    return got


def test_odd_tables(spark):
    odd = spark.createDataFrame(rows(), DOCUMENT)
    same(odd)
    same(odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(2))
    assert same(odd.limit(0)) == []
    assert len(same(odd.where("doc_id = 5").limit(1))) == 1


@pytest.mark.parametrize("n, sources", [(2_300, 1), (1_000, 400), (800, 5)])
def test_trees_of_many_shapes(spark, n, sources):
    """A tree deeper than one scan, many small trees with a deep tree of sources, and families that runs cut."""
    data = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("line\nof "), "id").alias("text"), F.lit(None).cast("string").alias("lang"),
        F.when(F.col("id") % sources > 0, F.concat(F.lit("sü"), F.col("id") % sources)).alias("source"), F.col("id").alias("n_chars"),
    )
    got = same(data.repartition(7))
    assert {r[6] for r in got} == {True, False}
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 2 != 0) for r in got)


def test_runs_that_cut_families(spark):
    data = spark.range(500).select(F.lit("").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id", F.lit(None).cast("string").alias("extra"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = merkle.Store(data, ["id"], "runs")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = levels([H(str(k)) for k in range(500)])
    got = {(r.level, r.pos): r.digest for r in store.nodes().collect()}
    assert got == {(k, p): d for k, level in enumerate(want) for p, d in enumerate(level)}


def test_folding_a_path():
    a, b, c = (H(x) for x in "abc")
    assert merkle.folded(b, f"1{a}{c},0") == H(H(a, b, c)) and merkle.folded(a, "") == a
    assert merkle.proof_digest(f"1{a}{c},0") == H(a, c)
