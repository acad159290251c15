"""Requests under a budget against the plain loop, and single cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.operators import evaluation, packing, vector
from brevia.plans.chunking import letter_shares


def loop(tokens, budget):
    out, begin, used = [], 0, 0
    for k, n in enumerate(tokens):
        if k > begin and used + n > budget:
            begin, used = k, 0
        used += n
        out.append(begin)
    return out


@pytest.mark.parametrize("seed, most, budget", [(0, 9, 10), (1, 200, 1000), (2, 30, 31), (3, 1, 7), (4, 1000, 1000)])
def test_requests_as_in_the_loop(spark, seed, most, budget):
    tokens = np.random.default_rng(seed).integers(1, most + 1, 400).tolist()
    df = spark.createDataFrame([(3 * k, n) for k, n in enumerate(tokens)], "doc_id long, tokens long").repartition(7)
    got = [(r.pos, r.request) for r in packing.requests(df, budget).orderBy("doc_id").collect()]
    assert got == list(enumerate(loop(tokens, budget)))
    sums = {}
    for (_, request), n in zip(got, tokens, strict=True):
        sums.setdefault(request, []).append(n)
    assert all(len(own) == 1 or sum(own) <= budget for own in sums.values())


def test_no_texts_and_one_text(spark):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.requests(none, 10).collect() == []
    assert [(r.pos, r.request) for r in packing.requests(spark.createDataFrame([(7, 12)], none.schema), 10).collect()] == [(0, 0)]


def test_empty_and_long_texts(spark):
    texts = [(1, None), (2, " \n"), (3, "aa e"), (4, "a " * 15), (5, "t e")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in packing.embedded(df, letter_shares, 3, most=10, overlap=2).collect()}
    assert got[1].vector == got[2].vector == [0.0, 0.0, 0.0] and got[1].request is None
    assert (got[4].parts, got[4].request) == (2, None) and np.allclose(got[4].vector, [1, 0, 0])
    assert (got[3].request, got[5].request) == (0, 0) and np.allclose(got[3].vector, [0.5, 0.25, 0])


def test_places_and_sums_over_many_runs(spark):
    df = spark.range(3_000).select(((F.col("id") * 7919) % 3_000).alias("doc_id"), (F.col("id") % 5).alias("tokens"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = packing.numbered(df, ["doc_id"], "tokens").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.pos for r in rows] == [r.doc_id for r in rows] == list(range(3_000))
    assert [r.before for r in rows] == np.concatenate([[0], np.cumsum([r.tokens for r in rows])[:-1]]).tolist()


def test_articles_with_signs(spark):
    rows = [("5-A", "o art. 5-A diz", True), ("10.1", "Artigo 10.1.", True), ("10.1", "art. 1001", False), ("5", "art. 5-A", True), ("5-A", "art. 5", False), ("6$", "art. 6", False), (None, "x", True)]
    df = spark.createDataFrame(rows, "article string, answer string, want boolean")
    assert all(r.got == r.want for r in df.select("want", evaluation.mentions_article(F.col("answer"), F.col("article")).alias("got")).collect())


def test_all_hits_over_a_threshold(spark):
    """More than any pool of candidates holds."""
    v = spark.range(13_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 10) / 100).cast("array<float>").alias("embedding"))
    hits = vector.within(v, v.where("vec_id = 0"), 0.9)
    assert hits.count() == 13_000 and hits.where("similarity >= 1").count() == 1_300


def test_positions_with_outliers_and_many_looks(spark, monkeypatch):
    """A log-normal column with an outlier: the widest first range holds under a hundredth, and small limits lead to the same."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.lognormal(3, 1, 40_000), [1e12], -rng.lognormal(0, 2, 300), [0.0] * 50, [np.inf]])
    df = spark.createDataFrame([(int(k % 2), float(v)) for k, v in enumerate(x)], "k int, v double")
    least = df.where("v != 0").agg(F.min(evaluation._size(F.col("v")))).first()[0]
    m = df.where("v < double('inf')").select(evaluation._magnitude(F.col("v"), F.lit(least)).alias("m"))
    lo, hi = m.agg(F.min("m"), F.max("m")).first()
    widest = m.groupBy(F.floor((F.col("m") - lo) / (hi - lo) * evaluation.BUCKETS)).count().agg(F.max("count")).first()[0]
    assert widest < 0.01 * len(x)
    shares = (0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0)
    places = {f"p{j}": F.least(F.floor(F.col("n") * p), F.col("n") - 1) for j, p in enumerate(shares)}
    for buckets, most in ((4096, 100_000), (8, 40)):
        monkeypatch.setattr(evaluation, "BUCKETS", buckets)
        monkeypatch.setattr(evaluation, "MOST_VALUES", most)
        got = {(r.k, r.name): r.found for r in evaluation.at_positions(df, "k", "v", places).collect()}
        for k in (0, 1):
            own = np.sort(x[k::2])
            assert [got[k, f"p{j}"] for j in range(len(shares))] == [own[min(int(p * len(own)), len(own) - 1)] for p in shares]
