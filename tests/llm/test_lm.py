"""The n-gram model against counts in dictionaries, and by its held-out perplexity."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import lm
from brevia.llm import queries as llm_queries
from test_edges import CLASHES, DOCUMENT, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = "\n", "\n\n"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + [END]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Plain:
    def __init__(self, texts, order):
        self.order, self.counts = order, {order: Counter()}
        for text in texts:
            w = [BEGIN] * (order - 1) + words(text)
            self.counts[order].update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.known = Counter(w for text in texts for w in words(text))
        self.followers = {n: defaultdict(list) for n in self.counts}
        for n, own in self.counts.items():
            for g, c in own.items():
                self.followers[n][g[:-1]].append(c)
        self.d = {n: lm.discounts(*[sum(c == k for c in own.values()) for k in (1, 2, 3, 4)]) for n, own in self.counts.items()}

    def p(self, gram, n):
        if n == 0:
            return 1 / (len(self.known) + 1)
        gram = gram[-n:]
        after, d = self.followers[n].get(gram[:-1]), (0, *self.d[n])
        if not after:
            return self.p(gram, n - 1)
        c = self.counts[n].get(gram, 0)
        left = sum(d[min(x, 3)] for x in after)
        return (max(c - d[min(c, 3)], 0) + left * self.p(gram, n - 1)) / sum(after)

    def row(self, doc_id, text):
        own, n, v = words(text), sum(self.known.values()), len(self.known)
        w = [BEGIN] * (self.order - 1) + own
        base = sum(math.log10((self.known[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        score = sum(math.log10(self.p(tuple(w[k : k + self.order]), self.order)) for k in range(len(own)))
        return doc_id, out(doc_id), len(own), sum(x in self.known for x in own), n, base, score


def same(docs, order):
    got = sorted((tuple(r)[:7] for r in lm.score_documents(docs, order).collect()), key=repr)
    table = [(r.doc_id, r.text) for r in docs.collect()]
    model = Plain([t for d, t in table if not out(d)], order)
    want = sorted((model.row(*r) for r in table), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    letters = np.array([f"W{k}" for k in range(30)] + ["ä", "Ä"])
    made = [" ".join(rng.choice(letters[: rng.integers(3, 32)], rng.integers(0, 60))) for _ in range(120)]
    return spark.createDataFrame([(k, made[k % 100]) for k in range(150)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_counts_in_dictionaries(texts, order):
    same(texts, order)


def test_runs_and_texts_in_pieces(texts, monkeypatch):
    plain = {r.doc_id: r.score for r in lm.score_documents(texts).collect()}
    monkeypatch.setattr(lm, "PIECE", 50)
    assert np.array_equal(lm.tokens(b"Some  words\tof a text " * 9), np.array([lm.xxhash.xxh64_intdigest(w) for w in b"some words of a text ".split() * 9] + [lm.END], np.uint64))
    train = texts.where(~lm.held_out(F.col("doc_id")))
    many = lm.train(train, 2, per_range=100)
    assert many.bits > 4 and len(many.sizes["gram2"]) > 8
    assert np.allclose([plain[r.doc_id] - r.score for r in lm.score(texts, many).collect()], 0)


def test_odd_tables(spark):
    odd = spark.createDataFrame(rows(), DOCUMENT)
    same(odd, 2)
    same(odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(2), 2)
    assert lm.score_documents(odd.limit(0)).collect() == []
    held = odd.where(lm.held_out(F.col("doc_id")))
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in lm.score_documents(held).collect()} <= {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one(texts):
    model = lm.train(texts, 2)
    everything = np.arange(model.words + 1)  # the last number stands for all unknown words
    for before in [*range(0, model.words, 7), model.words, model.words + 1]:
        grams = np.stack([np.full(len(everything), before), everything], axis=1).astype(np.uint32)
        assert abs(model.probabilities(grams).sum() - 1) < 1e-9


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    """Whole given tables; and texts with their words in another order are less likely."""
    docs = llm_queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    held = lm.score(docs, model).where("held_out").agg(F.sum("score").alias("own"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert held.own > held.base
    turned = docs.withColumn("text", F.array_join(F.reverse(F.split("text", " ")), " "))
    assert lm.score(turned, model).where("held_out").agg(F.sum("score")).first()[0] < held.own


def test_the_model_needs_a_mounted_folder():
    assert lm.mounted("file:///a/b") == lm.mounted("file:/a/b") == lm.mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        lm.mounted("hdfs://host/a")
