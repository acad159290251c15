"""Ranked lexical search against the formula document by document."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import lexical
from test_edges import CLASHES, DOCUMENT, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    docs = [(d, terms(t)) for d, t in docs if terms(t)]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for d, w in docs:
            m = 10 + 90 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(terms(text)) if t in df)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, d, -s


ITEMS = [(1, "plain WORD1 word2 words"), (1, "plain WORD1 word2 words"), (2, None), (None, "Ärger mail +1"), (3, ""), (4, "nothing-of-this"), (5, "ärger x y")]


def same(docs, items, **how):
    got = [tuple(r) for r in lexical.rank(docs, items, repeats=False, **how).collect()]
    want = list(plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], **how))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_odd_tables(spark, items):
    odd = spark.createDataFrame(rows(), DOCUMENT)
    assert same(odd, items)
    assert same(odd.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(2), items.withColumn("doc_id", F.lit("x")), k=2)
    assert same(odd.limit(0), items) == [] and same(odd, items.limit(0)) == []


def test_ties_copies_and_many_blocks_of_documents_and_items(spark, items, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(60)] + ["Ä", "plain", "ärger"])
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(k % 700, texts[k % 300]) for k in range(900)], "doc_id long, text string").repartition(9)
    many = spark.createDataFrame([(k, " ".join(rng.choice(words, 6)) + " unseen") for k in range(40)], "item_id long, text string").unionByName(items)
    whole = same(docs, many)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(same(docs, many), key=repr) == sorted(whole, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Ab, cde  fghijklmnop q_r Ää " * 5
    assert [t.decode() for part in lexical.terms(text.encode()) for t in part] == terms(text)


def test_multiplicity_counts_if_asked(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c d")], "doc_id long, text string")
    once, twice = (spark.createDataFrame([(1, t)], "item_id long, text string") for t in ("a", "a a"))
    score = lambda items: {r.doc_id: r.score for r in lexical.rank(docs, items).collect()}
    assert {d: 2 * s for d, s in score(once).items()} == score(twice)


def test_lengths_beyond_64_bits_on_the_way():
    assert lexical.lengths(np.array([10**8]), 10**10, 10**12).tolist() == [10 + 90 * 10**18 // 10**12]
