"""The stored word index against a ranking of the whole corpus, through insertions, updates, deletions and merges."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.operators import search, word_index

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"word{k}" for k in range(200)])
    weight = 1 / np.arange(1, 201)
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 50), p=weight / weight.sum())) for _ in range(400)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word1 word50"), (2, "word150 word199 word7"), (3, "nowhere"), (4, None), (5, "word0")], ITEM)


def rows(df):
    return sorted((r.query_id, r.doc_id, r.score, r.rank) for r in df.collect())


def same(spark, index, docs, items):
    assert rows(index.search(items, k=5, ahead=2)) == rows(search.bm25(spark.createDataFrame(docs, DOC), items, 5))


def test_changes_as_if_indexed_anew(spark, texts, items, monkeypatch):
    monkeypatch.setattr(word_index, "STRIPE_ROWS", 20)
    of = lambda pairs: spark.createDataFrame(pairs, DOC)
    first = [(k, t) for k, t in enumerate(texts[:250])]
    index = word_index.build(of(first))
    assert index.stripes == 12
    same(spark, index, first, items)
    both = first + [(k, t) for k, t in enumerate(texts[250:], 250)] + [(900, None)]
    index = index.insert(of(both[250:]))
    same(spark, index, both, items)
    now = dict(both) | {k: texts[(7 * k) % 400] for k in range(0, 300, 9)}
    index = index.update(of([(k, now[k]) for k in range(0, 300, 9)]))
    same(spark, index, list(now.items()), items)
    for k in [*range(0, 60, 4), 900, 12345]:
        now.pop(k, None)
    index = index.delete(of([(k, None) for k in [*range(0, 60, 4), 900, 12345]]))
    same(spark, index, list(now.items()), items)
    merged = index.merged()
    same(spark, merged, list(now.items()), items)
    assert len(index.gens) == 4 and len(merged.gens) == 1
    same(spark, word_index.opened(spark, index.path, index.stripes), list(now.items()), items)
    # deleted and inserted again
    again = merged.delete(of([(9, None)])).insert(of([(9, "word150 word150")]))
    same(spark, again, list((now | {9: "word150 word150"}).items()), items)


def test_a_generation_that_broke_off_counts_for_nothing(spark, texts, items, monkeypatch):
    index = word_index.build(spark.createDataFrame(list(enumerate(texts[:50])), DOC))

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(word_index.WordIndex, "_publish", broken)
    with pytest.raises(RuntimeError):
        index.update(spark.createDataFrame([(k, "word1 word1") for k in range(50)], DOC))
    monkeypatch.undo()
    same(spark, index, list(enumerate(texts[:50])), items)
    same(spark, index.insert(spark.createDataFrame([(70, "word50")], DOC)), [*enumerate(texts[:50]), (70, "word50")], items)


def test_stripes_that_cannot_hold_a_hit_are_not_read(spark, monkeypatch):
    """A few texts of many equal words among long ones: after the first stripes the bounds of nearly all others are too low."""
    monkeypatch.setattr(word_index, "STRIPE_ROWS", 10)
    docs = [(k, "rare " + " ".join(f"x{j}" for j in range(k % 7 + 60))) if k % 50 else (k, "rare rare rare") for k in range(600)]
    docs += [(k, "plain text") for k in range(600, 1500)]
    index = word_index.build(spark.createDataFrame(docs, DOC))
    seen = {}
    keep = word_index.kept
    monkeypatch.setattr(word_index, "kept", lambda df, name: seen.setdefault(name, keep(df, name)))
    got = index.search(spark.createDataFrame([(1, "rare")], ITEM), k=5, ahead=8)
    assert rows(got) == rows(search.bm25(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, "rare")], ITEM), 5))
    all_stripes, late = seen["bounds"].count(), seen["stripes"]
    assert late.count() < all_stripes / 3
    size = lambda folders: sum(p.stat().st_size for f in folders for p in Path(index.path.removeprefix("file:"), "blocks", f"folder={f}").glob("*.parquet"))
    folders = {r[0] % word_index.FOLDERS for r in late.select("stripe").collect()} | {r[0] % word_index.FOLDERS for r in seen["bounds"].where(F.col("place") <= 8).select("stripe").collect()}
    assert size(folders) < size(range(word_index.FOLDERS)) / 2


def test_no_documents(spark, items):
    index = word_index.build(spark.createDataFrame([], DOC))
    assert index.search(items).collect() == []
    same(spark, index.insert(spark.createDataFrame([(1, "word1")], DOC)), [(1, "word1")], items)
