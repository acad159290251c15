"""fold() against Python's own normalisation, for every character and for mixed sequences."""

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from brevia.functions import text as tx

SPACES = re.compile("[\x00-\x20\x7F\u0085   -     　]+")


def plain(x):
    x = unicodedata.normalize("NFKC", x).replace("°", "o")
    x = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").casefold()
    return SPACES.sub(" ", x).strip(" ")


def same(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, x string").repartition(4)
    folded = df.select("k", tx.fold(F.col("x")).alias("f"))
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()
    bad = [(ascii(texts[r.k]), ascii(r.f)) for r in folded.collect() if r.f != plain(texts[r.k])]
    assert bad == []


def test_every_character(spark):
    same(spark, [f"x{chr(k)}y" for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000])


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_sequences(spark, seed):
    """Characters that decompose, marks of all classes, those that stay among them, and plain ones."""
    rng = random.Random(seed)
    everything = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    pools = ([c for c in everything if unicodedata.normalize("NFKD", c) != c], list(tx.folding().marks), list("".join(tx.folding().stay.values())), "aBc é\t ß")
    same(spark, ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 14))) for _ in range(6_000)])


def test_null_and_short_ways(spark):
    got = spark.createDataFrame([(None,), ("  A\t B ",), ("Ação  nº 5°",), ("Straße ﬁ Ⅳ 한",)], "x string").select(tx.fold(F.col("x")).alias("f")).collect()
    assert [r.f for r in got] == ["", "a b", "acao no 5o", "strasse fi iv " + unicodedata.normalize("NFD", "한")]
