"""Texts cut into pieces, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hard_split(text: Column, most: int) -> Column:
    """Pieces of `most` characters; the last may be shorter. The empty text has none."""
    n = F.ceil(F.length(text) / most).cast("int")
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(text, (k - 1) * most + 1, F.lit(most))))


def messages(text: Column, most: int = 2000) -> Column:
    """Paragraphs (between blank lines) packed in order into messages of at most `most` characters; a paragraph
    that is longer is split hard. Null is empty and has no messages."""
    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: hard_split(p, most)))
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + 2 + F.length(p) <= most
        return (
            F.when(s["now"] == "", F.struct(p.alias("now"), s["done"].alias("done")))
            .when(fits, F.struct(F.concat(s["now"], F.lit("\n\n"), p).alias("now"), s["done"].alias("done")))
            .otherwise(F.struct(p.alias("now"), F.concat(s["done"], F.array(s["now"])).alias("done")))
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def token_windows(words: Column, size: int = 6000, overlap: int = 100) -> Column:
    """Windows of `size` words, each beginning `overlap` words before the end of the one before."""
    stride = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / stride).cast("int"))
    return F.when(F.size(words) < 1, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(words, k * stride + 1, F.lit(size))))
