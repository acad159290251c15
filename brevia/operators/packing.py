"""Requests to an embedding service (C10): texts packed in order under a budget of tokens, long ones split, empty ones left out.

Which text a request ends before depends on where it began. So each text is given the text that would begin the next
request if it began one itself (its successor, found in prefix sums), and pointer doubling from the first text keeps
those that do begin one. No task sees more than the texts of one budget's worth of tokens, or two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions import pieces
from brevia.storage import kept

#: Tokens of a request, of an input, and those that parts of a long input share.
BUDGET, INPUT, OVERLAP = 200_000, 6_000, 100


def numbered(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """df with pos, the place of each row (from 0) in the order of `by`, and before, the sum of `amount` up to it. Sorted runs
    number their own rows; only a row for each run is summed in one task."""
    runs = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "runs").withColumn("run", F.shiftright("at", 33))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("run").agg(F.count("*").alias("rows"), F.sum(amount).alias("sum"))
    offsets = sizes.select("run", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("rows", "sum")])
    own = Window.partitionBy("run", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a run is summed in slices of 65,536 rows, so that a window is short whatever the size of a run
    sliced = runs.withColumn("slice", F.shiftright(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), 16))
    parts = sliced.groupBy("run", "slice").agg(F.sum(amount).alias("part"))
    parts = parts.select("run", "slice", F.coalesce(F.sum("part").over(Window.partitionBy("run").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    summed = sliced.withColumn("own_before", F.coalesce(F.sum(amount).over(own), F.lit(0))).join(parts, ["run", "slice"]).join(offsets, "run")
    place = F.col("rows_before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return summed.select(*df.columns, place.alias("pos"), (F.col("sum_before") + F.col("parts_before") + F.col("own_before")).cast("long").alias("before"))


def _successors(texts: DataFrame, budget: int) -> DataFrame:
    """(pos, next) of numbered texts: the first one that no longer fits into a request which begins with pos."""
    b, end = F.lit(budget).cast("long"), F.col("before") + F.col("tokens")
    of = lambda x: F.floor(x / b)
    ends = texts.select(of(end).alias("bucket"), end.alias("value"), F.lit(0).alias("asks"), "pos")
    limits = texts.select((of(F.col("before")) + 1).alias("bucket"), (F.col("before") + b).alias("value"), F.lit(1).alias("asks"), "pos")
    so_far = Window.partitionBy("bucket").orderBy("value", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = ends.unionByName(limits).withColumn("last", F.max(F.when(F.col("asks") == 0, F.col("pos"))).over(so_far)).where("asks = 1")
    earlier = ends.groupBy((F.col("bucket") + 1).alias("bucket")).agg(F.max("pos").alias("last_before"))
    fits = F.greatest(F.coalesce("last", "last_before", "pos"), F.col("pos"))
    return found.join(earlier, "bucket", "left").select("pos", (fits + 1).alias("next"))


def _reached(jumps: DataFrame, begins: DataFrame) -> DataFrame:
    """All pos that steps along (pos, next) from the one in begins reach, itself included."""
    reached = begins
    while not jumps.where("pos = 0").isEmpty():
        on = reached.join(jumps, "pos").select(F.col("next").alias("pos"))
        further = jumps.select("pos", F.col("next").alias("over")).join(jumps.select(F.col("pos").alias("over"), F.col("next").alias("next")), "over").select("pos", "next")
        reached, jumps = kept(reached.unionByName(on), "begins"), kept(further, "jumps")
    return reached


def requests(texts: DataFrame, budget: int = BUDGET, by: str = "doc_id") -> DataFrame:
    """texts (with tokens, 1 at least) with pos, their place in the order of `by`, and request, the pos of the first text of
    theirs. A request is closed before the text with which it would hold more than `budget` tokens."""
    rows = kept(numbered(texts, [by], "tokens"), "numbered")
    jumps = _successors(rows, budget)
    begins = _reached(kept(jumps.join(rows.select(F.col("pos").alias("next")), "next", "left_semi").select("pos", "next"), "jumps"), rows.where("pos = 0").select("pos"))
    # a request spans `budget` tokens at most, so it began in the text's own bucket or in the one before
    bucket = F.floor(F.col("before") / budget)
    marked = rows.withColumn("bucket", bucket).join(begins.select("pos", F.col("pos").alias("begin")), "pos", "left")
    so_far = Window.partitionBy("bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = marked.groupBy((F.col("bucket") + 1).alias("bucket")).agg(F.max("begin").alias("begin_before"))
    found = marked.withColumn("own", F.max("begin").over(so_far)).join(earlier, "bucket", "left")
    return found.select(*texts.columns, "pos", F.coalesce("own", "begin_before").alias("request"))


def mean_of_parts(parts: Column, embed: Callable[[Column], Column], dimension: int) -> Column:
    """The L2-normalised mean of the vectors of parts (arrays of words), weighted by their words."""
    vectors = F.transform(parts, lambda p: F.struct(embed(F.array_join(p, " ")).alias("v"), F.size(p).cast("double").alias("w")))
    none = F.array_repeat(F.lit(0.0), dimension)
    total = F.aggregate(vectors, none, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b * x["w"]))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(total), lambda v: F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))), F.lit(0))


def embedded(texts: DataFrame, embed: Callable[[Column], Column], dimension: int, budget: int = BUDGET, most: int = INPUT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, tokens, parts, request, vector) of every text. A text without words has the zero vector and is in no request; one of more
    than `most` words is split into windows (C8), whose weighted mean (C9) it gets, in requests of its own; the others are
    packed into requests. embed: text to array<double>, such as a pandas UDF that calls the service for a batch."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\t\n\x0b\f\r]+"), lambda w: w != "")
    rows = texts.select("doc_id", "text", words.alias("w")).withColumn("tokens", F.size("w").cast("long"))
    regular = requests(rows.where((F.col("tokens") > 0) & (F.col("tokens") <= most)).select("doc_id", "text", "tokens"), budget)
    regular = regular.select("doc_id", "tokens", F.lit(1).alias("parts"), "request", embed(F.col("text")).alias("vector"))
    none = F.lit(None).cast("long").alias("request")
    split = rows.where(F.col("tokens") > most).withColumn("p", pieces.token_windows(F.col("w"), most, overlap))
    split = split.select("doc_id", "tokens", F.size("p").alias("parts"), none, mean_of_parts(F.col("p"), embed, dimension).alias("vector"))
    empty = rows.where("tokens = 0").select("doc_id", "tokens", F.lit(0).alias("parts"), none, F.array_repeat(F.lit(0.0), dimension).alias("vector"))
    return regular.unionByName(split).unionByName(empty)
