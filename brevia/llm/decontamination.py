"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, units after numbers and names inside sentences become typed placeholders, other words lose case and
punctuation. Windows of the canonical words are hashed and joined between documents and benchmark items. For each
alignment of a document with an item the slots are compared: an alignment counts if it maps each of the item's slot
values to one value. A document leaks an item if the consistent alignments cover at least `share` of its windows.

Items of fewer than `window` words are looked for in windows of their own length; an item of fewer than 4 words, which
would be met by chance in many texts, is looked for as a whole document. Windows with fewer than 3 words beside the
placeholders are left out on both sides; an item with no other windows keeps them all. An item's first word may stand
inside a sentence of a document, where its capital makes it a name: the first window is looked for in both forms.

Defined results: null texts are empty; a row for each distinct document (doc_id, text) and item; null ids are kept;
repeated benchmark rows count once; empty tables give no rows; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WORD, cut, fresh, pick

NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
SLOT = f"[{NAME}{NUMBER}{UNIT}]"
#: Unit words.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|yards?|meters?|metres?|kilometers?|kilometres?|litres?|liters?|l|ml|gallons?|hours?|hrs?|h|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|degrees?|kilograms?|grams?"
LEAST_WORDS = 4
#: Rows that may be broadcast: benchmark windows (24 bytes each), leaking rows (keys and a few numbers); bytes of items.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20


def canonical(text: Column) -> Column:
    """Word by word: no white space is added or removed."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;]\x20)\p{Lu}[\p{L}\p{M}'’-]*", NAME)
    t = F.regexp_replace(t, r"[0-9]++(?:[.,:/][0-9]++)*+", NUMBER)
    t = F.regexp_replace(t, rf"(?i)({NUMBER}\x20?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    return F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D{NAME}{NUMBER}{UNIT}]++", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(canonical(text), NOT_WORD), lambda w: w != "")


def pairs(text: Column) -> Column:
    """Canonical words with what stands in the text: array<struct<c, v>>, of the same length as tokens()."""
    # at each white space by itself: a word of marks only is empty on one side, and would else be missing there
    each = r"[\x20\x09-\x0D]"
    zipped = F.arrays_zip(F.split(canonical(text), each).alias("c"), F.split(F.coalesce(text, F.lit("")), each).alias("v"))
    value = lambda v: F.regexp_replace(F.lower(v), r"^[^\p{L}\p{N}+$€£-]+|[^\p{L}\p{N}%]+$", "")
    return F.transform(F.filter(zipped, lambda x: x["c"] != ""), lambda x: F.struct(x["c"].alias("c"), value(x["v"]).alias("v")))


def _windows(words: str, n: Column | int) -> Column:
    """Hashes of the windows of n words, by start."""
    n = F.lit(n) if isinstance(n, int) else n
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.xxhash64(F.slice(words, k, n), n)))


def item_windows(benchmark: DataFrame, window: int = 8) -> DataFrame:
    """(item_id, item_hash, n, n_windows, j, h): j is the start, from 0; n_windows counts starts."""
    items = pick(benchmark, item_id="long", text="string").distinct().withColumn("w", tokens(F.col("text"))).where(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.lit(window), F.size("w")))
    named = F.when(F.coalesce("text", F.lit("")).rlike(rf"^[^\p{{L}}\p{{N}}]*\p{{Lu}}"), F.concat(F.array(F.lit(NAME)), F.slice("w", 2, window)))
    at = F.transform(_windows("w", F.col("n")), lambda h, j: F.struct(j.alias("j"), h.alias("h"), F.slice("w", j + 1, F.col("n")).alias("words")))
    as_name = F.when(named.isNotNull(), F.array(F.struct(F.lit(0).alias("j"), F.xxhash64(F.slice(named, 1, F.col("n")), F.col("n")).alias("h"), F.slice(named, 1, F.col("n")).alias("words"))))
    h = items.select("item_id", F.xxhash64("text").alias("item_hash"), "n", F.inline(F.concat(at, F.coalesce(as_name, F.slice(at, 1, 0)))))
    h = h.withColumn("plain", F.size(F.filter("words", lambda x: ~x.rlike(SLOT))) >= 3).drop("words")
    plain = F.size(F.collect_set(F.when(F.col("plain"), F.col("j"))).over(of_item := Window.partitionBy("item_id", "item_hash")))  # the words of one item
    h = h.withColumn("n_plain", plain).withColumn("n_all", F.size(F.collect_set("j").over(of_item)))
    n_windows = F.when(F.col("n_plain") == 0, F.col("n_all")).otherwise(F.col("n_plain")).cast("long")
    return h.where(F.col("plain") | (F.col("n_plain") == 0)).select("item_id", "item_hash", "n", n_windows.alias("n_windows"), "j", "h").distinct()


def _looked_at(n: int) -> Column:
    """The windows of n words of a document; of fewer than LEAST_WORDS only the whole document."""
    return _windows("w", n) if n >= LEAST_WORDS else F.when(F.size("w") == n, _windows("w", n)).otherwise(F.array().cast("array<bigint>"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.5) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, row_hash, item_id, n_windows, n_item_windows, n_slots,
    n_changed (slots whose value is another one in the document)."""
    bench = cut(item_windows(benchmark, window), "bench")
    small = bench.count() <= BROADCAST_ROWS
    lengths = sorted(r.n for r in bench.select("n").distinct().collect())  # 1 to window: few
    once = lambda df: F.broadcast(df) if small else df
    docs = pick(docs, doc_id="long", text="string").withColumn("row_hash", F.xxhash64("text"))
    worded = docs.select("doc_id", "row_hash", tokens(F.col("text")).alias("w"))
    packed = F.flatten(F.array(*[F.transform(_looked_at(n), lambda h, i: F.struct(i.alias("i"), h.alias("h"))) for n in lengths])) if len(lengths) > 1 else None
    if not lengths:
        at = worded.select("doc_id", "row_hash", F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("h")).limit(0)
    elif packed is None:
        at = worded.select("doc_id", "row_hash", F.posexplode(_looked_at(lengths[0])).alias("i", "h"))
    else:
        at = worded.select("doc_id", "row_hash", F.inline(packed))
    met = at.join(once(bench), "h").select("doc_id", "row_hash", "item_id", "item_hash", "n", "n_windows", "j", (F.col("i") - F.col("j")).alias("shift"))
    keys = ["doc_id", "row_hash", "item_id", "item_hash", "n", "n_windows"]
    aligned = met.groupBy(*keys, "shift").agg(F.collect_set("j").alias("js"))
    hits = aligned.groupBy(*keys).agg(F.collect_list(F.struct("shift", "js")).alias("a"), F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("any"))
    hits = cut(hits.where(F.col("any") >= share * F.col("n_windows")), "hits")
    # the slots: only documents with hits are read on; repeated rows are the same document
    few = hits.count() <= BROADCAST_ROWS
    of_doc = hits.select("doc_id", "row_hash").distinct()
    of_doc = F.broadcast(of_doc) if few else of_doc
    mine = docs.join(of_doc.withColumnsRenamed({"doc_id": "d", "row_hash": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")), "left_semi")
    mine = mine.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), pairs(F.col("text")).alias("p")).dropDuplicates(["d", "r"])
    items = pick(benchmark, item_id="long", text="string").distinct().select(F.col("item_id").alias("b"), F.xxhash64("text").alias("bh"), pairs(F.col("text")).alias("q"))
    j = hits.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")))
    held = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    items = F.broadcast(items) if held <= BROADCAST_BYTES else items
    j = j.join(items, F.col("item_id").eqNullSafe(F.col("b")) & (F.col("item_hash") == F.col("bh")))
    spots = lambda a: F.array_distinct(F.flatten(F.transform(a["js"], lambda s: F.sequence(s, s + F.col("n") - 1))))
    slot = lambda a: F.transform(
        F.filter(spots(a), lambda k: F.get("q", k)["c"].rlike(SLOT)), lambda k: F.struct(F.get("q", k)["v"].alias("item"), F.get("p", k + a["shift"])["v"].alias("doc"))
    )
    j = j.withColumn("s", F.transform("a", lambda a: F.struct(a["js"].alias("js"), F.array_distinct(slot(a)).alias("slots"))))
    steady = F.filter("s", lambda x: F.size(x["slots"]) == F.size(F.array_distinct(F.transform(x["slots"], lambda y: y["item"]))))
    j = j.withColumn("s", steady).withColumn("slots", F.array_distinct(F.flatten(F.transform("s", lambda x: x["slots"]))))
    j = j.withColumn("n_covered", F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: x["js"])))))
    return j.where(F.col("n_covered") >= share * F.col("n_windows")).select(
        "doc_id", "row_hash", "item_id", F.col("n_covered").cast("long").alias("n_windows"), F.col("n_windows").alias("n_item_windows"),
        F.size("slots").cast("long").alias("n_slots"), F.size(F.filter("slots", lambda x: x["item"] != x["doc"])).cast("long").alias("n_changed"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item; all columns as they are."""
    doc_id, row = fresh(docs, "leak_doc", "leak_row")
    bad = cut(leaks(docs, benchmark).select(F.col("doc_id").alias(doc_id), F.col("row_hash").alias(row)).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row))
    return docs.join(bad, same, "left_anti")
