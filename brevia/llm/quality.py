"""Quality rules with cross-document line frequency; DataFrame functions only.

Base: counts of a document's words, symbols, repeated lines and words in repeated windows. Method: lines are
normalised (lower case, white space as one space) and hashed; for each host (column source) and line the distinct
documents are counted; lines of more than max_documents of them are removed; a document that keeps fewer than
30 % of its words is depleted and rejected.

Copies are one document: within a host, documents with the same text (by its 64-bit hash; the SQL compares texts) count
once. So a large group of exact copies doesn't make its own lines frequent; texts that differ anywhere are distinct
documents. A filtered table's documents lose their frequent lines, and n_chars, where there is one, is the new length.

Defined results: a null text has no words and fails the base; a null source is a host of its own; rows with the same
doc_id, source and text are decided alike; an empty table gives no rows; other columns are ignored, or kept where a
whole document table is filtered (whatever they are called).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, words

MAX_DOCUMENTS = 30
#: Frequent lines that may be broadcast (about 32 bytes each, in their host's table).
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(n: int = 8) -> dict[str, Column]:
    """Columns to add one after the other; the last is the number of words in windows that occur twice or more."""
    # hw is named more than once, else the optimiser would put its expression into the lambda
    windows = F.when(F.size("hw") < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("hw") - (n - 1)), lambda k: F.xxhash64(F.slice("hw", k, n)))
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    s = F.when(F.size("h") == F.size(F.array_distinct("h")), none).otherwise(F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    at = lambda k: F.get("s", k)["h"]
    same = lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False))
    i = F.array_sort(F.transform(F.filter("s", same), lambda x: x["i"]))
    steps = F.transform("i", lambda x, k: F.when(k == 0, F.lit(n)).otherwise(F.least(F.lit(n), x - F.get("i", k - 1))))
    # each word is hashed once, windows are hashes of their words' hashes
    return {"hw": F.transform("w", lambda w: F.xxhash64(w)), "h": windows, "s": s, "i": i, "n_repeat_words": F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)}


def _normal_lines(text: Column) -> Column:
    """Lower case, white space inside as one space, none at the ends; lines without a word are empty."""
    # a single space is no match, so most of a text is passed over
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\x20{2,}[\x20\x09\x0B-\x0D]*|\x20?[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*", " ")
    return F.transform(F.split(spaced, "\n"), lambda x: F.trim(x))


def profiled(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs (doc_id, source, text, ...) with METRICS, base_failed, host (hash), content (hash of the text) and
    lines: array<struct<line (hash), words>>, of words 0 where the line is empty. Each text is gone through once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)], "source", "text")
    df = df.withColumn("w", words(F.col("text"))).withColumn("filled", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    for name, col in _repeat_words().items():
        df = df.withColumn(name, col)
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    lines = F.transform(_normal_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), F.when(x == "", 0).otherwise(spaces(x) + 1).alias("words")))
    measures = {
        "n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long"), "n_repeat_words": F.col("n_repeat_words"), "host": F.xxhash64("source"), "content": F.xxhash64("text"), "lines": lines,
    }
    df = df.select(*[f"kept{k}" for k in range(len(keep))], *[c.alias(n) for n, c in measures.items()])
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def frequent_lines(profiles: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line) of the lines that stand in more than max_documents distinct documents of a host."""
    lines = profiles.select("host", "content", F.explode("lines").alias("l")).where("l.words > 0").select("host", "content", "l.line")
    return lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_documents).select("host", "line")


def line_tables(frequent: DataFrame) -> DataFrame:
    """(host, table): a hash table of each host's frequent lines: array of slots, of which that at line modulo their number
    holds the line. So a document finds its own frequent lines in its row, however many its host has."""
    slots = frequent.groupBy("host").agg((F.count("*") / 2 + 1).cast("int").alias("slots"))
    held = frequent.join(slots, "host").groupBy("host", F.pmod("line", "slots").cast("int").alias("slot")).agg(F.collect_list("line").alias("x"))
    every = slots.select("host", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    none = F.array().cast("array<bigint>")
    own = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("x", none).alias("x"))))
    return every.join(held, ["host", "slot"], "left").groupBy("host").agg(F.transform(own, lambda s: s["x"]).alias("table"))


def _judged(docs: DataFrame, max_documents: int, *keep: str) -> tuple[DataFrame, Column]:
    """profiled() rows with kept, and their host's table of frequent lines; and the test whether a line is in it."""
    profiles = cut(profiled(docs, *keep), "profiles")
    frequent = cut(frequent_lines(profiles, max_documents), "frequent_lines")
    tables = line_tables(frequent)
    df = profiles.join(F.broadcast(tables) if frequent.count() <= BROADCAST_ROWS else tables, "host", "left")
    in_table = lambda line: F.coalesce(F.array_contains(F.get("table", F.pmod(line, F.size("table")).cast("int")), line), F.lit(False))
    removed = F.aggregate(F.filter("lines", lambda x: (x["words"] > 0) & in_table(x["line"])), F.lit(0), lambda a, x: a + x["words"])
    left = F.col("n_words") - F.when(F.col("table").isNull(), 0).otherwise(removed)
    return df.withColumn("kept", ~F.col("base_failed") & (10 * left >= 3 * F.col("n_words"))), in_table


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """doc_id and source with METRICS, base_failed and kept, for every row of docs (doc_id, source, text)."""
    df, _ = _judged(pick(docs, doc_id="long", source="string", text="string"), max_documents, "doc_id", "source")
    return df.select(F.col("kept0").alias("doc_id"), F.col("kept1").alias("source"), *METRICS, "base_failed", "kept")


def filtered(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """docs without the documents that are rejected, and the others without their frequent lines; all other columns as
    they are. Every row finds its lines in its host's table, so no text is shuffled."""
    names = docs.columns
    own = docs if "source" in names else docs.withColumn("source", F.lit(None).cast("string"))
    df, in_table = _judged(own, max_documents, *names)
    text = F.col(f"kept{names.index('text')}")
    string = text.cast("string")
    pairs = F.zip_with(F.split(string, "\n"), F.col("lines"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    hit = lambda z: (z["y"]["words"] > 0) & in_table(z["y"]["line"])
    some = F.col("table").isNotNull() & F.exists("lines", lambda x: (x["words"] > 0) & in_table(x["line"]))
    left = F.array_join(F.transform(F.filter(pairs, lambda z: ~hit(z)), lambda z: z["x"]), "\n")
    df = df.where("kept").withColumn("touched", some).withColumn("left", F.when(F.col("touched"), left).otherwise(string))
    kinds = docs.schema
    cols = {n: F.col(f"kept{k}") for k, n in enumerate(names)}
    cols["text"] = F.col("left").cast(kinds["text"].dataType)
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("touched"), F.length("left").cast(kinds["n_chars"].dataType)).otherwise(cols["n_chars"])
    return df.select(*[c.alias(n) for n, c in cols.items()])


def oracle(max_documents: int = MAX_DOCUMENTS) -> str:
    """judge() in SQL over the table documents."""
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, source, t, trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, source, t, unnest(string_split(lower(t), chr(10))) AS x FROM d)),
freq AS (SELECT source, line FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT t) > {max_documents}),
gone AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS removed FROM l JOIN freq ON l.line = freq.line AND l.source IS NOT DISTINCT FROM freq.source GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, sum(c) AS r FROM (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS c FROM dup) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 10 * (n_words - removed) >= 3 * n_words AS kept
FROM m
"""


ORACLE = oracle()
