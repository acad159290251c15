"""Writes, deletions and incremental loads as DataFrames (SNK1-SNK3, SNK6-SNK8, SNK11, J4-J6, J10, C11-C14, K1-K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """SNK6: of rows with the same key the last one by `order`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK2, SNK6: rows of `new` instead of those of the same key, and all others; a key stands once in `new`."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def with_embeddings(chunks: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """SNK1: chunks with the embeddings of `new`; where that has none, their own. Ids that no chunk has are skipped."""
    own = new.select(key, F.col("embedding").alias("_new"))
    return chunks.join(own, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def saved_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK2: which row a document of `new` (id, name, content_hash) is saved as: that of the same hash, else that of the same
    id, else a row of its own. (id, saved_as, how). Of several old rows with a hash the smallest id."""
    by_hash = old.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("id").alias("same_hash"))
    j = new.join(by_hash, "content_hash", "left").join(old.select("id", F.lit(True).alias("there")), "id", "left")
    how = F.when(F.col("same_hash").isNotNull(), "hash").when(F.col("there"), "id").otherwise("new")
    return j.select("id", F.coalesce("same_hash", "id").alias("saved_as"), how.alias("how"))


def deleted(documents: DataFrame, chunks: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK11, J10: documents, chunks and links without the documents of `gone` (doc_id), their chunks, and links of these."""
    left = chunks.join(gone, "doc_id", "left_anti")
    away = chunks.join(gone, "doc_id", "left_semi").select("chunk_id")
    for side in ("src", "dst"):
        links = links.join(away.withColumnRenamed("chunk_id", side), side, "left_anti")
    return documents.join(gone, "doc_id", "left_anti"), left, links


def pending(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """J6, SET5: files that the checkpoint doesn't hold."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def reused(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks (chunk_id, content_hash) with the embedding of an old one (content_hash, order, embedding) of the same
    hash: each old one is used once, the last one first, those without an embedding never. Others get null."""
    ask = F.row_number().over(Window.partitionBy("content_hash").orderBy("chunk_id"))
    have = F.row_number().over(Window.partitionBy("content_hash").orderBy(F.desc("order")))
    stock = old.where("embedding IS NOT NULL").select("content_hash", have.alias("n"), F.col("embedding").alias("reused"))
    return new.withColumn("n", ask).join(stock, ["content_hash", "n"], "left").drop("n")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of an incremental load, of (path, hash): unchanged, moved (the hash was under another path),
    changed, new, and deleted for paths that are gone and whose hash didn't move."""
    was = old.select(F.col("path").alias("path"), F.col("hash").alias("was"))
    moved_from = old.join(new.select("path"), "path", "left_anti").select(F.col("hash")).distinct().withColumn("free", F.lit(True))
    j = new.join(was, "path", "left").join(moved_from, "hash", "left")
    status = F.when(F.col("was") == F.col("hash"), "unchanged").when(F.col("was").isNotNull(), "changed").when(F.col("free"), "moved").otherwise("new")
    gone = old.join(new.select("path"), "path", "left_anti").join(new.join(was, "path", "left_anti").select("hash").distinct(), "hash", "left_anti")
    return j.select("path", status.alias("status")).unionByName(gone.select("path", F.lit("deleted").alias("status")))


def chunk_hash(text: Column, metadata: Column) -> Column:
    """C11: SHA-256 of the canonical JSON of a chunk's text and metadata (a map of strings, by key)."""
    entries = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(_json(e["key"]), F.lit(": "), _json(e["value"])))
    return F.sha2(F.concat(F.lit('{"metadata": {'), F.array_join(entries, ", "), F.lit('}, "text": '), _json(text), F.lit("}")), 256)


def _json(x: Column) -> Column:
    """A JSON string, or null."""
    listed = F.to_json(F.array(x))
    return F.when(x.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def repository_hash(name: Column, path: Column) -> Column:
    """C11."""
    return F.sha2(F.concat_ws("|", name, path), 256)


def index_metadata(metadata: Column) -> Column:
    """SNK3: of a map of JSON values (null, strings, numbers, lists): nulls dropped, the others as text."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != "null"))


def cell_class(value: Column, good: float, warn: float, more_is_better: bool = True) -> Column:
    """SNK8: the class of a cell of a report."""
    meets = (lambda x: value >= x) if more_is_better else (lambda x: value <= x)
    return F.when(value.isNull(), "").when(meets(good), "good").when(meets(warn), "warn").otherwise("bad")


def unpivoted(summary: DataFrame, *metrics: str) -> DataFrame:
    """SNK7: one row of metrics as (metric, value) rows."""
    return summary.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def cache_key(query: Column, k: Column, least: Column, mode: Column, profile: Column) -> Column:
    """K2: SHA-256 over the parameters of a search, the query in lower case and trimmed."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), k.cast("string"), least.cast("string"), mode, profile), 256)


def embedded(texts: DataFrame, embed: Column, dim_of: str = "embedding") -> DataFrame:
    """K3: each distinct text embedded once (embed is a column over `text`), and joined back by its MD5."""
    keyed = texts.withColumn("md5", F.md5("text"))
    once = keyed.select("md5", "text").dropDuplicates(["md5"]).select("md5", embed.alias(dim_of))
    return keyed.join(once, "md5").drop("md5")


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The deterministic embedder that stands in for a model: a unit vector from the text's hashes; of an empty text the
    zero vector."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: (F.pmod(F.xxhash64(text, k), F.lit(2_000_001)) - 1_000_000) / 1e7)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(F.transform(raw, lambda x: (x / norm).cast("float")))
