"""A word index that is kept (V6, SNK3): postings in blocks, searched by the blocks' bounds, changed by generations.

A document belongs to a stripe by the hash of its id, so that the postings of all terms for it lie in the same stripe; a block is a
term's postings in one stripe of one generation: ids as gaps from the first, frequencies, lengths, and bounds (the largest
frequency, the least length). Folders hold stripes, and their files are sorted by term, so that a search reads the folders and row
groups it needs. The first scan reads bounds only. From them each query knows the most that a document of a stripe can
score; the best stripes are scored first, and then only those that can still hold one of its k best.

An insertion, an update or a deletion writes a generation: blocks of its documents, and the ids that it takes from the ones
before. A generation counts once its line in `generations` is written, which comes last; one that broke off before is as
if it hadn't been. Words of each document are kept with it and their frequencies: blocks are made from them, and a deletion knows whose counts go down. merged() writes
all that is left as one generation.

Ids are unique in the index: an insertion of an id that is there has to be an update. Null texts have no words and are counted
as documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.functions.columns import let
from brevia.functions.text import terms
from brevia.operators.search import words
from brevia.storage import kept, scratch

#: Documents of a stripe, about, and folders at most.
STRIPE_ROWS, FOLDERS = 4096, 256
#: Terms that are named to the scan; more are joined.
FEW_TERMS = 2000
#: Partitions that a change or a search deals stripes to, at most, and rows of changed documents, queries' terms or stripes that are broadcast.
PARTS, BROADCAST_ROWS = 2048, 2_000_000
BLOCK = "term string, stripe long, first long, gaps array<bigint>, tfs array<int>, lens array<int>, n long, max_tf int, min_len int, gen int, folder int"
GONE = "doc_id long, doc_len int, words array<string>, tfs array<int>, gen int"
LINE = "gen int, docs long, length long"


@dataclass
class WordIndex:
    spark: SparkSession
    path: str
    stripes: int
    gens: tuple[int, ...] = ()

    # --- changes ------------------------------------------------------------------------------------------------------
    def insert(self, docs: DataFrame) -> WordIndex:
        """The index with documents (doc_id, text) more."""
        return self._change(docs, None)

    def update(self, docs: DataFrame) -> WordIndex:
        """The index with these documents in place of those of the same ids."""
        return self._change(docs, docs.select("doc_id"))

    def delete(self, ids: DataFrame) -> WordIndex:
        """The index without the documents of these ids (doc_id)."""
        return self._change(None, ids)

    def _change(self, docs: DataFrame | None, taken: DataFrame | None) -> WordIndex:
        # beyond the numbers of generations that broke off, too
        gen = 1 + max([0, *self.gens, *[self._all(name).agg(F.max("gen")).first()[0] or 0 for name in ("documents", "gone")]])
        if taken is not None:
            ids = taken.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            self._documents().join(ids, "doc_id", "left_semi").select("doc_id", "doc_len", "words", "tfs", F.lit(gen).alias("gen")).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/gone")
        if docs is not None:
            w = words(F.coalesce(F.col("text"), F.lit("")))
            rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(F.sort_array(w), _runs).alias("r"))
            rows = rows.select("doc_id", F.col("r.n").alias("doc_len"), F.col("r.words").alias("words"), F.col("r.tfs").alias("tfs"), F.lit(gen).alias("gen"))
            rows.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/documents")
            self._write(self._all("documents").where(F.col("gen") == gen), gen)
        size = lambda name: self._all(name).where(F.col("gen") == gen).agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        more, less = size("documents"), size("gone")
        return self._publish(gen, more[0] - less[0], more[1] - less[1])

    def _publish(self, gen: int, docs: int, length: int) -> WordIndex:
        self.spark.createDataFrame([(gen, docs, length)], LINE).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
        return WordIndex(self.spark, self.path, self.stripes, (*self.gens, gen))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with a stripe, those of a stripe in one partition: what groups by the stripe and more needs no further shuffle."""
        return rows.repartition(min(self.stripes, PARTS), "stripe")

    def _stripe(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.stripes))

    def _write(self, docs: DataFrame, gen: int) -> None:
        """docs: rows of `documents`. Only they are shuffled, a row for each, and not their postings."""
        dealt = self._dealt(docs.select(self._stripe().alias("stripe"), "doc_id", "doc_len", F.array_join("words", " ").alias("words"), "tfs").where("doc_len > 0"))
        posted = dealt.select("stripe", "doc_id", "doc_len", F.inline(F.arrays_zip(F.split("words", " ").alias("term"), F.col("tfs").alias("tf"))))
        own = F.array_sort(F.collect_list(F.struct("doc_id", "tf", "doc_len")))
        blocks = posted.groupBy("term", "stripe").agg(own.alias("p")).withColumn("first", F.get("p", F.lit(0))["doc_id"])
        field = lambda name: F.transform("p", lambda x: x[name])
        gaps = F.transform("p", lambda x: x["doc_id"] - F.col("first"))
        blocks = blocks.select(
            "term", "stripe", "first", gaps.alias("gaps"), field("tf").alias("tfs"), field("doc_len").alias("lens"), F.size("p").cast("long").alias("n"), F.array_max(field("tf")).alias("max_tf"),
            F.array_min(field("doc_len")).alias("min_len"), F.lit(gen).alias("gen"), F.pmod("stripe", F.lit(FOLDERS)).cast("int").alias("folder"),
        )
        blocks.sortWithinPartitions("folder", "term", "stripe").write.mode("append").option("compression", "zstd").partitionBy("folder").parquet(f"{self.path}/blocks")

    # --- reading ------------------------------------------------------------------------------------------------------
    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(BLOCK if name == "blocks" else LINE if name == "generations" else GONE).parquet(f"{self.path}/{name}")

    def _whole(self, name: str) -> DataFrame:
        return self._all(name).where(F.col("gen").isin(list(self.gens)))

    def _gone(self) -> DataFrame:
        """(doc_id, words, until): a document's versions of generations before `until` are gone."""
        return self._whole("gone").withColumnRenamed("gen", "until")

    def _documents(self) -> DataFrame:
        return self._left(self._whole("documents"))

    def _left(self, rows: DataFrame) -> DataFrame:
        """The rows (doc_id, gen, ...) whose generation is the document's last."""
        until = self._gone().groupBy("doc_id").agg(F.max("until").alias("until"))
        until = F.broadcast(until) if self._whole("gone").count() <= BROADCAST_ROWS else until
        return rows.join(until, "doc_id", "left").where(F.coalesce(F.col("gen") >= F.col("until"), F.lit(True))).drop("until")

    def _postings(self, blocks: DataFrame, *keep: str) -> DataFrame:
        p = F.explode(F.arrays_zip("gaps", "tfs", "lens")).alias("p")
        return self._left(blocks.select("gen", "first", *keep, p).select(*keep, "gen", (F.col("first") + F.col("p.gaps")).alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("doc_len")))

    def merged(self) -> WordIndex:
        """The same documents as one generation, elsewhere."""
        new = _empty(self.spark, self.stripes)
        self._documents().withColumn("gen", F.lit(1)).write.mode("append").option("compression", "zstd").parquet(f"{new.path}/documents")
        new._write(new._all("documents"), 1)
        return new._publish(1, *self._size())

    def _size(self) -> tuple[int, int]:
        r = self._whole("generations").agg(F.sum("docs"), F.sum("length")).first()
        return r[0] or 0, r[1] or 0

    def search(self, queries: DataFrame, k: int = 5, ahead: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """V6: (query_id, doc_id, score, rank) for queries (item_id, text). ahead: how many stripes a query scores before it
        knows what the others have to reach."""
        n_docs, length = self._size()
        mean = length / n_docs if n_docs and length else 1.0
        q = queries.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.flatten(F.transform(terms(F.col("text")), words)))).alias("term"))
        # few terms go to the scan, which skips the row groups without them
        few = [r.term for r in q.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        of_terms = self._whole("blocks").where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else self._whole("blocks").join(q.select("term").distinct(), "term", "left_semi")
        less = self._gone().select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("less"))
        df = of_terms.groupBy("term").agg(F.sum("n").alias("n")).join(less, "term", "left").select("term", (F.col("n") - F.coalesce("less", F.lit(0))).alias("df"))
        terms_asked = q.count()
        raw = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = q.join(df.where("df > 0"), "term").select("query_id", "term", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"))
        gain = lambda tf, dl: F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / mean))
        bounds = of_terms.select("term", "stripe", "max_tf", "min_len").join(weighted, "term")
        bounds = bounds.groupBy("query_id", "term", "stripe").agg(F.max(F.col("idf") * gain("max_tf", "min_len")).alias("most")).groupBy("query_id", "stripe").agg(F.sum("most").alias("most"))
        bounds = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "stripe")))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

        def scored(stripes: DataFrame) -> DataFrame:
            folders = [r[0] for r in stripes.select(F.pmod("stripe", F.lit(FOLDERS))).distinct().collect()]  # FOLDERS at most
            # blocks are dealt by stripe, and all that follows up to the k best of a stripe stays where they are
            blocks = self._dealt(of_terms.where(F.col("folder").isin(folders)).join(F.broadcast(stripes.select("stripe").distinct()), "stripe", "left_semi").select("stripe", "term", "first", "gaps", "tfs", "lens", "gen"))
            once = F.broadcast if stripes.count() <= BROADCAST_ROWS and terms_asked <= BROADCAST_ROWS else lambda df: df
            each = self._postings(blocks, "stripe", "term").join(once(weighted), "term").join(once(stripes), ["query_id", "stripe"], "left_semi")
            hits = each.groupBy("stripe", "query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * gain("tf", "doc_len")), 6).alias("score"))
            near = hits.withColumn("near", F.row_number().over(Window.partitionBy("stripe", "query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("near") <= k)
            return near.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        bounds = kept(bounds, "bounds")
        first = kept(scored(bounds.where(F.col("place") <= ahead).select("query_id", "stripe")), "first")
        reach = first.where(F.col("rank") == k).select("query_id", "score")
        rest = bounds.where(F.col("place") > ahead).join(reach, "query_id", "left").where(F.coalesce(F.col("most") >= F.col("score") - 1e-6, F.lit(True))).select("query_id", "stripe")
        both = first.drop("rank").unionByName(scored(kept(rest, "stripes")).drop("rank"))
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _runs(words_: Column) -> Column:
    """struct<n, words, tfs>: the number of sorted words, the different ones, and how often each stands there."""
    n = F.size(words_)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(words_, i) != F.get(words_, i - 1))))
    tfs = let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(n)), lambda a, z: z - a))
    return F.struct(n.alias("n"), F.array_distinct(words_).alias("words"), F.when(n > 0, tfs).otherwise(F.array().cast("array<int>")).alias("tfs"))


def _empty(spark: SparkSession, stripes: int) -> WordIndex:
    index = WordIndex(spark, scratch(spark, "words"), stripes)
    for name, schema in (("blocks", BLOCK), ("documents", GONE), ("gone", GONE), ("generations", LINE)):
        out = spark.createDataFrame([], schema).write
        (out.partitionBy("folder") if name == "blocks" else out).parquet(f"{index.path}/{name}")
    return index


def build(docs: DataFrame) -> WordIndex:
    """An index of documents (doc_id, text), with about STRIPE_ROWS of them in a stripe."""
    return _empty(docs.sparkSession, max(1, docs.count() // STRIPE_ROWS)).insert(docs)


def opened(spark: SparkSession, path: str, stripes: int) -> WordIndex:
    """The index at a path with all its whole generations."""
    index = WordIndex(spark, path, stripes)
    return WordIndex(spark, path, stripes, tuple(sorted(r.gen for r in index._all("generations").select("gen").collect())))
