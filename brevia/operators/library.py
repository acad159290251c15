"""An indexed library of files, loaded batch by batch (C12, C14, J4, SNK2, A17, A21).

State lies in the shared folder by generations. A generation holds all documents (a row each: id, path, hash, counts, and the
generation that holds its chunks) and the chunks of those documents alone that the batch changed. It counts once its
line in the ledger is written, which comes last and holds the batch's id: a batch that is given again changes nothing, and
one that broke off is as if it hadn't been.

A file is the document of the same content, wherever that lay before; else the one of the same path; else a new one. Of files
with the same content in a batch the last path counts. A document whose path now has another document's content goes. What
didn't change is neither parsed nor embedded; of a changed document those chunks are embedded that no old chunk of it
gives its vector to. A file that can't be parsed, or has no text, goes into the failures, and its document stays as it was.

The ledger's counters are gathered by the writes themselves (observed metrics), without a further pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brevia.operators import chunks, ingest
from brevia.sources import docx
from brevia.storage import kept, scratch

DOCUMENT = "doc_id string, name string, path string, hash string, chunk_gen int, chunks long, tokens long, status string, gen int"
CHUNK = "doc_id string, seq int, text string, tokens long, hash string, embedding array<float>, reused boolean, gen int"
FAILURE = "path string, error string, gen int"
COUNTERS = ("new", "changed", "unchanged", "failed", "deleted", "chunks", "reused", "embedded", "tokens")
#: Ids of documents that go to all paragraphs, at most.
BROADCAST_ROWS = 1_000_000
LINE = f"gen int, batch string, {', '.join(f'{c} long' for c in COUNTERS)}"


@dataclass
class Library:
    spark: SparkSession
    path: str
    gens: tuple[int, ...] = ()

    @classmethod
    def opened(cls, spark: SparkSession, path: str | None = None) -> Library:
        """The library at a path, or a new one."""
        new = cls(spark, path or scratch(spark, "library"))
        if path is None:
            for name, schema in (("documents", DOCUMENT), ("chunks", CHUNK), ("failures", FAILURE), ("ledger", LINE)):
                spark.createDataFrame([], schema).write.parquet(f"{new.path}/{name}")
        return cls(spark, new.path, tuple(sorted(r.gen for r in new._all("ledger", LINE).select("gen").collect())))

    def _all(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        return self._all("documents", DOCUMENT).where(F.col("gen") == (self.gens[-1] if self.gens else 0))

    def chunks(self) -> DataFrame:
        own = self.documents().select("doc_id", F.col("chunk_gen").alias("gen"))
        return self._all("chunks", CHUNK).where(F.col("gen").isin(list(self.gens))).join(own, ["doc_id", "gen"], "left_semi")

    def failures(self) -> DataFrame:
        """Of all batches."""
        return self._all("failures", FAILURE).where(F.col("gen").isin(list(self.gens)))

    def ledger(self) -> DataFrame:
        return self._all("ledger", LINE)

    def load(self, files: DataFrame, batch: str, parse: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column], rebuild: bool = False) -> Library:
        """The library after a batch of files (path, name, content). parse: (doc_id, content) to paragraphs (doc_id, idx, text, style,
        error); chunk: those to (doc_id, seq, text, tokens); embed: a text to array<float>. rebuild: all that was there before
        goes, and nothing of it is used again (C14)."""
        if not self.ledger().where(F.col("batch") == batch).isEmpty():
            return Library.opened(self.spark, self.path)
        # beyond the numbers of generations that broke off
        gen = 1 + max([0, *self.gens, *[self._all(n, s).agg(F.max("gen")).first()[0] or 0 for n, s in (("documents", DOCUMENT), ("chunks", CHUNK), ("failures", FAILURE))]])
        old = self.documents().where(F.lit(not rebuild))
        hashed = files.select("path", "name", "content", F.sha2("content", 256).alias("hash"))
        found = kept(_resolved(hashed.drop("content"), old), "resolved")
        paragraphs = kept(parse(found.where("status IN ('new', 'changed')").join(hashed, ["path", "hash"]).select("doc_id", "content")), "parsed")
        errors = paragraphs.groupBy("doc_id").agg(F.max("error").alias("error"), F.count_if(F.trim("text") != "").alias("filled"))
        failed = found.where("status IN ('new', 'changed')").join(errors, "doc_id", "left")
        failed = kept(failed.where("error IS NOT NULL OR coalesce(filled, 0) = 0").select("doc_id", "path", F.coalesce("error", F.lit("no text")).alias("error")), "failed")
        gathered = [self._write(failed.select("path", "error"), "failures", gen, failed=F.count("*"))]

        # ids go to the paragraphs, so that texts stay where they are; of very many both sides are shuffled
        to_all = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_ROWS else ids
        good = paragraphs.join(to_all(failed.select("doc_id"), gathered[0].get["failed"]), "doc_id", "left_anti").drop("error")
        made = chunk(good).withColumn("hash", F.sha2("text", 256))
        # an old chunk gives its vector to one of the same document only, so chunks of new documents have none to look for
        changed = found.where("status = 'changed'").select("doc_id")
        n_changed = changed.count()
        own = lambda df, reused: df.select("doc_id", F.col("seq").cast("int").alias("seq"), "text", F.col("tokens").cast("long").alias("tokens"), "hash", F.coalesce(reused, embed(F.col("text")).cast("array<float>")).alias("embedding"), reused.isNotNull().alias("reused"))
        vectors = own(made.join(to_all(changed, n_changed), "doc_id", "left_anti") if n_changed else made, F.lit(None).cast("array<float>"))
        if n_changed:
            key = F.concat_ws("|", "doc_id", "hash").alias("content_hash")
            had, order = self.chunks().join(to_all(changed, n_changed), "doc_id", "left_semi").where(F.lit(not rebuild)), F.struct("doc_id", "seq")
            anew = made.join(to_all(changed, n_changed), "doc_id", "left_semi").select("*", key, order.alias("chunk_id"))
            vectors = vectors.unionByName(own(ingest.reused(anew, had.select(key, order.alias("order"), "embedding")), F.col("reused")))
        gathered.append(self._write(vectors, "chunks", gen, chunks=F.count("*"), reused=F.count_if("reused"), embedded=F.count_if(~F.col("reused")), tokens=F.coalesce(F.sum("tokens"), F.lit(0))))

        counts = self._all("chunks", CHUNK).where(F.col("gen") == gen).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
        loaded = found.join(failed, "doc_id", "left_anti").join(counts, "doc_id", "left").join(old.select("doc_id", F.struct("chunk_gen", "chunks", "tokens").alias("was")), "doc_id", "left")
        fresh, been = F.col("status") != "unchanged", F.col("was")
        of = lambda new, name: F.when(fresh, new).otherwise(been[name]).alias(name)
        loaded = loaded.select("doc_id", "name", "path", "hash", of(F.lit(gen), "chunk_gen"), of(F.col("n"), "chunks"), of(F.col("t"), "tokens"), "status")
        displaced = old.join(found.select("path"), "path", "left_semi").join(found.select("doc_id"), "doc_id", "left_anti")
        rest = old.join(displaced.select("doc_id"), "doc_id", "left_anti").join(loaded.select("doc_id"), "doc_id", "left_anti").withColumn("status", F.lit("kept")).drop("gen")
        gone = displaced.withColumn("status", F.lit("deleted")).drop("gen")
        everything = loaded.unionByName(rest).unionByName(gone)
        n = lambda s: F.count_if(F.col("status") == s)
        counted = {s: n(s) for s in ("new", "changed", "unchanged", "deleted")}
        gathered.append(self._write(everything, "documents", gen, keep=F.col("status") != "deleted", **counted))

        counters = {k: v for own in gathered for k, v in own.get.items()}
        self.spark.createDataFrame([(gen, batch, *[counters[c] for c in COUNTERS])], LINE).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return Library(self.spark, self.path, (*self.gens, gen))

    def _write(self, df: DataFrame, name: str, gen: int, keep: Column | None = None, **counters: Column) -> Observation:
        seen = Observation()
        df = df.observe(seen, *[c.alias(k) for k, c in counters.items()])
        (df if keep is None else df.where(keep)).withColumn("gen", F.lit(gen)).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return seen


def _resolved(files: DataFrame, old: DataFrame) -> DataFrame:
    """SNK2, C12: files (path, name, hash) with the document that each is (doc_id) and status: unchanged, changed, new."""
    one = ingest.latest(files, "hash", "path")
    same = old.groupBy("hash").agg(F.min("doc_id").alias("same"))
    j = one.join(same, "hash", "left")
    free = old.join(j.where("same IS NOT NULL").select(F.col("same").alias("doc_id")), "doc_id", "left_anti").groupBy("path").agg(F.min("doc_id").alias("there"))
    j = j.join(free, "path", "left")
    status = F.when(F.col("same").isNotNull(), "unchanged").when(F.col("there").isNotNull(), "changed").otherwise("new")
    return j.select("path", "name", "hash", F.coalesce("same", "there", F.md5(F.concat_ws("|", "path", "hash"))).alias("doc_id"), status.alias("status"))


def text_lines(files: DataFrame) -> DataFrame:
    """A parse of load() for plain UTF-8 text: a paragraph for each line; content that isn't UTF-8 is an error."""
    text = F.try_validate_utf8("content")
    lines = files.select("doc_id", F.split(text, "\n").alias("x"), text.isNull().alias("bad"))
    each = lines.where("NOT bad").select("doc_id", F.posexplode("x").alias("idx", "text"))
    error = lines.where("bad").select("doc_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("text"), F.lit("not UTF-8").alias("error"))
    none = F.lit(None).cast("string")
    return each.withColumn("error", none).unionByName(error).withColumn("style", none)


def line_chunks(paragraphs: DataFrame) -> DataFrame:
    """A chunk of load() for each line that isn't empty."""
    return paragraphs.where(F.trim("text") != "").select("doc_id", F.col("idx").alias("seq"), "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("tokens"))


def word_paragraphs(files: DataFrame) -> DataFrame:
    """A parse of load() for word-processor files (SRC1)."""
    return docx.read(files.select(F.col("doc_id").alias("path"), "content")).select(F.col("path").alias("doc_id"), "idx", "text", "style", "error")


def legal_chunks(paragraphs: DataFrame) -> DataFrame:
    """A chunk of load(): the whole chunker."""
    names = paragraphs.select("doc_id", F.col("doc_id").alias("name")).distinct()
    return chunks.chunked(paragraphs.withColumn("text", F.coalesce("text", F.lit(""))), names).select("doc_id", "seq", "text", "tokens")
