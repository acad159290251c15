"""Files written from the tables and read back (SRC1, SRC2, SRC4, SRC6, SRC8-SRC10, SNK4, SNK5, SNK7)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from brevia.operators import ingest
from brevia.plans.core import fixture, query, t
from brevia.sources import docx, files
from brevia.storage import scratch
from brevia.streaming import fanout

_SUMS = "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source"


def _sums(df):
    return df.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, md5(text) AS text_md5, source FROM documents")
def csv_round_trip(spark, d):
    """SRC8, SNK7: texts with line ends and quotes through CSV files."""
    path = scratch(spark, "csv")
    t(spark, d, "documents").select("doc_id", "text", "source").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.csv_rows(spark, path, "doc_id long, text string, source string").select("doc_id", F.md5("text").alias("text_md5"), "source")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS total_ms, CASE WHEN event_id % 3 = 0 THEN value END AS generation_ms FROM events WHERE event_id % 7 <> 0 AND (event_id % 2 = 0 OR event_id % 3 = 0)")
def log_entries(spark, d):
    """SRC9: events as JSON lines, every seventh cut in two."""
    path, i = scratch(spark, "log"), F.col("event_id")
    entry = F.to_json(F.struct("event_id", F.when(i % 2 == 0, F.col("value")).alias("rag_query_timing_total_ms"), F.when(i % 3 == 0, F.col("value")).alias("llm_generation_duration_ms")))
    t(spark, d, "events").select(F.when(i % 7 == 0, F.substring(entry, 1, 9)).otherwise(entry).alias("value")).write.text(path)
    e = files.log_entries(spark, path, "event_id long, rag_query_timing_total_ms double, llm_generation_duration_ms double, response_completed string")
    return e.select("event_id", F.col("rag_query_timing_total_ms").alias("total_ms"), F.col("llm_generation_duration_ms").alias("generation_ms"))


_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_PATH = "CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'src/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END END"


@query(f"SELECT {_PATH} AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'text' WHEN doc_id % 2 = 0 THEN 'python' ELSE 'markdown' END AS language, md5({_STRIPPED}) AS text_md5, CAST(CASE WHEN {_STRIPPED} = '' THEN 0 ELSE length({_STRIPPED}) - length(replace({_STRIPPED}, chr(10), '')) + 1 END AS INT) AS line_end FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F]')")
def xml_files(spark, d):
    """SRC2: texts as files of an XML bundle, every fifth without a path. XML has no control characters, so texts with some aren't
    written."""
    path, i = scratch(spark, "xml"), F.col("doc_id")
    name = F.when(i % 5 != 0, F.concat(F.lit("src/f"), i.cast("string"), F.when(i % 2 == 0, ".py").otherwise(".md")))
    rows = t(spark, d, "documents").where(~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F]")).select(name.alias("_path"), F.col("text").alias("_VALUE"))
    rows.write.format("xml").option("rootTag", "files").option("rowTag", "file").save(path)
    return files.xml_files(spark, path).select("file_path", "language", F.md5("text").alias("text_md5"), "line_end")


GOLD = """{"version": 2, "cases": [
 {"id": "c1", "scenario": "Revogacao", "query": "q1", "expected": {"must_signal": ["a", "b"], "must_cite": ["Lei 8.112", "Art. 5-A da CF"], "forbidden": []}},
 {"id": "c2", "scenario": "conflito_temporal", "query": "q2", "expected": {"must_signal": [], "must_cite": []}},
 {"id": "c3", "query": "q3", "expected": {}}, {"id": "c4", "scenario": "veto", "query": "q4", "expected": {"must_cite": ["art. 12"]}}]}"""


@query("SELECT * FROM (VALUES ('c1', 'artigo', 'q1', 'Lei 8.112', '5-A', 'a|b'), ('c2', 'jurisprudencia', 'q2', NULL, NULL, ''), ('c3', 'geral', 'q3', NULL, NULL, ''), ('c4', 'artigo', 'q4', 'art. 12', '12', '')) g(id, kind, query, document, article, keywords)")
def goldset_cases(spark, d):
    """SRC10, EV4."""
    path = scratch(spark, "gold")
    fixture(spark, [(GOLD,)], "value string").write.text(path)
    return files.cases(spark, path).withColumn("keywords", F.array_join("keywords", "|"))


@query("SELECT DISTINCT source, true AS filled FROM documents")
def listed_files(spark, d):
    """SRC4: files of a folder for each source, found below it by their names."""
    path = scratch(spark, "tree")
    t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("value"), "source").write.partitionBy("source").text(path)
    found = files.listed(spark, path, "part-*.txt").select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "length")
    return found.groupBy("source").agg((F.sum("length") > 0).alias("filled"))


@query(_SUMS)
def plain_scan(spark, d):
    """SRC6: what pages of 250 rows would read, as one scan."""
    return _sums(t(spark, d, "documents"))


@query("SELECT sink, source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source), (SELECT unnest(['primary', 'secondary']) AS sink)")
def dual_write(spark, d):
    """SNK4: one DataFrame to two sinks of different formats, both read back."""
    df, first, second = t(spark, d, "documents").select("doc_id", "source"), scratch(spark, "primary"), scratch(spark, "secondary")
    df.write.parquet(first)
    df.write.json(second)
    back = spark.read.parquet(first).withColumn("sink", F.lit("primary")).unionByName(spark.read.schema("doc_id long, source string").json(second).withColumn("sink", F.lit("secondary")))
    return back.groupBy("sink", "source").agg(F.count("*").alias("n"))


class Unsteady:
    """What a sink does to a batch, failing the first time that the batch with the smallest id comes."""

    def __init__(self):
        self.failed = False

    def __call__(self, batch):
        if not self.failed and not batch.where("doc_id = 0").isEmpty():
            self.failed = True
            raise OSError("unreachable")
        return batch


@query("SELECT sink, source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CASE WHEN sink = 'primary' THEN false ELSE true END AS lagged FROM documents, (SELECT unnest(['primary', 'secondary']) AS sink) GROUP BY sink, source")
def fanned_out(spark, d):
    """SNK4: a stream in four batches to two sinks, of which the second fails once, is behind then, and is brought level; the
    stream is run twice, and so is the levelling."""
    rows, place = t(spark, d, "documents").select("doc_id", "source"), scratch(spark, "fanout")
    rows.repartition(4, "doc_id").write.parquet(f"{place}/in")
    first, second = fanout.Sink(f"{place}/primary"), fanout.Sink(f"{place}/secondary", "json", Unsteady())
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        fanout.run(stream, first, {"secondary": second}, f"{place}/checkpoint")
    behind = fanout.lag(spark, first, {"secondary": second}).count()
    brought = [len(fanout.level(spark, first, second, rows.schema)) for _ in range(2)]
    read = lambda name, sink, late: sink.read(spark, rows.schema).withColumns({"sink": F.lit(name), "lagged": F.lit(late)})
    both = read("primary", first, False).unionByName(read("secondary", second, behind == 1 and brought == [1, 0]))
    return both.groupBy("sink", "source", "lagged").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1")
def resumed_upload(spark, d):
    """SNK5: a run that ends after a third of the rows, and one that goes on from its checkpoint: no row twice."""
    rows = t(spark, d, "documents").select("doc_id")
    path = scratch(spark, "upload")
    rows.where("doc_id % 3 = 0").withColumn("run", F.lit(1)).write.parquet(f"{path}/run1")
    ingest.pending(rows, spark.read.parquet(f"{path}/run1"), "doc_id").withColumn("run", F.lit(2)).write.parquet(f"{path}/run2")
    both = spark.read.parquet(f"{path}/run1").unionByName(spark.read.parquet(f"{path}/run2"))
    return both.groupBy("run").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


#: XML can't hold these characters; every seventh file is cut off.
_LINES = "l AS (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', ' ', 'g'), chr(10)) AS x FROM documents WHERE doc_id % 7 <> 0)"


#: Files that a task holds at once.
FILES = 64


def file_writer():
    """From batches (doc_id, text) to batches of at most FILES files (path, content)."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, FILES):
                part, made = b.slice(start, FILES), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = text.split("\n")
                    whole = docx.written([(lines[0], "Heading 2"), *[(x, None) for x in lines[1:]]], [["cell 0", "cell 1"]], ["foot", "foot"])
                    made.append(whole[: len(whole) // 2] if i % 7 == 0 else whole)
                yield pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in part.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])

    return run


def word_files(spark, d):
    text = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " ").alias("text")
    return t(spark, d, "documents").select("doc_id", text).mapInArrow(file_writer(), "path string, content binary")


@query(
    f"WITH {_LINES}, p AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS idx, 'body' AS source FROM l UNION ALL SELECT doc_id, 'cell ' || c, len(x) + c + 1, 'table:r0c' || c FROM l, (SELECT unnest([0, 1]) AS c) "
    "UNION ALL SELECT doc_id, 'foot', len(x) + 3, 'footer:1' FROM l) SELECT 'd' || doc_id AS path, CAST(idx AS INT) AS idx, source, md5(text) AS text_md5, CAST(CASE WHEN source = 'body' AND idx = 1 THEN 2 ELSE 0 END AS INT) AS level FROM p"
)
def docx_paragraphs(spark, d):
    """SRC1: all documents written as word-processor files, a heading first, a table and two equal footers behind, and read back;
    those that are cut off don't stop the others."""
    rows, _ = docx.parsed(word_files(spark, d))
    return rows.select("path", "idx", "source", F.md5("text").alias("text_md5"), F.coalesce("level", F.lit(0)).alias("level"))


@query("SELECT 'd' || doc_id AS path, 'no word-processor document: BadZipFile' AS error FROM documents WHERE doc_id % 7 = 0")
def docx_failures(spark, d):
    """SRC1: the files that can't be read, and why."""
    return docx.parsed(word_files(spark, d))[1]
