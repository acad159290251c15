"""Files as DataFrames: listings, CSV, JSON lines, XML bundles of code, cases (SRC2, SRC4, SRC8-SRC10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions import code
from brevia.functions.patterns import Pattern


def listed(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """SRC4: (path, length) of the files whose name fits the pattern; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC8: rows of CSV files with a header; fields may hold line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


#: Keys of which a log entry has to hold one.
LOG_KEYS = ("rag_query_timing_total_ms", "llm_generation_duration_ms", "response_completed")


def log_entries(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = LOG_KEYS) -> DataFrame:
    """SRC9: JSON lines that hold any of the keys; lines that aren't JSON are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(reduce(lambda a, k: a | F.col(k).isNotNull(), keys, F.lit(False)))


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: a row for each <file path="..."> of XML bundles: file_path, language, text (stripped), line_start, line_end (0 of an
    empty text)."""
    rows = spark.read.format("xml").option("rowTag", "file").option("ignoreSurroundingSpaces", False).schema("_path string, _VALUE string").load(path)
    text = F.regexp_replace(F.coalesce("_VALUE", F.lit("")), r"^\s+|\s+$", "")
    file_path = F.coalesce("_path", F.lit("unknown"))
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return rows.select(file_path.alias("file_path"), code.language_of(file_path).alias("language"), text.alias("text"), F.lit(1).alias("line_start"), lines.alias("line_end"))


CITED_ARTICLE = Pattern(r"Art\.\s*([0-9]+(?:-[A-Za-z])?)")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: cases of a goldset: id, kind, query, expected document (the first citation), article and keywords."""
    item = "struct<id:string,scenario:string,query:string,expected:struct<must_signal:array<string>,must_cite:array<string>,forbidden:array<string>>>"
    c = spark.read.schema(f"cases array<{item}>").option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    scenario, cited = F.lower(F.coalesce("scenario", F.lit("geral"))), F.coalesce("expected.must_cite", F.array().cast("array<string>"))
    kind = F.when(scenario.isin("revogacao", "veto", "citacao_obrigatoria"), "artigo").when(scenario == "conflito_temporal", "jurisprudencia").otherwise("geral")
    article = F.get(F.filter(F.transform(cited, lambda x: F.regexp_extract(x, CITED_ARTICLE.java, 1)), lambda a: a != ""), F.lit(0))
    return c.select("id", kind.alias("kind"), "query", F.get(cited, F.lit(0)).alias("document"), article.alias("article"), F.coalesce("expected.must_signal", F.array().cast("array<string>")).alias("keywords"))
