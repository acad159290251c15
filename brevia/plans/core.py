"""What the modules of queries share: the registry, table access, and SQL that several oracles need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brevia.functions import text as tx
from brevia.functions.patterns import quoted, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Vectors that are queries: those whose id is divisible by this.
EACH = 50
ASKED = f"vec_id % {EACH} = 0"
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda x: length(x) >= 3)"
GAPS = r"[\x00-\x20\x7F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Templates: their argument is an expression, and other braces are doubled.
_GAPS = GAPS.replace("{", "{{").replace("}", "}}")
FOLD = f"trim(regexp_replace(strip_accents(lower(translate(replace(coalesce({{0}}, ''), 'ß', 'ss'), 'ºª°', 'oao'))), '{_GAPS}', ' ', 'g'))"
STOP = ", ".join(quoted(w) for w in tx.STOP_WORDS)
TOK = f"list_filter(regexp_extract_all({FOLD}, '[a-z0-9à-ÿ]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))"
WORDS = f"regexp_extract_all({FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
UNITS = f"CAST(len(regexp_extract_all({FOLD}, '[a-z0-9_]+|[^a-z0-9_ ]')) AS BIGINT)"

__all__ = ["ASKED", "COS", "EACH", "FOLD", "ORACLES", "QUERIES", "STOP", "TERMS", "TOK", "UNITS", "WORDS", "fixture", "query", "quoted", "t", "values"]
