"""Vector search as a table function of SQL (SRC11)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brevia.functions import containment

_DOT = "aggregate(zip_with({0}, {1}, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0D, (s, x) -> s + x)"


def register(chunks: DataFrame, name: str = "match_chunks") -> None:
    """Make `name(vector, k, least, wanted, document)` a table function of the session over chunks (chunk_id, document_id, embedding,
    metadata as JSON): the k rows at or over the least similarity, of the document (null: of any), whose metadata hold the JSON
    `wanted` (null: all rows). The result has chunk_id, document_id, similarity, metadata; ties go to the smallest chunk_id.
    Equal vectors of length 0 are similar to none."""
    spark = chunks.sparkSession
    containment.register(spark)
    chunks.select("chunk_id", "document_id", "embedding", "metadata").createOrReplaceTempView(f"{name}_chunks")
    dot = _DOT.format
    norms = f"sqrt({dot('embedding', 'embedding')}) * sqrt({dot('vector', 'vector')})"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(vector ARRAY<DOUBLE>, k INT, least DOUBLE, wanted STRING, document BIGINT)
        RETURNS TABLE (chunk_id BIGINT, document_id BIGINT, similarity DOUBLE, metadata STRING)
        RETURN SELECT chunk_id, document_id, similarity, metadata FROM (
          SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS place FROM (
            SELECT chunk_id, document_id, metadata, coalesce({dot('embedding', 'vector')} / nullif({norms}, 0), 0D) AS similarity
            FROM {name}_chunks
            WHERE embedding IS NOT NULL AND size(embedding) = size(vector)
              AND ({name}.document IS NULL OR document_id = {name}.document) AND ({name}.wanted IS NULL OR json_holds(metadata, {name}.wanted)))
          WHERE similarity >= {name}.least)
        WHERE place <= {name}.k""")
