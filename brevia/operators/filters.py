"""Filters over chunk metadata, told as dictionaries (FLT1-FLT14, PRJ1)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys that a filter may name, and those with a meaning of their own.
KEYS = frozenset(
    "documento law_name law_number titulo capitulo secao artigo article paragrafo inciso tipo content_type source_type is_exam_focus exam_marks parent_chunk_id is_parent_chunk valid_from valid_to "
    "updated_by_law is_revoked is_vetoed revocation_scope veto_scope temporal_confidence effective_text_version marca_atencao marca_stf marca_stj marca_concurso marca_crime marca_pena marca_hediondo "
    "marca_acao_penal marca_militar marca_tcu banca ano file_path language layer module functions classes imports is_test".split()
)
EITHER = "__or__"
RANGES = ("valid_from_gte", "valid_from_lte", "valid_to_gte", "valid_to_lte")
#: What each kind of question looks for.
KINDS = {
    "artigo": {"artigo": "not_null"},
    "jurisprudencia": {EITHER: [{"source_type": "jurisprudencia"}, {"source_type": "jurisprudence"}, {"marca_stf": True}, {"marca_stj": True}]},
    "questao": {EITHER: [{"source_type": "questao_prova"}, {"source_type": "exam_question"}, {"banca": "not_null"}]},
    "lei": {"source_type": "lei_cf"},
    "ec": {"source_type": "emenda_constitucional"},
    "comentario": {EITHER: [{"source_type": "comentario"}, {"source_type": "commentary"}]},
    "nota": {},
}
#: Kinds that a request may name.
REQUESTED = ("artigo", "jurisprudencia", "questao", "nota", "todos")
NOTE_TOKENS = 100


def _field(meta: T.StructType, name: str, key: str) -> Column:
    if key not in KEYS:
        raise ValueError(f"no filter key {key!r}; known are {sorted(KEYS)}")
    return F.col(f"`{name}`.`{key}`") if key in meta.fieldNames() else F.lit(None)


def _compared(field: Column, value) -> Column:
    """FLT1 and FLT11: equality, not_null, is_null, or {"$eq": x}, {"$ne": x}; None stands for null."""
    if isinstance(value, dict):
        if len(value) != 1 or next(iter(value)) not in ("$eq", "$ne"):
            raise TypeError(f"a comparison is {{'$eq': x}} or {{'$ne': x}}, not {value}")
        ((sign, other),) = value.items()
        if other is None:
            return field.isNull() if sign == "$eq" else field.isNotNull()
        return field == F.lit(other) if sign == "$eq" else field != F.lit(other)
    if value in ("not_null", "is_null"):
        return field.isNotNull() if value == "not_null" else field.isNull()
    return field.isNull() if value is None else field == F.lit(value)


def condition(filters: dict | None, df: DataFrame, meta: str = "meta") -> Column:
    """One condition over the struct column `meta` of df. Keys are joined by and; "__or__" (or "$or") holds a list of
    dictionaries of which one has to hold; ranges compare ISO dates as text, and other than text is ignored there."""
    kind, parts = df.schema[meta].dataType, []
    for key, value in (filters or {}).items():
        if key in (EITHER, "$or"):
            if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
                raise TypeError(f"{key} holds a list of dictionaries")
            groups = [reduce(and_, [_compared(_field(kind, meta, k), v) for k, v in x.items()]) for x in value if x]
            parts += [reduce(or_, groups)] if groups else []
        elif key in RANGES:
            if isinstance(value, str):
                name, _, side = key.rpartition("_")
                field = _field(kind, meta, name)
                parts.append(field >= value if side == "gte" else field <= value)
        else:
            parts.append(_compared(_field(kind, meta, key), value))
    return reduce(and_, parts, F.lit(True))


def by_kind(kind: str | None) -> dict:
    """FLT6: the filter of a kind of question; an unknown kind filters nothing."""
    return KINDS.get((kind or "todos").strip().lower(), {})


def for_code(language: str | None = None, layer: str | None = None, module: str | None = None) -> dict:
    """FLT8."""
    return {k: v for k, v in (("language", language), ("layer", layer), ("module", module)) if v}


def merged(explicit: dict | None, extracted: dict | None) -> dict | None:
    """FLT9: what was said explicitly wins."""
    return {**(extracted or {}), **(explicit or {})} or None


def merged_maps(explicit: Column, extracted: Column) -> Column:
    """FLT9 for a row of each query: maps of filters."""
    return F.map_concat(F.map_filter(extracted, lambda k, _: ~F.coalesce(F.map_contains_key(explicit, k), F.lit(False))), F.coalesce(explicit, F.create_map().cast("map<string,string>")))


def allowed_kind(kind: Column) -> Column:
    """FLT14."""
    return F.lower(kind).isin(*REQUESTED)


def notes_or_all(ranked: DataFrame, k: int) -> DataFrame:
    """FLT7: of (query_id, rank, tokens, ...), ranked to 2 * k, the first k notes (fewer than NOTE_TOKENS tokens) of each query;
    of a query without notes the first k rows."""
    from pyspark.sql import Window

    of_query, note = Window.partitionBy("query_id"), F.col("tokens") < NOTE_TOKENS
    df = ranked.where(F.col("rank") <= 2 * k).withColumn("note", note).withColumn("any_note", F.max("note").over(of_query)).where("note OR NOT any_note")
    return df.withColumn("rank", F.row_number().over(of_query.orderBy("rank"))).where(F.col("rank") <= k).drop("any_note")


#: Older names of the document, and of kinds of content and source.
DOCUMENT_NAMES = ("fonte", "nome", "arquivo_origem")
UNKNOWN = "Documento Desconhecido"
CONTENT = {"jurisprudencia": "jurisprudence", "questao_prova": "exam_question", "questao": "exam_question", "comentario": "doctrine", "doutrina": "doctrine"}
SOURCE = {"lei": "lei_cf", "lei_cf88": "lei_cf", "jurisprudencia": "jurisprudence", "comentario": "commentary", "questao_prova": "exam_question", "questao": "exam_question"}


def canonical(meta: Column) -> Column:
    """PRJ1: of a map of metadata, the document's name under any of its names, and content and source under their present
    names (null where there is none)."""
    said = lambda k: F.nullif(F.trim(F.element_at(meta, k)), F.lit(""))

    def renamed(key: str, table: dict[str, str]) -> Column:
        value = F.lower(said(key))
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), value)

    own = F.nullif(F.element_at(meta, "documento"), F.lit(""))
    return F.struct(
        F.coalesce(own, *[said(k) for k in DOCUMENT_NAMES], F.lit(UNKNOWN)).alias("documento"), F.coalesce(said("artigo"), said("article")).alias("artigo"),
        renamed("content_type", CONTENT).alias("content_type"), renamed("source_type", SOURCE).alias("source_type"),
    )
