"""Filters over metadata (FLT1-FLT14, PRJ1, PRJ2, SRC11).

The tables hold no legal metadata, so each document gets some by rules from its own columns; the SQL has the same rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brevia.functions import containment
from brevia.functions import text as tx
from brevia.operators import filters as flt
from brevia.operators import vector
from brevia.plans.core import ASKED, COS, FOLD, fixture, query, quoted, t, values
from brevia.sources import sql_search

#: Kinds of sources that documents get by their id.
SOURCES = ("lei_cf", "jurisprudencia", "jurisprudence", "questao_prova", "exam_question", "emenda_constitucional", "comentario", "commentary")
MD = (
    "md AS (SELECT doc_id, text, lang, source, n_chars, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 9 AS VARCHAR) END AS artigo, list_extract(["
    + ", ".join(map(quoted, SOURCES))
    + "], CAST(doc_id % 8 + 1 AS INT)) AS source_type, doc_id % 6 = 0 AS marca_stf, doc_id % 10 = 0 AS marca_stj, CASE WHEN doc_id % 7 = 0 THEN 'FGV' END AS banca, "
    "CASE WHEN doc_id % 3 <> 0 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INT), '%Y-%m-%d') END AS valid_from, "
    "CASE WHEN doc_id % 5 = 0 THEN strftime(DATE '2022-01-01' + CAST(doc_id % 700 AS INT), '%Y-%m-%d') END AS valid_to, "
    "lang AS language, source AS module, CASE WHEN n_chars > 2000 THEN 'core' ELSE 'utils' END AS layer FROM documents)"
)


def described(spark, d):
    """documents with a struct column meta."""
    i = F.col("doc_id")
    day = lambda since, n: F.date_format(F.date_add(F.lit(since).cast("date"), (i % n).cast("int")), "yyyy-MM-dd")
    meta = F.struct(
        F.when(i % 4 == 0, (i % 9).cast("string")).alias("artigo"), F.element_at(F.array(*map(F.lit, SOURCES)), (i % 8 + 1).cast("int")).alias("source_type"), (i % 6 == 0).alias("marca_stf"),
        (i % 10 == 0).alias("marca_stj"), F.when(i % 7 == 0, "FGV").alias("banca"), F.when(i % 3 != 0, day("2020-01-01", 900)).alias("valid_from"), F.when(i % 5 == 0, day("2022-01-01", 700)).alias("valid_to"),
        F.col("lang").alias("language"), F.col("source").alias("module"), F.when(F.col("n_chars") > 2000, "core").otherwise("utils").alias("layer"),
    )
    return t(spark, d, "documents").withColumn("meta", meta)


def counted(df, where):
    return df.where(where).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def _count_sql(where: str) -> str:
    return f"WITH {MD} SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM md WHERE {where}"


@query(_count_sql("source_type = 'lei_cf' AND banca IS NULL AND artigo IS NOT NULL"))
def metadata_filter(spark, d):
    """FLT1, FLT13: equality, is_null and not_null."""
    df = described(spark, d)
    return counted(df, flt.condition({"source_type": "lei_cf", "banca": "is_null", "artigo": "not_null"}, df))


@query(_count_sql("language = 'en' AND ((marca_stf AND artigo IS NOT NULL) OR banca = 'FGV')"))
def metadata_filter_or(spark, d):
    """FLT2: one of several groups, and the other keys."""
    df = described(spark, d)
    return counted(df, flt.condition({"language": "en", "__or__": [{"marca_stf": True, "artigo": "not_null"}, {"banca": "FGV"}]}, df))


#: Metadata of documents as JSON; that of every thirteenth is broken.
_JSON = (
    "CASE WHEN doc_id % 13 = 0 THEN '{\"lang\": ' ELSE '{\"lang\":\"' || lang || '\",\"at\":{\"source\":\"' || source || '\",\"even\":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '},\"tags\":[\"t' || doc_id % 5 || '\",{\"n\":' || doc_id % 3 || ',\"m\":null}],\"size\":' || n_chars % 4 || '.5}' END"
)
#: Filters, and what they mean for the columns.
WANTED = [
    ({"at": {"source": "src0", "even": True}}, "source = 'src0' AND doc_id % 2 = 0"), ({"tags": ["t3"]}, "doc_id % 5 = 3"), ({"tags": [{"n": 2}]}, "doc_id % 3 = 2"),
    ({"tags": [{"m": None, "n": 1}, "t0"], "lang": "en"}, "doc_id % 3 = 1 AND doc_id % 5 = 0 AND lang = 'en'"), ({"size": 2.5}, "n_chars % 4 = 2"), ({"size": "2.5"}, "false"), ({"lang": ["en"]}, "false"), ({}, "true"),
    ({"tags": []}, "true"), ({"tags": {}}, "false"), ({"at": {"even": 1}}, "false"), ({"at": None}, "false"),
]


def with_json(spark, d):
    return t(spark, d, "documents").select("doc_id", F.expr(_JSON).alias("metadata"))


@query("SELECT k AS filter, count(*) FILTER (held AND doc_id % 13 <> 0) AS n, count(*) FILTER (doc_id % 13 = 0) AS broken FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, doc_id, {c} AS held FROM documents" for k, (_, c) in enumerate(WANTED)) + ") GROUP BY k")
def json_containment(spark, d):
    """FLT12, FLT13: how many documents hold each filter, and how many have broken JSON, which are passed over."""
    rows = with_json(spark, d).withColumn("v", containment.parsed(F.col("metadata")))
    broken = F.count_if(F.col("metadata").isNotNull() & F.col("v").isNull()).alias("broken")
    counts = rows.agg(broken, *[F.count_if(containment.holds(F.col("v"), wanted)).alias(f"n{k}") for k, (wanted, _) in enumerate(WANTED)])
    each = F.array(*[F.struct(F.lit(k).alias("filter"), F.col(f"n{k}").alias("n")) for k in range(len(WANTED))])
    return counts.select(F.explode(each).alias("x"), "broken").select("x.filter", "x.n", "broken")


_MATCH = f"SELECT {{0}} AS call, b.vec_id AS chunk_id, b.vec_id % 7 AS document_id, round({COS}, 6) AS similarity FROM embeddings a, embeddings b JOIN documents ON doc_id = b.vec_id WHERE a.vec_id = 0 AND doc_id % 13 <> 0 AND {{1}} AND {COS} >= {{2}} ORDER BY {COS} DESC, b.vec_id LIMIT {{3}}"
CALLS = [("""'{"at":{"even":true}}'""", "NULL", "doc_id % 2 = 0", -1.0, 9), ("""'{"tags":[{"n":1}],"lang":"en"}'""", "3", "doc_id % 3 = 1 AND lang = 'en' AND b.vec_id % 7 = 3", 0.0, 5), ("'{}'", "2", "b.vec_id % 7 = 2", 0.2, 50)]


@query(" UNION ALL ".join(f"(SELECT * FROM ({_MATCH.format(k, c, least, most)}))" for k, (_, _, c, least, most) in enumerate(CALLS)))
def match_chunks(spark, d):
    """SRC11: the table function in SQL: with a filter, with a filter and a document, with a document and a least similarity."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 7).alias("document_id"), "embedding")
    sql_search.register(v.join(with_json(spark, d).withColumnRenamed("doc_id", "chunk_id"), "chunk_id"))
    (asked,) = t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    vector = f"array({', '.join(f'{x!r}D' for x in asked)})"
    calls = [f"SELECT {k} AS call, chunk_id, document_id, round(similarity, 6) AS similarity FROM match_chunks({vector}, {most}, {least}D, {wanted}, {document})" for k, (wanted, document, _, least, most) in enumerate(CALLS)]
    return spark.sql(" UNION ALL ".join(calls))


@query(_count_sql("valid_from >= '2020-06-01' AND valid_from <= '2021-12-31' AND valid_to >= '2022-03-01'"))
def temporal_range(spark, d):
    """FLT3: a range that isn't text is ignored."""
    df = described(spark, d)
    return counted(df, flt.condition({"valid_from_gte": "2020-06-01", "valid_from_lte": "2021-12-31", "valid_to_gte": "2022-03-01", "valid_to_lte": 5}, df))


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b JOIN documents ON doc_id = b.vec_id WHERE a.{ASKED} AND source = 'src0' AND {COS} >= 0.1 QUALIFY rank <= 3")
def vector_topk_of_document(spark, d):
    """FLT4, SRC11: only vectors of one source's documents, of a least similarity."""
    v = t(spark, d, "embeddings")
    own = t(spark, d, "documents").where("source = 'src0'").select(F.col("doc_id").alias("vec_id"))
    return vector.top_k(v.join(own, "vec_id", "left_semi"), v.where(ASKED), 3, 0.1)


_KINDS_SQL = {
    "artigo": "artigo IS NOT NULL", "jurisprudencia": "source_type IN ('jurisprudencia', 'jurisprudence') OR marca_stf OR marca_stj", "questao": "source_type IN ('questao_prova', 'exam_question') OR banca IS NOT NULL",
    "lei": "source_type = 'lei_cf'", "ec": "source_type = 'emenda_constitucional'", "comentario": "source_type IN ('comentario', 'commentary')", "nota": "true", "todos": "true", " LEI ": "source_type = 'lei_cf'", "other": "true",
}


@query(f"WITH {MD} SELECT kind, n FROM (SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {quoted(k)[1:-1].join(chr(34) * 2)}" for k, c in _KINDS_SQL.items()) + " FROM md) UNPIVOT (n FOR kind IN (" + ", ".join(f'"{k}"' for k in _KINDS_SQL) + "))")
def kind_routing(spark, d):
    """FLT6: how many documents each kind of question looks at, in one pass."""
    df = described(spark, d)
    g = df.agg(*[F.count_if(flt.condition(flt.by_kind(k), df)).alias(f"n{i}") for i, k in enumerate(_KINDS_SQL)])
    return g.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{i}").alias("n")) for i, k in enumerate(_KINDS_SQL)])))


@query(
    f"WITH r AS (SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r, n_chars // 4 AS tokens "
    f"FROM embeddings a, embeddings b JOIN documents ON doc_id = b.vec_id WHERE a.{ASKED} QUALIFY r <= 10), m AS (SELECT *, max(CASE WHEN tokens < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS short FROM r) "
    "SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS rank, tokens < 100 AS note FROM m WHERE tokens < 100 OR short = 0 QUALIFY rank <= 5"
)
def notes_or_all(spark, d):
    """FLT7: short texts among twice as many hits; without any, the hits."""
    v, docs = t(spark, d, "embeddings"), t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    top = vector.top_k(v.join(docs, "vec_id", "left_semi"), v.where(ASKED), 10)
    return flt.notes_or_all(top.join(docs, "vec_id"), 5).select("query_id", "vec_id", "similarity", "rank", "note")


@query(_count_sql("language = 'en' AND layer = 'core' AND module = 'src0'"))
def code_filter(spark, d):
    """FLT8."""
    df = described(spark, d)
    return counted(df, flt.condition(flt.for_code("en", "core", "src0"), df))


@query(_count_sql("artigo IS NOT NULL AND (banca IS NULL OR source_type = 'lei_cf') AND language <> 'de'"))
def translated_filter(spark, d):
    """FLT11: comparisons $eq and $ne, groups $or."""
    df = described(spark, d)
    return counted(df, flt.condition({"artigo": {"$ne": None}, "$or": [{"banca": {"$eq": None}}, {"source_type": "lei_cf"}], "language": {"$ne": "de"}}, df))


ASKS = [
    (1, "Art. 5-a da Lei nº 8.112/90 segundo o STF"), (2, "art 37 caput e inciso"), (3, "sumula do superior tribunal de justica"), (4, "questao de concurso da lei 14.133"), (5, "manual de doutrina"),
    (6, "o que diz o comentario"), (7, ""), (8, "lei n. 9099/1995 e artigo 12"), (9, "nada disso"), (10, "acordao do stj sobre art. 7"),
]
_A = f"(SELECT query_id, {FOLD.format('text')} AS q FROM {values(ASKS, 'query_id', 'text')} UNION ALL SELECT 1000 + item_id, {FOLD.format('text')} FROM benchmark)"
_HAS = lambda *words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
_KIND = lambda at: "CASE " + " ".join(f"WHEN {_HAS(*x[0])} THEN '{x[at]}'" for x in tx.QUERY_KINDS) + " END"
_FILTERS = {
    "artigo": f"upper(nullif(regexp_extract(q, {quoted(tx.QUERY_ARTICLE.sql)}, 1), ''))",
    "law_number": f"nullif(concat_ws('/', nullif(replace(regexp_extract(q, {quoted(tx.QUERY_LAW.sql)}, 1), '.', ''), ''), nullif(regexp_extract(q, {quoted(tx.QUERY_LAW.sql)}, 2), '')), '')",
    "marca_stf": f"CASE WHEN {_HAS('stf', 'supremo tribunal federal')} THEN 'true' END", "marca_stj": f"CASE WHEN {_HAS('stj', 'superior tribunal de justica')} THEN 'true' END",
    "content_type": _KIND(1), "source_type": _KIND(2), "is_exam_focus": f"CASE WHEN {_KIND(1)} = 'exam_question' THEN 'true' END",
}


def asked(spark, d):
    """Queries with legal references, and the benchmark's texts."""
    b = t(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), "text")
    return fixture(spark, ASKS, "query_id long, text string").unionByName(b).select("query_id", tx.fold(F.col("text")).alias("q"))


@query(f"SELECT query_id, {', '.join(f'{c} AS {k}' for k, c in _FILTERS.items())} FROM {_A}")
def extracted_filters(spark, d):
    """FLT10."""
    return asked(spark, d).select("query_id", tx.query_filters(F.col("q")).alias("f")).select("query_id", *[F.element_at("f", k).alias(k) for k in _FILTERS])


@query(f"SELECT query_id, CASE WHEN query_id % 3 = 0 THEN '99' ELSE {_FILTERS['artigo']} END AS artigo, CASE WHEN query_id % 2 = 0 THEN 'x/1' ELSE {_FILTERS['law_number']} END AS law_number, {_FILTERS['source_type']} AS source_type FROM {_A}")
def merged_filters(spark, d):
    """FLT9: filters that a request names win over those of its text."""
    i = F.col("query_id")
    said = F.map_filter(F.create_map(F.lit("artigo"), F.when(i % 3 == 0, "99"), F.lit("law_number"), F.when(i % 2 == 0, "x/1")), lambda k, v: v.isNotNull())
    f = asked(spark, d).select("query_id", flt.merged_maps(said, tx.query_filters(F.col("q"))).alias("f"))
    return f.select("query_id", *[F.element_at("f", k).alias(k) for k in ("artigo", "law_number", "source_type")])


@query("SELECT role AS kind, lower(role) IN ('artigo', 'jurisprudencia', 'questao', 'nota', 'todos') AS allowed, count(*) AS n FROM (SELECT role FROM conversations UNION ALL SELECT unnest(['Artigo', 'NOTA', 'todos', 'lei', ''])) GROUP BY ALL")
def allowed_kinds(spark, d):
    """FLT14."""
    rows = t(spark, d, "conversations").select("role").unionByName(fixture(spark, [(x,) for x in ("Artigo", "NOTA", "todos", "lei", "")], "role string"))
    return rows.groupBy(F.col("role").alias("kind"), flt.allowed_kind(F.col("role")).alias("allowed")).agg(F.count("*").alias("n"))


@query(
    "WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source END AS documento, CASE WHEN doc_id % 3 = 0 THEN ' ' || source || ' ' END AS fonte, CASE WHEN doc_id % 2 = 0 THEN lang END AS nome, CASE WHEN doc_id % 5 = 0 THEN '12' END AS article, "
    "list_extract(['Jurisprudencia', 'questao', 'doutrina', 'legal_text', 'comentario'], CAST(doc_id % 5 + 1 AS INT)) AS c, list_extract(['lei', ' Lei_CF88', 'QUESTAO', 'commentary'], CAST(doc_id % 4 + 1 AS INT)) AS s FROM documents) "
    "SELECT coalesce(documento, nullif(trim(fonte), ''), nullif(trim(nome), ''), 'Documento Desconhecido') AS documento, article AS artigo, "
    "CASE lower(trim(c)) WHEN 'jurisprudencia' THEN 'jurisprudence' WHEN 'questao' THEN 'exam_question' WHEN 'doutrina' THEN 'doctrine' WHEN 'comentario' THEN 'doctrine' ELSE lower(trim(c)) END AS content_type, "
    "CASE lower(trim(s)) WHEN 'lei' THEN 'lei_cf' WHEN 'lei_cf88' THEN 'lei_cf' WHEN 'questao' THEN 'exam_question' ELSE lower(trim(s)) END AS source_type, count(*) AS n FROM x GROUP BY ALL"
)
def canonical_metadata(spark, d):
    """PRJ1: older names of the document, of content and of source."""
    i, one = F.col("doc_id"), lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % len(x) + 1).cast("int"))
    m = {"documento": F.when(i % 4 == 0, F.col("source")), "fonte": F.when(i % 3 == 0, F.concat(F.lit(" "), "source", F.lit(" "))), "nome": F.when(i % 2 == 0, F.col("lang")), "article": F.when(i % 5 == 0, "12"),
         "content_type": one("Jurisprudencia", "questao", "doutrina", "legal_text", "comentario"), "source_type": one("lei", " Lei_CF88", "QUESTAO", "commentary")}
    c = t(spark, d, "documents").select(flt.canonical(F.create_map(*[y for k, v in m.items() for y in (F.lit(k), v)])).alias("m")).select("m.*")
    return c.groupBy(*c.columns).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT source, count(*) AS chunks, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY source) SELECT *, sum(chunks) OVER ()::BIGINT AS all_chunks, sum(tokens) OVER ()::BIGINT AS all_tokens, count(*) OVER () AS documents FROM g QUALIFY row_number() OVER (ORDER BY source) <= 15")
def document_listing(spark, d):
    """PRJ2: the first fifteen documents by name, with the totals of all."""
    g = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.floor(F.col("n_chars") / 4)).alias("tokens"))
    total = g.agg(F.sum("chunks").alias("all_chunks"), F.sum("tokens").alias("all_tokens"), F.count("*").alias("documents"))
    return g.orderBy("source").limit(15).crossJoin(F.broadcast(total))  # one row


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id % 97 = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def point_lookups(spark, d):
    """By id, and the first of each name."""
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t(spark, d, "documents").where("doc_id % 97 = 0").withColumn("r", first).where("r = 1").select("doc_id", "source", "lang", "n_chars")
