"""Chunks of legal documents and of code.

The tables' texts have no legal marks: their lines get some by position, so that blocks and parents are there to be found."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brevia.operators import chunks, packing, vector
from brevia.plans.core import UNITS, fixture, query, quoted, t, values

_LINE = "CASE WHEN l = '' THEN '' WHEN idx % 9 = 0 THEN 'Art. ' || (idx // 9 + 1) || '. ' || l WHEN idx % 9 = 4 THEN '§ ' || idx || ' ' || l WHEN idx % 9 = 6 THEN 'IV - ' || l WHEN idx % 9 = 1 THEN 'e ' || l ELSE l END"
_STYLE = "CASE WHEN idx % 13 = 3 THEN 'Heading 1' WHEN idx % 13 = 7 THEN 'heading 3' ELSE 'Normal' END"
PARAGRAPHS = f"p AS (SELECT doc_id, CAST(idx AS BIGINT) AS idx, {_LINE} AS text, {_STYLE} AS style FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents))"


def paragraphs(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("idx", F.col("i").cast("long"))
    i = F.col("idx")
    text = F.when(F.col("l") == "", "").when(i % 9 == 0, F.concat(F.lit("Art. "), (F.floor(i / 9) + 1).cast("string"), F.lit(". "), "l")).when(i % 9 == 4, F.concat(F.lit("§ "), i.cast("string"), F.lit(" "), "l")).when(i % 9 == 6, F.concat(F.lit("IV - "), "l")).when(i % 9 == 1, F.concat(F.lit("e "), "l")).otherwise(F.col("l"))
    return x.select("doc_id", "idx", text.alias("text"), F.when(i % 13 == 3, "Heading 1").when(i % 13 == 7, "heading 3").otherwise("Normal").alias("style"))


_START = {n: p for n, p in chunks.START}
_M = lambda n, g=1: f"nullif(regexp_extract(text, {quoted(_START[n].sql)}, {g}), '')"
_IS = lambda n: f"regexp_matches(text, {quoted(_START[n].sql)})"
_KIND = "CASE " + " ".join(f"WHEN {_IS(n)} THEN '{n}'" for n in _START) + " ELSE 'content' END"
_VALUE = f"CASE WHEN {_IS('artigo')} THEN {_M('artigo')} WHEN {_IS('paragrafo')} THEN lower(coalesce({_M('paragrafo')}, {_M('paragrafo', 2)})) WHEN {_IS('inciso')} THEN upper({_M('inciso')}) WHEN {_IS('alinea')} THEN lower({_M('alinea')}) END"
MARKS = [(1, "Art. 5A texto"), (2, " § único"), (3, "parágrafo 12 texto"), (4, "XIV) texto"), (5, "a) texto"), (6, "A) b"), (7, "texto"), (8, ""), (9, "Artigo"), (10, "ivx - t"), (11, "§ 3º x")]


@query(f"WITH t AS (SELECT id, text FROM {values(MARKS, 'id', 'text')} UNION ALL SELECT 1000 + doc_id, text FROM documents) SELECT id, {_KIND} AS kind, {_VALUE} AS value FROM t")
def start_marks(spark, d):
    """What a text begins with."""
    rows = fixture(spark, MARKS, "id long, text string").unionByName(t(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))
    return rows.select("id", chunks.start_mark(F.col("text")).alias("m")).select("id", "m.*")


_LEVEL = "CASE WHEN contains(lower(style), 'heading 1') THEN 1 WHEN contains(lower(style), 'heading 3') THEN 3 END"
_BLOCKS = (
    f"{PARAGRAPHS}, k AS (SELECT *, {_KIND} AS kind, {_LEVEL} AS level, {UNITS.format('text')} AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM p WHERE text <> ''), "
    "b AS (SELECT *, sum(CASE WHEN kind IN ('artigo', 'paragrafo', 'inciso') AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS block FROM k)"
)


@query(f"WITH {_BLOCKS} SELECT doc_id, CAST(block AS BIGINT) AS block, min(idx) AS idx, arg_min(kind, idx) AS kind, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM b GROUP BY ALL")
def semantic_blocks(spark, d):
    """C1, C7."""
    return chunks.blocks(paragraphs(spark, d)).select("doc_id", "block", "idx", "kind", "tokens", F.size("p").cast("long").alias("n"))


_TAIL = "list_max(list_filter(range(1, len(tk) + 1), lambda j: list_sum(tk[len(tk) - j + 1:]) <= 50))"
_PACK = (
    f"{_BLOCKS}, o AS (SELECT doc_id, list(idx ORDER BY idx) AS ix, list(tokens ORDER BY idx) AS tk, arg_min({{'x': level}}, idx).x AS level, sum(tokens)::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS rn FROM b GROUP BY doc_id, block), "
    "s AS (SELECT doc_id, 0::BIGINT AS rn, []::BIGINT[] AS ix, []::BIGINT[] AS tk, 0::BIGINT AS n, NULL::BIGINT[] AS done FROM (SELECT DISTINCT doc_id FROM o) UNION ALL "
    "SELECT doc_id, rn, CASE WHEN ends THEN list_concat(six[len(six) - keep + 1:], bix) ELSE list_concat(six, bix) END, CASE WHEN ends THEN list_concat(stk[len(stk) - keep + 1:], btk) ELSE list_concat(stk, btk) END, "
    "CASE WHEN ends THEN list_sum(stk[len(stk) - keep + 1:])::BIGINT + bn ELSE sn + bn END, CASE WHEN ends THEN six END FROM ("
    f"SELECT o.doc_id, o.rn, s.ix AS six, s.tk AS stk, s.n AS sn, o.ix AS bix, o.tk AS btk, o.n AS bn, len(s.ix) > 0 AND s.n >= 100 AND (s.n + o.n > 500 OR coalesce(o.level, 99) <= 2) AS ends, coalesce({_TAIL.replace('tk', 's.tk')}, 1) AS keep FROM s JOIN o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1)), "
    "c AS (SELECT doc_id, rn, done AS ix FROM s WHERE done IS NOT NULL UNION ALL SELECT doc_id, 1000000000, ix FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) = 1), "
    "ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS seq, ix FROM c WHERE len(ix) > 0)"
)


@query(f"WITH RECURSIVE {_PACK} SELECT doc_id || '-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, ix[1] AS first, ix[-1] AS last, CAST(len(ix) AS BIGINT) AS n FROM ch")
def chunk_greedy(spark, d):
    """Blocks packed into chunks that repeat the end of the one before."""
    b = chunks.blocks(paragraphs(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "tokens", "level", "p"))).alias("b"))
    c = b.select("doc_id", F.posexplode(chunks.packed(F.col("b"))).alias("seq", "c"))
    return c.select(chunks.chunk_id(F.col("doc_id").cast("string"), F.col("seq")).alias("chunk_id"), F.col("c")[0]["idx"].alias("first"), F.element_at("c", -1)["idx"].alias("last"), F.size("c").cast("long").alias("n"))


_LAST = lambda x: f"last_value({x} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CONTEXT = (
    f"{PARAGRAPHS}, k AS (SELECT *, {_KIND} AS kind, {_VALUE} AS value, {_LEVEL} AS level FROM p), x AS (SELECT doc_id, idx, kind, value, text, "
    + ", ".join(f"{_LAST(f'CASE WHEN level = {n} AND text <> {chr(39) * 2} THEN text END')} AS {c}" for n, c in ((1, "titulo"), (2, "capitulo"), (3, "secao")))
    + ", " + ", ".join(f"{_LAST(f'CASE WHEN kind = {quoted(c)} THEN value END')} AS {c}" for c in ("artigo", "paragrafo", "inciso")) + " FROM k)"
)


@query(f"WITH {_CONTEXT} SELECT doc_id, idx, md5(coalesce(titulo, '')) AS titulo, capitulo, md5(coalesce(secao, '')) AS secao, artigo, paragrafo, inciso FROM x")
def heading_context(spark, d):
    """The last headings and marks before each paragraph."""
    c = chunks.in_context(paragraphs(spark, d))
    return c.select("doc_id", "idx", F.md5(F.coalesce("titulo", F.lit(""))).alias("titulo"), "capitulo", F.md5(F.coalesce("secao", F.lit(""))).alias("secao"), "artigo", "paragrafo", "inciso")


_OWN = {
    "artigo": "CASE WHEN kind = 'artigo' THEN value ELSE artigo END", "paragrafo": "CASE WHEN kind = 'paragrafo' THEN value WHEN kind <> 'artigo' THEN paragrafo END",
    "inciso": "CASE WHEN kind = 'inciso' THEN value WHEN kind NOT IN ('artigo', 'paragrafo') THEN inciso END",
}


@query(
    f"WITH RECURSIVE {_PACK}, {_CONTEXT.replace(PARAGRAPHS + ', k AS', 'k2 AS').replace('FROM k)', 'FROM k2)')}, tot AS (SELECT doc_id, count(*) AS total FROM p GROUP BY doc_id) "
    f"SELECT ch.doc_id || '-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, x.kind AS tipo, round((ix[1] + ix[1] + len(ix) - 1) / 2 / total, 4) AS position, "
    f"coalesce(md5(x.titulo), '') || '|' || coalesce(md5(x.secao), '') || '|' || coalesce({_OWN['artigo']}, '') || '|' || coalesce({_OWN['paragrafo']}, '') || '|' || coalesce({_OWN['inciso']}, '') AS path FROM ch JOIN x ON x.doc_id = ch.doc_id AND x.idx = ix[1] JOIN tot ON tot.doc_id = ch.doc_id"
)
def chunk_context(spark, d):
    """Each chunk's position and what stands above its first paragraph."""
    p = paragraphs(spark, d)
    b = chunks.blocks(p).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "tokens", "level", "p"))).alias("b"))
    c = b.select("doc_id", F.posexplode(chunks.packed(F.col("b"))).alias("seq", "c")).select("doc_id", "seq", F.col("c")[0]["idx"].alias("idx"), F.size("c").alias("n"))
    j = c.join(chunks.in_context(p), ["doc_id", "idx"]).join(p.groupBy("doc_id").agg(F.count("*").alias("total")), "doc_id").withColumns(chunks.own_context(F.col("mark.kind"), F.col("mark.value")))
    said = lambda x: F.coalesce(x, F.lit(""))
    path = F.concat_ws("|", said(F.md5("titulo")), said(F.md5("secao")), said(F.col("artigo")), said(F.col("paragrafo")), said(F.col("inciso")))
    return j.select(chunks.chunk_id(F.col("doc_id").cast("string"), F.col("seq")).alias("chunk_id"), "tipo", F.round((F.col("idx") * 2 + F.col("n") - 1) / 2 / F.col("total"), 4).alias("position"), path.alias("path"))


@query(
    f"WITH RECURSIVE {_PACK}, x AS (SELECT ch.doc_id, seq, string_agg(p.text, chr(10) || chr(10) ORDER BY p.idx) AS text FROM (SELECT doc_id, seq, unnest(ix) AS idx FROM ch) ch JOIN p ON p.doc_id = ch.doc_id AND p.idx = ch.idx GROUP BY ch.doc_id, seq) "
    f"SELECT 'Lei_' || doc_id || '-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, md5(text) AS text_md5, {UNITS.format('text')} AS tokens FROM x"
)
def whole_chunker(spark, d):
    """Documents through the whole chunker."""
    names = t(spark, d, "documents").select("doc_id", F.concat(F.lit("Lei "), F.col("doc_id").cast("string")).alias("name"))
    return chunks.chunked(paragraphs(spark, d), names).select("chunk_id", F.md5("text").alias("text_md5"), F.col("tokens").cast("long").alias("tokens"))


NAMES = [("CF/88",), ("Constituição do Estado",), ("Lei 8.112/90",), ("manual\\geral x",)]


@query("SELECT * FROM (VALUES ('CF/88', 300, 'CF-88-0007'), ('Constituição do Estado', 300, 'Constituição_do_Estado-0007'), ('Lei 8.112/90', 500, 'Lei_8.112-90-0007'), ('manual\\geral x', 500, 'manual-geral_x-0007')) n(name, most, chunk_id)")
def document_limits(spark, d):
    """Limits and ids by a document's name."""
    return fixture(spark, NAMES, "name string").select("name", chunks.most_tokens(F.col("name")).alias("most"), chunks.chunk_id(F.col("name"), F.lit(7)).alias("chunk_id"))


_TYPES = "CASE WHEN doc_id % 13 = 0 THEN 'exam_question' ELSE 'legal_text' END"
_CH = (
    f"ch AS (SELECT source AS doc, 'c' || doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, {_TYPES} AS content_type, CASE WHEN doc_id % 7 = 0 THEN 'artigo' ELSE 'content' END AS tipo, "
    "CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id // 9 % 3 AS VARCHAR) END AS artigo, CASE WHEN doc_id % 3 <> 0 THEN 'I' END AS inciso FROM documents)"
)


def chunk_rows(spark, d):
    i = F.col("doc_id")
    seq = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    c = t(spark, d, "documents").select("doc_id", F.col("source").alias("doc"), seq.alias("seq"))
    return c.select(F.col("doc").alias("doc_id"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), "seq", F.when(i % 13 == 0, "exam_question").otherwise("legal_text").alias("content_type"), F.when(i % 7 == 0, "artigo").otherwise("content").alias("tipo"), F.when(i % 4 != 0, (F.floor(i / 9) % 3).cast("string")).alias("artigo"), F.when(i % 3 != 0, "I").alias("inciso"))


_PARENT = (
    f"{_CH}, f AS (SELECT *, content_type <> 'exam_question' AND coalesce(tipo = 'artigo' OR (artigo IS NOT NULL AND inciso IS NULL), false) AS is_parent FROM ch), "
    "g AS (SELECT *, last_value(CASE WHEN is_parent THEN {'id': chunk_id, 'a': artigo} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM f), "
    "h AS (SELECT doc, seq, chunk_id, is_parent, CASE WHEN content_type <> 'exam_question' AND NOT is_parent AND artigo IS NOT NULL AND l IS NOT NULL AND (l.a IS NULL OR l.a = artigo) THEN l.id END AS parent_id FROM g)"
)


@query(f"WITH {_PARENT} SELECT chunk_id, is_parent, parent_id FROM h")
def chunk_parents(spark, d):
    """C5, W5."""
    return chunks.with_parents(chunk_rows(spark, d)).select("chunk_id", "is_parent", "parent_id")


@query(f"WITH {_PARENT} SELECT parent_id AS chunk_id, string_agg(chunk_id, ',' ORDER BY seq) AS child_chunk_ids FROM h WHERE parent_id IS NOT NULL GROUP BY doc, parent_id")
def chunk_children(spark, d):
    """C5."""
    return chunks.children(chunks.with_parents(chunk_rows(spark, d))).select("chunk_id", F.array_join("child_chunk_ids", ",").alias("child_chunk_ids"))


@query(
    "WITH c AS (SELECT lang AS doc, doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 5 END AS parent, CASE WHEN doc_id % 6 = 0 THEN 'Exam_Question' END AS ct, CASE WHEN doc_id % 7 = 0 THEN 'emenda_constitucional' END AS st, CASE WHEN doc_id % 11 = 0 THEN 'Lei 1' END AS u FROM documents) "
    "SELECT c.parent, c.id AS child, CASE WHEN lower(coalesce(ct, '')) = 'exam_question' THEN 'charged_in' WHEN st IS NOT NULL OR u IS NOT NULL THEN 'updates' ELSE 'interprets' END AS link_type FROM c JOIN (SELECT DISTINCT doc, id FROM c) p ON p.doc = c.doc AND p.id = c.parent"
)
def parent_links(spark, d):
    """Links between chunks and their parents in the same document."""
    i = F.col("doc_id")
    c = t(spark, d, "documents").select(F.col("lang").alias("doc_id"), i.alias("chunk_id"), F.when(i % 5 != 0, i - i % 5).alias("parent_chunk_id"), F.when(i % 6 == 0, "Exam_Question").alias("content_type"), F.when(i % 7 == 0, "emenda_constitucional").alias("source_type"), F.when(i % 11 == 0, "Lei 1").alias("updated_by_law"))
    return chunks.parent_links(c)


_NB = "CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in chunks.NEIGHBOURS.items()) + " END"


@query(
    "WITH c AS (SELECT lang AS doc, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, list_extract(['lei_cf', 'jurisprudencia', 'other', 'comentario', 'lei_cf', 'questao_prova'], CAST(doc_id % 6 + 1 AS INT)) AS source_type, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 2 AS VARCHAR) END AS artigo FROM documents) "
    f"SELECT a.id AS chunk, b.id AS linked, {_NB.replace('source_type', 'b.source_type')} AS link_type FROM c a JOIN c b ON a.doc = b.doc AND abs(a.pos - b.pos) <= 5 WHERE a.source_type = 'lei_cf' AND b.source_type IN ('jurisprudencia', 'questao_prova', 'comentario') AND (a.artigo IS NULL OR b.artigo IS NULL OR a.artigo = b.artigo)"
)
def neighbor_links(spark, d):
    """A band join by bins of positions."""
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("lei_cf", "jurisprudencia", "other", "comentario", "lei_cf", "questao_prova")))
    c = t(spark, d, "documents").select(F.col("lang").alias("doc_id"), i.alias("chunk_id"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("pos"), F.element_at(kinds, (i % 6 + 1).cast("int")).alias("source_type"), F.when(i % 3 != 0, (i % 2).cast("string")).alias("artigo"))
    return chunks.neighbour_links(c)


@query(
    f"WITH {PARAGRAPHS}, k AS (SELECT doc_id, idx, text, CASE WHEN regexp_matches(text, '^Art\\. ') THEN 'artigo' WHEN starts_with(text, '§ ') THEN 'paragrafo' WHEN starts_with(text, 'IV - ') THEN 'inciso' END AS kind FROM (SELECT * FROM p WHERE idx < 100000)), "
    "w AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY idx) AS was, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS said FROM k) SELECT doc_id, idx, was AS continues FROM w WHERE text <> '' AND kind IS NULL AND was IS NOT NULL AND (regexp_matches(rtrim(said), '[,;:]$') OR regexp_matches(text, '^\\p{Ll}'))"
)
def continued_lines(spark, d):
    """Lines that go on with the article, paragraph or item of the line before."""
    return chunks.continuations(paragraphs(spark, d)).where("continues IS NOT NULL").select("doc_id", "idx", "continues")


@query("SELECT doc_id, CASE WHEN n > 1 THEN round((seq - 1) / (n - 1), 4) ELSE 0.0 END::DOUBLE AS position, round(least(seq * 0.01, 1.0), 4)::DOUBLE AS early FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def code_positions(spark, d):
    """Positions of chunks of code, and those of the first pass."""
    of = Window.partitionBy("source")
    c = t(spark, d, "documents").select("doc_id", F.row_number().over(of.orderBy("doc_id")).alias("seq"), F.count("*").over(of).alias("n"))
    return c.select("doc_id", F.when(F.col("n") > 1, F.round((F.col("seq") - 1) / (F.col("n") - 1), 4)).otherwise(0.0).alias("position"), F.round(F.least(F.col("seq") * 0.01, F.lit(1.0)), 4).alias("early"))


_CODE = (
    "f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'typescript' END AS lang, text FROM documents), "
    f"l AS (SELECT doc_id, lang, idx, CASE WHEN idx % 6 = 5 THEN CASE WHEN lang = 'python' THEN 'def f(): ' ELSE 'export function f() ' END || x ELSE x END AS line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM f)), "
    f"o AS (SELECT *, {UNITS.format('line')} AS n, CASE WHEN lang = 'python' THEN regexp_matches(trim(line), '^(?:async\\s+def|def|class)\\s+\\w+') ELSE regexp_matches(trim(line), '^(?:export\\s+)?(?:async\\s+)?(?:function|class)\\s+\\w+|^\\w+\\s*=\\s*(?:async\\s*)?\\(') END AS starts FROM l), "
    f"big AS (SELECT doc_id FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS whole FROM l GROUP BY doc_id) WHERE trim(whole) <> '' AND {UNITS.format('whole')} > 300)"
)


@query(
    f"WITH RECURSIVE {_CODE}, s AS (SELECT doc_id, idx, 1::BIGINT AS first, n AS tokens, NULL::BIGINT AS done FROM o SEMI JOIN big USING (doc_id) WHERE idx = 1 UNION ALL SELECT doc_id, idx, CASE WHEN ends THEN idx ELSE first END, CASE WHEN ends THEN n ELSE tokens + n END, CASE WHEN ends THEN first END FROM ("
    "SELECT o.doc_id, o.idx, o.n, s.first, s.tokens, (o.starts AND s.tokens >= 50) OR s.tokens + o.n > 300 AS ends FROM s JOIN o ON o.doc_id = s.doc_id AND o.idx = s.idx + 1)), "
    "c AS (SELECT doc_id, done AS first, idx - 1 AS last FROM s WHERE done IS NOT NULL UNION ALL SELECT doc_id, first, idx FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) = 1), "
    "w AS (SELECT doc_id, 1 AS first, max(idx) AS last FROM o ANTI JOIN big USING (doc_id) GROUP BY doc_id HAVING trim(string_agg(line, chr(10) ORDER BY idx)) <> '') SELECT doc_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM (SELECT * FROM c UNION ALL SELECT * FROM w)"
)
def code_chunking(spark, d):
    """Documents read as source files, with a declaration in every sixth line."""
    lang = F.when(F.col("doc_id") % 2 == 0, "python").otherwise("typescript")
    begin = F.when(lang == "python", "def f(): ").otherwise("export function f() ")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 4, F.concat(begin, x)).otherwise(x))
    c = t(spark, d, "documents").select("doc_id", F.explode(chunks.code_chunks(F.array_join(lines, "\n"), lang)).alias("c"))
    return c.select("doc_id", "c.first", "c.last")


#: Texts in order, and for each the place where a request that begins with it ends: the recursion follows these places.
_REQUESTS = (
    "w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS tokens FROM w), "
    "x AS (SELECT doc_id, tokens, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM n WHERE tokens BETWEEN 1 AND {most}), "
    "r(pos, doc_id, tokens, request, used) AS (SELECT pos, doc_id, tokens, pos, tokens FROM x WHERE pos = 0 UNION ALL SELECT x.pos, x.doc_id, x.tokens, CASE WHEN used + x.tokens > {budget} THEN x.pos ELSE request END, CASE WHEN used + x.tokens > {budget} THEN x.tokens ELSE used + x.tokens END FROM r JOIN x ON x.pos = r.pos + 1)"
)


@query(f"WITH RECURSIVE {_REQUESTS.format(most=1000, budget=4000)} SELECT doc_id, tokens, CAST(pos AS BIGINT) AS pos, CAST(request AS BIGINT) AS request FROM r")
def embedding_requests(spark, d):
    """Texts of up to 1,000 words packed into requests of up to 4,000, each closed before the text that would go over."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\t\n\x0b\f\r]+"), lambda w: w != "")
    docs = t(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("tokens")).where("tokens BETWEEN 1 AND 1000")
    return packing.requests(docs, 4_000)


#: Shares of three letters stand for what an embedding service says of a text.
_SHARES = lambda x: "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) / length({x})::DOUBLE" for c in "aet") + "]"


def letter_shares(text):
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.length(text) for c in "aet"])


@query(
    f"WITH RECURSIVE {_REQUESTS.format(most=1000, budget=200000)}, "
    "p AS (SELECT doc_id, i, array_to_string(list_slice(w, i * 900 + 1, i * 900 + 1000), ' ') AS part, least(1000, tokens - i * 900) AS n FROM (SELECT *, unnest(range(0, CAST(ceil((tokens - 100) / 900.0) AS BIGINT))) AS i FROM n WHERE tokens > 1000)), "
    f"v AS (SELECT doc_id, n, {_SHARES('part')} AS v FROM p), s AS (SELECT doc_id, count(*) AS parts, sum(v[1] * n) AS a, sum(v[2] * n) AS e, sum(v[3] * n) AS t FROM v GROUP BY doc_id), "
    f"u AS (SELECT n.doc_id, n.tokens, CAST(CASE WHEN n.tokens = 0 THEN 0 ELSE coalesce(parts, 1) END AS INT) AS parts, request, CASE WHEN n.tokens = 0 THEN [0.0, 0.0, 0.0] WHEN parts IS NOT NULL THEN [a / sqrt(a * a + e * e + t * t), e / sqrt(a * a + e * e + t * t), t / sqrt(a * a + e * e + t * t)] ELSE {_SHARES('text')} END AS v "
    "FROM n LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)) "
    "SELECT doc_id, tokens, parts, CAST(coalesce(request, -1) AS BIGINT) AS request, round(v[1], 6)::DOUBLE AS a, round(v[2], 6)::DOUBLE AS e, round(v[3], 6)::DOUBLE AS t FROM u"
)
def embedded_texts(spark, d):
    """C10 with C8 and C9: all texts with their vectors; those of more than 1,000 words in windows, empty ones zero."""
    out = packing.embedded(t(spark, d, "documents"), letter_shares, 3, most=1000)
    return out.select("doc_id", "tokens", "parts", F.coalesce("request", F.lit(-1)).alias("request"), *[F.round(F.get("vector", F.lit(k)), 6).alias(c) for k, c in enumerate("aet")])


@query("WITH m AS (SELECT label, i - 1 AS pos, sum(embedding[i]::DOUBLE * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1) AS m FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) SELECT label, CAST(pos AS INT) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS value FROM m")
def weighted_centroid(spark, d):
    """Weighted means of vectors, normalised."""
    return vector.centroids(t(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1), "label", "w")


