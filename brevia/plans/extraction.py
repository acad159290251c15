"""Metadata out of legal texts and of code (E1-E17, EV1, EV3). Inline texts hold what the tables don't."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevia.functions import code, legal
from brevia.operators import evaluation
from brevia.plans.core import fixture, query, quoted, t, values

LEGAL = [
    (-1, "Art. 5-A da Lei nº 8.112/90, § 3º, revogado parcialmente. (STF) #Atenção: pena de multa"),
    (-2, "Parágrafo único. Incluído pela Lei nº 11.340/2006, em vigor desde 07/08/2006\nIV - crime hediondo"),
    (-3, "(CESPE-2013) e (FCC-2010), (CESPE-2013); MPSP-2019-FGV, STF-2001, Art 12. Questão de concurso"),
    (-4, "Súmula 7, Informativo 888 e Info 12 do STJ: homicídio; súmula 7"),
    (-5, "a doutrina ensina; redação dada pela Lei 9.099/1995"), (-6, "EC 45/2004, vetado"), (-7, "§ único\nXIV)\ninciso IX\nMMMMM -"), (-8, "Supremo Tribunal Federal, 1988 e 2005"), (-9, ""), (-10, None),
    (-11, "ação penal pública, crime militar e Lei 8072; corrupção, falsificação"), (-12, "Acórdão TCU: #TCU: Tribunal de Contas da União, publicado em 31/12/1999 e alterada pela Lei 8.666/93"),
    (-13, "comentário do autor, vetado e revogado"), (-14, "Superior Tribunal de Justiça (STJ) TRF4 FUMARC 1999"), (-15, "Art. 10"), (-16, "art 7o e art. 8\nI. um\nII. dois"), (-17, "nada de especial aqui"),
]
BASE = f"t AS (SELECT doc_id, coalesce(text, '') AS x FROM (SELECT doc_id, text FROM {values(LEGAL, 'doc_id', 'text')} UNION ALL SELECT doc_id, text FROM documents))"


def legal_texts(spark, d):
    docs = fixture(spark, LEGAL, "doc_id long, text string").unionByName(t(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("x"))


def _first(p, g=1):
    return f"nullif(regexp_extract(x, {quoted(p.sql)}, {g}), '')"


def _all(p, g=0):
    return f"regexp_extract_all(x, {quoted(p.sql)}, {g})"


def _has(p):
    return f"regexp_matches(x, {quoted(p.sql)})"


_PAR = f"coalesce({_first(legal.PARAGRAPH, 1)}, {_first(legal.PARAGRAPH, 2)})"
_ITEM = f"list_extract(list_filter(list_transform({_all(legal.ITEM, 1)}, lambda r: upper(r)), lambda r: regexp_matches(r, {quoted(legal.ROMAN.sql)})), 1)"
_UPDATED = f"'Lei ' || {_first(legal.UPDATED_BY)}"
_SINCE = f"regexp_replace({_first(legal.DATE)}, '^(\\d\\d)/(\\d\\d)/(\\d{{4}})$', '\\3-\\2-\\1')"


@query(f"WITH {BASE} SELECT doc_id, {_first(legal.ARTICLE)} AS article, CASE WHEN regexp_matches(lower({_PAR}), 'unico|único') THEN 'único' ELSE {_PAR} END AS paragraph, {_ITEM} AS item FROM t")
def legal_references(spark, d):
    """E1, E2, E3."""
    x = F.col("x")
    return legal_texts(spark, d).select("doc_id", legal.article(x).alias("article"), legal.paragraph(x).alias("paragraph"), legal.item(x).alias("item"))


@query(f"WITH {BASE} SELECT doc_id, {', '.join(f'{_has(p)} AS {k}' for k, p in legal.MARKS.items())} FROM t")
def legal_marks(spark, d):
    """E4."""
    return legal_texts(spark, d).select("doc_id", legal.marks(F.col("x")).alias("m")).select("doc_id", "m.*")


@query(f"WITH {BASE} SELECT doc_id, {_first(legal.BOARD)} AS board, list_extract({_all(legal.YEAR, 1)}, -1) AS year FROM t")
def exam_boards(spark, d):
    """E5."""
    return legal_texts(spark, d).select("doc_id", legal.board(F.col("x")).alias("board"), legal.year(F.col("x")).alias("year"))


def _distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_REF = _distinct_in_order(f"list_transform({_all(legal.EXAM_REFERENCE)}, lambda r: regexp_extract(r, {quoted(legal.EXAM_REFERENCE.sql)}, 1) || '|' || regexp_extract(r, {quoted(legal.EXAM_REFERENCE.sql)}, 2))")
_G = lambda k: f"regexp_extract(r, {quoted(legal.EXAM_MARK.sql)}, {k})"
_MARK = _distinct_in_order(f"list_transform(list_filter({_all(legal.EXAM_MARK)}, lambda r: {_G(1)} NOT IN ('STF', 'STJ', 'INFO', 'ART')), lambda r: {_G(1)} || '|' || {_G(2)} || '|' || {_G(3)})")


@query(f"WITH {BASE} SELECT doc_id, array_to_string({_REF}, ',') AS exam_refs, array_to_string({_MARK}, ',') AS exam_marks FROM t")
def exam_references(spark, d):
    """E6."""
    x = F.col("x")
    told = lambda a, *names: F.array_join(F.transform(a, lambda r: F.concat_ws("|", *[F.coalesce(r[n].cast("string"), F.lit("")) for n in names])), ",")
    return legal_texts(spark, d).select("doc_id", told(legal.exam_references(x), "source", "year").alias("exam_refs"), told(legal.exam_marks(x), "exam", "year", "board").alias("exam_marks"))


@query(f"WITH {BASE} SELECT doc_id, {_first(legal.LAW)} AS law, {_UPDATED} AS updated_by, {_SINCE} AS valid_from, array_to_string(list_sort(list_distinct(list_transform({_all(legal.PRECEDENT)}, lambda r: trim(r)))), ',') AS precedents FROM t")
def legal_links(spark, d):
    """E7."""
    x = F.col("x")
    return legal_texts(spark, d).select("doc_id", legal.law_number(x).alias("law"), legal.updated_by(x).alias("updated_by"), legal.valid_from(x).alias("valid_from"), F.array_join(legal.precedents(x), ",").alias("precedents"))


_EXAM = f"({_has(legal.MARKS['exam'])} OR {_has(legal.EXAM_REFERENCE)} OR len({_MARK}) > 0)"
_KIND = f"CASE WHEN {_EXAM} THEN 'exam_question' WHEN {_has(legal.MARKS['stf'])} OR {_has(legal.MARKS['stj'])} OR {_has(legal.PRECEDENT)} THEN 'jurisprudence' WHEN " + " OR ".join(f"contains(lower(x), {quoted(w)})" for w in legal.DOCTRINE) + " THEN 'doctrine' ELSE 'legal_text' END"
_SOURCE = f"CASE {_KIND} WHEN 'doctrine' THEN 'commentary' WHEN 'legal_text' THEN CASE WHEN regexp_matches(lower(x), {quoted(legal.AMENDMENT_NUMBER.sql)}) THEN 'emenda_constitucional' ELSE 'lei_cf' END ELSE {_KIND} END"


@query(f"WITH {BASE} SELECT doc_id, {_KIND} AS content_type, {_SOURCE} AS source_type FROM t")
def content_types(spark, d):
    """E8."""
    rows = legal_texts(spark, d).withColumn("content_type", legal.content_type(F.col("x")))
    return rows.select("doc_id", "content_type", legal.source_type(F.col("x"), F.col("content_type")).alias("source_type"))


_LOW = lambda w: f"contains(lower(x), '{w}')"
_SCOPE = lambda w: f"CASE WHEN {_LOW(w)} AND {_LOW('parcial')} THEN 'partial' WHEN {_LOW(w)} THEN 'total' ELSE 'none' END"


@query(
    f"WITH {BASE} SELECT doc_id, {_LOW('revogad')} AS is_revoked, {_LOW('vetad')} AS is_vetoed, {_SCOPE('revogad')} AS revocation_scope, {_SCOPE('vetad')} AS veto_scope, "
    f"CASE WHEN {_SINCE} IS NOT NULL AND {_UPDATED} IS NOT NULL THEN 0.9 WHEN {_SINCE} IS NOT NULL OR {_UPDATED} IS NOT NULL THEN 0.6 WHEN {_LOW('revogad')} OR {_LOW('vetad')} THEN 0.4 ELSE 0.1 END::DOUBLE AS temporal_confidence, "
    f"coalesce('pos_lei_' || replace(replace({_UPDATED}, '.', ''), '/', '_'), 'current') AS version FROM t"
)
def temporal_status(spark, d):
    """E9."""
    return legal_texts(spark, d).select("doc_id", legal.status(F.col("x")).alias("s")).select("doc_id", "s.*")


@query(f"WITH {BASE} SELECT doc_id, {_first(legal.ARTICLE)} AS article, {_first(legal.LAW)} AS law, {_KIND} AS content_type, {_SOURCE} AS source_type, {_has(legal.MARKS['stf'])} AS stf, {_has(legal.MARKS['exam'])} OR len({_REF}) > 0 AS is_exam_focus, {_LOW('vetad')} AS is_vetoed FROM t")
def legal_metadata(spark, d):
    """The whole record; some of its fields."""
    m = legal.described(legal_texts(spark, d), "x")
    return m.select("doc_id", F.col("meta.artigo").alias("article"), F.col("meta.law_number").alias("law"), "meta.content_type", "meta.source_type", F.col("meta.marca_stf").alias("stf"), "meta.is_exam_focus", "meta.is_vetoed")


#: The record's fields that retrieval asks for.
RECORD = (
    f"md AS (SELECT doc_id, x, 'Lei' AS documento, {_first(legal.ARTICLE)} AS artigo, CASE WHEN regexp_matches(lower({_PAR}), 'unico|único') THEN 'único' ELSE {_PAR} END AS paragrafo, {_ITEM} AS inciso, CAST(NULL AS VARCHAR) AS titulo, CAST(NULL AS VARCHAR) AS capitulo, "
    f"{_has(legal.MARKS['stf'])} AS marca_stf, {_has(legal.MARKS['stj'])} AS marca_stj, {_first(legal.BOARD)} AS banca, list_extract({_all(legal.YEAR, 1)}, -1) AS ano, {_UPDATED} AS updated_by_law, {_SINCE} AS valid_from, {_LOW('revogad')} AS is_revoked, {_LOW('vetad')} AS is_vetoed, {_SOURCE} AS source_type, {_KIND} AS content_type FROM t)"
)


def recorded(spark, d):
    """Texts with their extracted records."""
    return legal.described(legal_texts(spark, d), "x", documento=F.lit("Lei"))


SEGMENTS = [
    (1, "Emenda Constitucional nº 45"), (2, "Redação dada pela EC nº 20\nOBS: veja"), (3, "Ato das Disposições Constitucionais Transitórias"), (4, "STF. Info 888 e Súmula Vinculante 11"), (5, "HC 123 no STJ; embargos de declaração"),
    (6, "MPSP - 2019: Correto"), (7, "(FCC, 2010) .mark"), (8, "OBS: lembrar"), (9, "texto\nDICA. leia"), (10, "Art. 5º. Todos são iguais"), (11, "  "), (12, "BL art. 37"), (13, "Enunciado 7; STJ diz"), (14, "o stf disse, sem maiúsculas"),
]
_SEG = f"s AS (SELECT id, trim(text) AS x FROM (SELECT id, text FROM {values(SEGMENTS, 'id', 'text')} UNION ALL SELECT 1000 + doc_id, text FROM documents))"
_ANY = lambda name: "(" + " OR ".join(_has(p) for p in legal.SEGMENTS[name]) + ")"
_SEGKIND = "CASE " + " ".join(f"WHEN {_ANY(k)} THEN '{k}'" for k in legal.SEGMENTS) + " ELSE 'lei_cf' END"


@query(
    f"WITH {_SEG}, k AS (SELECT *, {_SEGKIND} AS source_type FROM s) SELECT id, source_type, source_type = 'jurisprudencia' AND regexp_matches(x, '\\bSTF\\b') AS stf, source_type = 'jurisprudencia' AND regexp_matches(x, '\\bSTJ\\b') AS stj, "
    f"source_type = 'questao_prova' AS exam, source_type IN ('emenda_constitucional', 'adct', 'comentario') AND {_ANY('comentario')} AS attention FROM k"
)
def segment_kinds(spark, d):
    """E11."""
    rows = fixture(spark, SEGMENTS, "id long, text string").unionByName(t(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))
    return rows.select("id", legal.segment(F.col("text")).alias("s")).select("id", "s.*")


LINES = [
    (1, "TÍTULO IV Da organização"), (2, "Capítulo 2"), (3, "SEÇÃO III"), (4, "Subseção I"), (5, "Art. 12-B. Texto"), (6, "§ 2º texto"), (7, "Parágrafo único. texto"), (8, "XIV - texto"), (9, "nota de rodapé: x"), (10, "N.B.: y"),
    (11, "foi revogado em 1990"), (12, "texto simples"), (13, "  inciso ix)"), (14, ""), (15, "redação dada pela lei"), (16, "§§ 3 e 4"),
]
_LV = lambda name, p: f"upper({_first(p)})" if name == "inciso" else f"coalesce({_first(p, 1)}, {_first(p, 2)})" if name == "paragrafo" else "NULL" if name in ("nota", "revogacao") else _first(p)
_CASE = lambda f, end: "CASE " + " ".join(f"WHEN {_has(p)} THEN {f(n, p, k)}" for n, p, k in legal.LINES) + f" ELSE {end} END"
_LINES = f"l AS (SELECT id, text AS x FROM {values(LINES, 'id', 'text')} UNION ALL SELECT 1000 + doc_id, string_split(text, chr(10))[1] FROM documents)"


@query(f"WITH {_LINES} SELECT id, {_CASE(lambda n, p, k: quoted(n), 'NULL')} AS kind, {_CASE(lambda n, p, k: _LV(n, p), 'NULL')} AS value, CAST({_CASE(lambda n, p, k: k or 0, '0')} AS INT) AS level FROM l")
def line_kinds(spark, d):
    """Of lines, and of the first line of each document."""
    docs = t(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.substring_index("text", "\n", 1).alias("text"))
    return fixture(spark, LINES, "id long, text string").unionByName(docs).select("id", legal.line_kind(F.col("text")).alias("k")).select("id", "k.kind", "k.value", F.coalesce("k.level", F.lit(0)).alias("level"))


STYLES = [("Heading 1", 1), ("heading2", 2), ("Título 3", 3), ("Cabeçalho 9", 9), ("Normal", None), ("Title", None), ("My header 4 x", 4), ("Titulo12", 1), (None, None), ("heading 0", None)]


@query(f"SELECT style, CAST(coalesce(level, 0) AS INT) AS level FROM {values(STYLES, 'style', 'level')}")
def heading_levels(spark, d):
    """E13."""
    return fixture(spark, [(s,) for s, _ in STYLES], "style string").select("style", F.coalesce(legal.heading_level(F.col("style")), F.lit(0)).alias("level"))


CODE = [
    ("src/core/agent.py", "python", "import os, sys as system\nfrom a.b import c\nasync def go(x):\n    pass\nclass Agent(Base):\n    def run(self): pass\n    def go(self): pass\nimport os"),
    ("web/app.ts", "typescript", "import { x } from 'lib/x'\nimport y from \"y\"\nfunction one() {}\nexport const two = (a) => a\nlet three = b => b\nclass View extends Base {}\nclass Plain {\n}"),
    ("cmd/main.go", "go", "import \"fmt\"\nfunc main() {}\nfunc (s *Server) Serve(x int) {}\ntype Server struct {\n}"),
    ("tests/test_a.py", "python", "def test_it():\n    pass"), ("src/rag/__init__.py", "python", "from . import x\nimport numpy as np, pandas as pd  \n"), ("scripts/run.sh", "shell", "def no(): pass"), ("x/latest.py", "python", ""), ("", "python", "x = 1"),
]
_D = lambda kind, lang: code.DECLARATIONS[kind][lang]
_CONCAT = lambda kind, lang: "list_concat(" + ", ".join([_all(p, 1) for p in _D(kind, lang)] + ["[]"]) + ")"
_IMPORTED = (
    f"list_filter(flatten(list_transform({_all(code.PYTHON_IMPORT)}, lambda r: CASE WHEN starts_with(r, 'from') THEN [regexp_extract(r, {quoted(code.PYTHON_IMPORT.sql)}, 1)] "
    f"ELSE list_transform(string_split(regexp_extract(r, {quoted(code.PYTHON_IMPORT.sql)}, 2), ','), lambda m: trim(string_split(trim(m), ' as ')[1])) END)), lambda m: m <> '')"
)
_CODE = f"c AS (SELECT path, language, x FROM {values(CODE, 'path', 'language', 'x')})"


@query(
    f"WITH {_CODE}, f AS (SELECT path, language, x, CASE language WHEN 'python' THEN {_CONCAT('functions', 'python')} WHEN 'typescript' THEN {_CONCAT('functions', 'typescript')} WHEN 'go' THEN {_CONCAT('functions', 'go')} ELSE [] END AS fs, "
    f"CASE language WHEN 'python' THEN {_CONCAT('classes', 'python')} WHEN 'typescript' THEN {_CONCAT('classes', 'typescript')} WHEN 'go' THEN {_CONCAT('classes', 'go')} ELSE [] END AS cs, "
    f"CASE language WHEN 'python' THEN {_IMPORTED} WHEN 'typescript' THEN {_CONCAT('imports', 'typescript')} WHEN 'go' THEN {_CONCAT('imports', 'go')} ELSE [] END AS ims FROM c) "
    f"SELECT path, array_to_string({_distinct_in_order('fs')}, ',') AS functions, array_to_string(cs, ',') AS classes, array_to_string({_distinct_in_order('ims')}, ',') AS imports FROM f"
)
def code_declarations(spark, d):
    """E14."""
    rows, x, lang = fixture(spark, CODE, "path string, language string, x string"), F.col("x"), F.col("language")
    return rows.select("path", *[F.array_join(code.declared(k, x, lang), ",").alias(k) for k in ("functions", "classes", "imports")])


_STEM = "regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]+$', '\\1')"
_PATHS = f"p AS (SELECT path FROM {values(CODE, 'path', 'language', 'x')} UNION ALL SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1) FROM pages)"


@query(
    f"WITH {_PATHS} SELECT path, CASE " + " ".join(f"WHEN regexp_matches(path, {quoted(p)}) THEN '{k}'" for k, p in code.LAYERS.items()) + f" ELSE 'unknown' END AS layer, CASE WHEN path = '' THEN 'unknown' WHEN {_STEM} = '__init__' "
    f"AND coalesce(list_extract(string_split(path, '/'), -2), '') <> '' THEN list_extract(string_split(path, '/'), -2) ELSE {_STEM} END AS module, regexp_matches(lower(path), 'tests?[/\\\\]') OR contains(lower({_STEM}), 'test') AS is_test FROM p"
)
def code_places(spark, d):
    """E15."""
    urls = t(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/?#]*(/[^?#]*)?", 1).alias("path")).distinct()
    p = fixture(spark, [(x[0],) for x in CODE], "path string").unionByName(urls)
    return p.select("path", code.layer(F.col("path")).alias("layer"), code.module(F.col("path")).alias("module"), code.is_test(F.col("path")).alias("is_test"))


@query(f"WITH {_SEG} SELECT id, {_has(legal.TRANSITIONAL)} AS transitional, {_has(legal.AMENDMENT)} AS amendment FROM s")
def amendment_texts(spark, d):
    """E17."""
    rows = fixture(spark, SEGMENTS, "id long, text string").unionByName(t(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))
    return rows.select("id", legal.is_transitional(F.col("text")).alias("transitional"), legal.is_amendment(F.col("text")).alias("amendment"))


#: case, kind, question, expected document, article, keywords (|), answer, seconds, timeout, error
ANSWERS = [
    (1, "artigo", "O que diz o art. 5?", "CF/88", "5", "direitos|garantias", "Segundo a CF/88, art. 5, os direitos e garantias...", 0.5, False, False),
    (2, "artigo", "Art. 37?", "CF/88", "37", "princípios", "Não encontrei base na CF/88.", 0.7, False, False), (3, "jurisprudencia", "Posição do STF?", None, None, "tribunais", "O STF decidiu; tribunais seguem.", 1.2, False, False),
    (4, "concurso", "Como a banca cobra?", None, None, "banca|prova", "A banca costuma cobrar.", 0.2, False, False), (5, "geral", "O que é isso?", "Lei 8.112/90", None, "", "É a lei 8.112/90.", 0.1, False, False),
    (6, "geral", "E isso?", None, None, "x", "qualquer", 9.0, True, False), (7, "artigo", "E?", None, "7", "", "artigo 7", -1.0, False, False), (8, "geral", "?", None, None, "", "  ", 0.3, False, True), (9, "geral", "vazio", None, None, "", "", 0.3, False, False),
    (10, "artigo", "Art. 5-A?", None, "5-A", "", "Conforme o art. 5-A da lei.", 0.4, False, False), (11, "artigo", "Art. 10.1?", None, "10.1", "", "Ver artigo 10.1, caput.", 0.4, False, False), (12, "artigo", "Art. 10.1?", None, "10.1", "", "Ver artigo 1001.", 0.4, False, False),
]
_AC = "id, tipo, question, doc, article, keywords, answer, seconds, timeout, error"
#: Benchmark items as questions, and the documents of the same id as answers; every third asks for an article, every sixth gets it.
_GIVEN = (
    "SELECT 1000 + item_id, CASE WHEN item_id % 3 = 0 THEN 'artigo' ELSE 'geral' END, b.text, NULL, CASE WHEN item_id % 3 = 0 THEN item_id || '-A' END, replace(b.text, ' ', '|'), CASE WHEN item_id % 6 = 0 THEN 'Art. ' || item_id || '-A: ' ELSE '' END || d.text, "
    "item_id / 8.0, false, false FROM benchmark b JOIN documents d ON doc_id = item_id"
)
_N = "lower(trim(answer))"
_CITED = f"trim(answer) <> '' AND (doc IS NULL OR contains({_N}, lower(trim(doc)))) AND CASE tipo WHEN 'artigo' THEN article IS NULL OR regexp_matches(answer, '(?i)\\b(?:art\\.?|artigo)\\s*' || regexp_escape(article) || '\\b') WHEN 'jurisprudencia' THEN contains({_N}, 'stf') OR contains({_N}, 'stj') OR contains({_N}, 'tribunal') WHEN 'concurso' THEN contains({_N}, 'banca') OR contains({_N}, 'questão') OR contains({_N}, 'questao') OR contains({_N}, 'concurso') ELSE true END"
_TERMS = "list_concat(list_filter(string_split(keywords, '|'), lambda w: w <> ''), CASE WHEN article IS NULL THEN [] ELSE ['art ' || article] END)"
_COVER = f"CASE WHEN len({_TERMS}) = 0 THEN CASE WHEN {_N} <> '' THEN 1.0 ELSE 0.0 END ELSE len(list_filter({_TERMS}, lambda w: contains({_N}, lower(trim(w))))) / len({_TERMS}) END"
_SIGNAL = " OR ".join(f"contains({_N}, {quoted(p)})" for p in evaluation.NO_BASIS)
_TOKENS = lambda c: f"greatest(1, ceil(length({c}) / 4.0))"


@query(
    f"SELECT id, CASE WHEN timeout OR error OR NOT coalesce({_CITED}, false) THEN 0.0 ELSE 1.0 END::DOUBLE AS citation, round(CASE WHEN timeout OR error THEN 0.0 ELSE {_COVER} END, 6)::DOUBLE AS coverage, CASE WHEN (timeout OR error) THEN 0.0 WHEN {_SIGNAL} THEN 1.0 ELSE 0.0 END::DOUBLE AS no_basis, "
    f"round(CASE WHEN timeout OR error THEN 0.0 ELSE ({_TOKENS('question')} + 100) / 1000 * 0.00015 + {_TOKENS('answer')} / 1000 * 0.0006 END, 9)::DOUBLE AS cost_usd, greatest(seconds, 0)::DOUBLE AS latency_s FROM (SELECT {_AC} FROM {values(ANSWERS, *_AC.split(', '))} UNION ALL {_GIVEN})"
)
def answer_metrics(spark, d):
    """E16, EV3: signals of an answer without basis, cited articles, covered keywords, cost; all 0 after a timeout or error."""
    schema = "id int, tipo string, question string, doc string, article string, keywords string, answer string, seconds double, timeout boolean, error boolean"
    i = F.col("item_id")
    given = t(spark, d, "benchmark").withColumnRenamed("text", "question").join(t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id").select(
        (i + 1000).cast("int").alias("id"), F.when(i % 3 == 0, "artigo").otherwise("geral").alias("tipo"), "question", F.lit(None).cast("string").alias("doc"), F.when(i % 3 == 0, F.concat(i, F.lit("-A"))).alias("article"),
        F.replace("question", F.lit(" "), F.lit("|")).alias("keywords"), F.concat(F.when(i % 6 == 0, F.concat(F.lit("Art. "), i, F.lit("-A: "))).otherwise(""), "text").alias("answer"),
        (i / 8.0).alias("seconds"), F.lit(False).alias("timeout"), F.lit(False).alias("error"),
    )
    rows = fixture(spark, ANSWERS, schema).unionByName(given)
    return rows.select("id", evaluation.answer_metrics(100).alias("m")).select("id", "m.*")
