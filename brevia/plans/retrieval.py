"""Hybrid retrieval (V4, V6-V26, EV1, EV2, EV4, A8): candidates of both kinds, ranking, selection, confidence, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brevia.functions import text as tx
from brevia.operators import evaluation, search, vector
from brevia.operators import filters as flt
from brevia.plans import extraction
from brevia.plans.core import ASKED, COS, FOLD, QUERIES, TERMS, TOK, UNITS, fixture, query, quoted, t, values
from brevia.storage import kept

#: Documents get metadata by rules from their id: the tables hold none.
META = (
    "md AS (SELECT doc_id, text, source AS documento, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 20 AS VARCHAR) END AS artigo, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 4 AS VARCHAR) END AS paragrafo, "
    "CASE WHEN doc_id % 7 = 0 THEN 'IV' END AS inciso, CASE WHEN doc_id % 4 = 0 THEN 'I' END AS titulo, CASE WHEN doc_id % 6 = 0 THEN 'II' END AS capitulo, doc_id % 2 = 0 AS marca_stf, doc_id % 9 = 0 AS marca_stj, "
    "CASE WHEN doc_id % 8 = 0 THEN 'FGV' END AS banca, CASE WHEN doc_id % 8 = 0 THEN '2019' END AS ano, CASE WHEN doc_id % 11 = 0 THEN 'Lei 1' END AS updated_by_law, doc_id % 6 = 0 AS is_revoked, doc_id % 10 = 0 AS is_vetoed FROM documents)"
)


def meta():
    i = F.col("doc_id")
    own = lambda n, value: F.when(i % n == 0, value)
    return F.struct(
        F.col("source").alias("documento"), own(3, (i % 20).cast("string")).alias("artigo"), own(5, (i % 4).cast("string")).alias("paragrafo"), own(7, F.lit("IV")).alias("inciso"), own(4, F.lit("I")).alias("titulo"),
        own(6, F.lit("II")).alias("capitulo"), (i % 2 == 0).alias("marca_stf"), (i % 9 == 0).alias("marca_stj"), own(8, F.lit("FGV")).alias("banca"), own(8, F.lit("2019")).alias("ano"),
        own(11, F.lit("Lei 1")).alias("updated_by_law"), (i % 6 == 0).alias("is_revoked"), (i % 10 == 0).alias("is_vetoed"),
    )


def described(spark, d):
    return t(spark, d, "documents").withColumn("meta", meta())


SAID = [
    (1, "Art. 5 direitos fundamentais"), (2, "parágrafo único do art. 12, inciso IV"), (3, "o que o STF e o STJ dizem depois da lei"), (4, "a banca do concurso antes da lei revogada"), (5, "foi vetado? § 3"),
    (6, "questão de prova"), (7, "nada"), (8, ""), (9, "§ 2 do art. 7a revogado após"),
]
_Q = f"q AS (SELECT id, {FOLD.format('text')} AS q FROM {values(SAID, 'id', 'text')})"


def said(spark):
    return fixture(spark, SAID, "id int, text string").select("id", tx.fold(F.col("text")).alias("q"))


_TYPE = lambda c: f"CASE WHEN contains({c}, 'stf') OR contains({c}, 'stj') THEN 'jurisprudencia' WHEN contains({c}, 'banca') OR contains({c}, 'questao') THEN 'concurso' WHEN regexp_matches({c}, {quoted(search.SAID_ARTICLE.sql)}) OR regexp_matches({c}, {quoted(search.SAID_PARAGRAPH.sql)}) THEN 'artigo' ELSE 'geral' END"


@query(f"WITH {_Q}, a AS (SELECT id, q FROM q UNION ALL SELECT 1000 + item_id, {FOLD.format('text')} FROM benchmark) SELECT id, {_TYPE('q')} AS kind FROM a")
def query_intents(spark, d):
    """V15."""
    b = t(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("id"), tx.fold(F.col("text")).alias("q"))
    return said(spark).select(F.col("id").cast("long").alias("id"), "q").unionByName(b).select("id", search.query_type(F.col("q")).alias("kind"))


_REFS = lambda p: f"list_transform(regexp_extract_all(q, {quoted(p.sql)}, 1), lambda r: regexp_replace({FOLD.format('r')}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_MET = lambda p, k: f"coalesce(list_contains({_REFS(p)}, lower({k})), false)"
_BOOST = (
    f"least(0.4 * {_MET(search.SAID_ARTICLE, 'artigo')}::INT + 0.2 * {_MET(search.SAID_PARAGRAPH, 'paragrafo')}::INT + 0.2 * {_MET(search.SAID_ITEM, 'inciso')}::INT + 0.2 * (contains(q, 'stf') AND marca_stf)::INT + 0.2 * (contains(q, 'stj') AND marca_stj)::INT "
    "+ 0.15 * ((contains(q, 'concurso') OR contains(q, 'banca')) AND banca IS NOT NULL)::INT + 0.15 * ((contains(q, 'apos') OR contains(q, 'depois')) AND updated_by_law IS NOT NULL)::INT "
    "+ 0.1 * ((contains(q, 'antes') OR contains(q, 'anterior')) AND is_revoked)::INT + 0.2 * (contains(q, 'revog') AND is_revoked)::INT + 0.2 * (contains(q, 'vetad') AND is_vetoed)::INT, 1.0)"
)


@query(f"WITH {META}, {_Q} SELECT id, boost, count(*) AS n FROM (SELECT id, round({_BOOST}, 6)::DOUBLE AS boost FROM q, md) GROUP BY ALL")
def metadata_boosts(spark, d):
    """The boosts that each question gives to the documents."""
    rows = described(spark, d).crossJoin(F.broadcast(said(spark)))  # nine questions
    return rows.groupBy("id", F.round(search.metadata_boost(F.col("q"), F.col("meta")), 6).alias("boost")).agg(F.count("*").alias("n"))


_POOL = f"ask AS (SELECT item_id AS query_id, vec_id, text AS q FROM benchmark JOIN embeddings ON item_id = vec_id), sem AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings a JOIN ask ON ask.vec_id = a.vec_id, embeddings b)"
_LEX = f"lx AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, count(*) AS score FROM (SELECT item_id AS query_id, unnest(list_distinct({TERMS.format('text')})) AS term FROM benchmark) q JOIN documents ON contains(lower(text), term) GROUP BY ALL)) WHERE r <= 15)"
_UNION = f"{_POOL}, {_LEX}, u AS (SELECT query_id, doc_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS pos FROM sem LEFT JOIN lx USING (query_id, doc_id) WHERE r <= 50 OR lx.doc_id IS NOT NULL)"


def asked(spark, d):
    """Benchmark items with the vector of the same id."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "vec_id", "embedding")
    return t(spark, d, "benchmark").select("item_id", F.col("text").alias("q")).join(v, "item_id")


def candidates(spark, d, k: int = 5, pool: int | None = None):
    """V4: (query_id, doc_id, similarity): the `pool` (10 * k) most similar, and of the 3 * k best lexical hits those with a vector."""
    v, ask = t(spark, d, "embeddings").select("vec_id", "embedding"), asked(spark, d)
    semantic = vector.top_k(v, ask, pool or 10 * k).select("query_id", F.col("vec_id").alias("doc_id"), "similarity")
    named = search.like_top_k(t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark"), 3 * k).select("query_id", "doc_id")
    own = named.join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("e")), "doc_id").join(ask.select(F.col("item_id").alias("query_id"), "embedding"), "query_id")
    lexical = own.select("query_id", "doc_id", F.round(vector.cosine(F.col("e"), F.col("embedding")), 6).alias("similarity"))
    return search.candidate_union(semantic, lexical)


@query(f"WITH {_UNION} SELECT query_id, doc_id, similarity, CAST(pos AS INT) AS rank FROM u WHERE pos <= 5")
def candidate_union(spark, d):
    """V4, V7, V30, SET1: the best five of both kinds of candidates by similarity."""
    return search.best(candidates(spark, d), 5)


@query(f"WITH {_POOL}, p AS (SELECT query_id, doc_id, round(s, 6) AS similarity, count(*) FILTER (round(s, 6) >= 0.4) OVER (PARTITION BY query_id) AS first FROM sem) SELECT query_id, doc_id, similarity, CASE WHEN first < 5 THEN 0.3 ELSE 0.4 END::DOUBLE AS effective FROM p WHERE similarity >= CASE WHEN first < 5 THEN 0.3 ELSE 0.4 END")
def fallback_merge(spark, d):
    """V18, V19, SET2: a query with fewer than five hits of 0.4 takes those of 0.3."""
    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    hits = vector.within(v, asked(spark, d), 0.299).select("query_id", F.col("vec_id").alias("doc_id"), "similarity")
    return search.with_fallback(hits, 5, 0.4)


_BM = (
    f"{_UNION}, qt AS (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark), dt AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), "
    "b AS (SELECT u.query_id, u.doc_id, any_value(similarity) AS similarity, coalesce(sum(tf * 2.5 / (tf + 1.5)), 0) AS bm25 FROM u LEFT JOIN qt ON qt.query_id = u.query_id LEFT JOIN tf ON tf.doc_id = u.doc_id AND tf.term = qt.term WHERE u.pos <= 5 AND u.doc_id IN (SELECT doc_id FROM documents) GROUP BY ALL)"
)


@query(f"WITH {_BM} SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(0.7 * similarity + 0.3 * bm25 / coalesce(nullif(max(bm25) OVER (PARTITION BY query_id), 0), 1), 6) AS fused FROM b")
def bm25_fusion(spark, d):
    """V9, V10."""
    docs, ask = t(spark, d, "documents").select("doc_id", "text"), asked(spark, d).select(F.col("item_id").alias("query_id"), "q")
    hits = search.best(candidates(spark, d), 5).join(docs, "doc_id").join(ask, "query_id").withColumn("b", search.simple_bm25(tx.terms(F.col("q")), tx.terms(F.col("text"))))
    return hits.select("query_id", "doc_id", F.round("b", 6).alias("bm25"), F.round(search.bm25_fusion(F.col("similarity"), F.col("b")), 6).alias("fused"))


_W = "w(kind, a, b, c) AS (VALUES " + ", ".join(f"('{k}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for k, a, b, c in search.weights()) + ")"
#: A ranking looks at more.
_POOLED = _UNION.replace("r <= 50", "r <= 60")
_RANKED = (
    f"{META}, {_POOLED}, {_W}, tq AS (SELECT query_id, {FOLD.format('q')} AS q, list_distinct({TOK.format('q')}) AS qt FROM ask), td AS (SELECT doc_id, {TOK.format('text')} AS dt FROM documents), "
    "x AS (SELECT u.query_id, u.doc_id, similarity, u.pos, round(CASE WHEN len(qt) = 0 OR len(dt) = 0 THEN 0.0 ELSE least(0.7 * len(list_intersect(qt, dt)) / len(qt) + 0.3 * least(8.0 * len(list_filter(dt, lambda v: list_contains(qt, v))) / len(dt), 1.0), 1.0) END, 6) AS lexical, "
    f"round({_BOOST}, 6)::DOUBLE AS boost, {_TYPE('q')} AS kind, md.text FROM u JOIN tq USING (query_id) JOIN md USING (doc_id) JOIN td USING (doc_id)), "
    "f AS (SELECT x.*, round(a * similarity + b * lexical + c * boost, 6) AS final FROM x JOIN w USING (kind)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, pos) AS rank FROM f)"
)


def ranked(spark, d):
    """V14-V18 over the candidates: query_id, doc_id, similarity, lexical, boost, final, rank, meta, words, cost. A text is gone
    through once, however many queries have it among their candidates, and isn't joined to them."""
    ask = search.asking(asked(spark, d).select(F.col("item_id").alias("query_id"), "q")).drop("q")
    found = kept(search.best(candidates(spark, d, pool=search.pool_size(5)), 10**9).withColumnRenamed("rank", "pos"), "candidates")
    own = described(spark, d).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = kept(search.told(own.select("doc_id", "text", "meta")).drop("text"), "texts")
    return search.reranked(found.join(docs, "doc_id").join(ask, "query_id"))


@query(f"WITH {_RANKED} SELECT query_id, doc_id, CAST(rank AS INT) AS rank, similarity, lexical, boost, final FROM k WHERE rank <= 10")
def hybrid_rerank(spark, d):
    """The ten best of all candidates by the weighted sum, with its parts; ties stay in order of similarity."""
    return ranked(spark, d).where("rank <= 10").select("query_id", "doc_id", "rank", "similarity", "lexical", "boost", "final")


@query(f"WITH {_RANKED}, p AS (SELECT query_id, count(*) AS candidate_count, avg(similarity) FILTER (rank <= 5) AS mean, max(similarity) FILTER (rank = 1) AS top1, max(similarity) FILTER (rank = 2) AS top2, count(*) FILTER (rank <= 5) AS kept FROM k GROUP BY query_id) SELECT query_id, candidate_count, kept AS post_filter_count, round(mean, 6) AS mean, top1, round(top1 - coalesce(top2, top1), 6) AS gap, CASE WHEN mean >= 0.7 THEN 'alta' WHEN mean >= 0.55 THEN 'media' WHEN mean >= 0.4 THEN 'baixa' ELSE 'sem_rag' END AS confidence FROM p")
def retrieval_telemetry(spark, d):
    """V22, V24."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("similarity")))
    mean = F.avg(F.when(F.col("rank") <= 5, F.col("similarity")))
    p = ranked(spark, d).groupBy("query_id").agg(F.count("*").alias("candidate_count"), mean.alias("m"), at(1).alias("top1"), at(2).alias("top2"), F.count_if(F.col("rank") <= 5).alias("post_filter_count"))
    return p.select("query_id", "candidate_count", "post_filter_count", F.round("m", 6).alias("mean"), "top1", F.round(F.col("top1") - F.coalesce("top2", "top1"), 6).alias("gap"), search.confidence(F.col("m")).alias("confidence"))


_CITE = "concat_ws(', ', documento, 'Art. ' || artigo, '§ ' || paragrafo, 'Inciso ' || inciso, coalesce('Título: ' || titulo, 'Capítulo: ' || capitulo), 'Banca: ' || banca, 'Ano: ' || ano)"


@query(f"WITH {META} SELECT doc_id, {_CITE} AS citation FROM md")
def citations(spark, d):
    """V23."""
    return described(spark, d).select("doc_id", search.citation(F.col("meta")).alias("citation"))


_FOLDED = ", ".join(f"regexp_replace({FOLD.format(k)}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS {k}" for k in ("artigo", "paragrafo", "inciso"))
_OWN = f"{extraction.BASE}, {extraction.RECORD}, {_Q}, fm AS (SELECT doc_id, marca_stf, marca_stj, banca, updated_by_law, is_revoked, is_vetoed, {_FOLDED} FROM md)"


@query(f"WITH {_OWN} SELECT id, boost, count(*) AS n FROM (SELECT id, round({_BOOST}, 6)::DOUBLE AS boost FROM q, fm) GROUP BY ALL")
def extracted_boosts(spark, d):
    """E10 into V14: boosts by what is extracted from the texts themselves."""
    asked_of = [F.col(f"meta.{k}").alias(k) for k in search.BOOSTED]
    alike = extraction.recorded(spark, d).groupBy(*asked_of).agg(F.count("*").alias("rows")).select(F.struct(*search.BOOSTED).alias("meta"), "rows")
    rows = alike.crossJoin(F.broadcast(said(spark)))  # nine questions, against each record once
    return rows.groupBy("id", F.round(search.metadata_boost(F.col("q"), F.col("meta")), 6).alias("boost")).agg(F.sum("rows").alias("n"))


@query(f"WITH {_OWN} SELECT doc_id, {_CITE} AS citation, (artigo IS NOT NULL OR source_type = 'jurisprudence') AND NOT is_vetoed AS kept, coalesce(valid_from >= '2000-01-01' AND valid_from <= '2010-12-31', false) AS in_time FROM md")
def extracted_citations(spark, d):
    """E10 into V23, FLT1-FLT3: citations and filters on extracted records."""
    df = extraction.recorded(spark, d)
    kept = flt.condition({"__or__": [{"artigo": "not_null"}, {"source_type": "jurisprudence"}], "is_vetoed": False}, df)
    in_time = flt.condition({"valid_from_gte": "2000-01-01", "valid_from_lte": "2010-12-31"}, df)
    return df.select("doc_id", search.citation(F.col("meta")).alias("citation"), kept.alias("kept"), F.coalesce(in_time, F.lit(False)).alias("in_time"))


_SIGN = "CASE WHEN artigo IS NOT NULL THEN '⚖️' WHEN marca_stf OR marca_stj THEN '📜' WHEN banca IS NOT NULL THEN '❓' WHEN tokens < 100 THEN '📝' ELSE '📄' END"
_MSG = "CASE confidence " + " ".join(f"WHEN '{k}' THEN {quoted(m)}" for k, m in search.MESSAGES.items()) + " END"


@query(
    f"WITH {_RANKED}, h AS (SELECT k.query_id, k.rank, similarity, md.*, {UNITS.format('md.text')} AS tokens FROM k JOIN md USING (doc_id) WHERE rank <= 5), c AS (SELECT query_id, CASE WHEN avg(similarity) >= 0.7 THEN 'alta' WHEN avg(similarity) >= 0.55 THEN 'media' WHEN avg(similarity) >= 0.4 THEN 'baixa' ELSE 'sem_rag' END AS confidence FROM h GROUP BY query_id) "
    f"SELECT query_id, md5({_MSG} || chr(10) || chr(10) || '{search.CONTEXT_TITLE}' || chr(10) || string_agg(chr(10) || rank || '. ' || {_SIGN} || ' [Similaridade: ' || printf('%.2f', similarity) || ']' || chr(10) || 'Fonte: ' || {_CITE} || chr(10) || 'Texto: ' || substring(text, 1, 500) || '...', chr(10) ORDER BY rank) || chr(10) || {quoted(search.INSTRUCTIONS)}) AS context FROM h JOIN c USING (query_id) GROUP BY query_id, confidence"
)
def rendered_contexts(spark, d):
    """The prompt's context of the five best."""
    h = ranked(spark, d).where("rank <= 5").withColumnRenamed("cost", "tokens").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    h = h.withColumn("confidence", search.confidence(F.avg("similarity").over(Window.partitionBy("query_id"))))
    return search.rendered(h.select("query_id", "rank", "similarity", "text", "tokens", "meta", "confidence")).select("query_id", F.md5("context").alias("context"))


MODELS = [("openai", "gpt-4o-mini"), ("openai", "other"), ("google", "gemini-2.5-flash-lite"), (" Google ", "gemini-pro"), ("other", None), (None, None)]


@query("SELECT * FROM (VALUES ('openai', 'gpt-4o-mini', 2000, 0.85::DOUBLE, 0.0011::DOUBLE), ('openai', 'other', 2000, 0.86, 0.001), ('google', 'gemini-2.5-flash-lite', 1760, 0.8, 0.0009), (' Google ', 'gemini-pro', 1800, 0.82, 0.0009), ('other', NULL, 2000, 0.86, 0.001), (NULL, NULL, 2000, 0.86, 0.001)) s(provider, model, budget, redundancy, marginal)")
def context_strategies(spark, d):
    """V21."""
    rows = fixture(spark, MODELS, "provider string, model string")
    return rows.select("provider", "model", search.context_strategy(F.col("provider"), F.col("model")).alias("s")).select("provider", "model", "s.*")


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))"
_JACCARD = "coalesce((SELECT max(CASE WHEN len(w) = 0 OR len(o.words) = 0 THEN 0 ELSE len(list_intersect(w, o.words)) / len(list_distinct(list_concat(w, o.words))) END) FROM unnest(s.kept) x(w)), 0)"


def _selected(redundancy: float, marginal: float) -> str:
    """The selection as a recursion over the ranks: s, and last with each query's final state."""
    return (
        f"{_RANKED}, o AS (SELECT query_id, doc_id, rank, similarity, {UNITS.format('text')} AS cost, {_WORDS} AS words FROM k), "
        "s AS (SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS ids, []::VARCHAR[][] AS kept, 0::BIGINT AS used, 0 AS redundant, 0 AS marginal, 0 AS over_budget FROM (SELECT DISTINCT query_id FROM o) UNION ALL "
        "SELECT query_id, rank, CASE WHEN why = 'take' THEN list_append(ids, doc_id) ELSE ids END, CASE WHEN why = 'take' THEN list_append(kept, words) ELSE kept END, CASE WHEN why = 'take' THEN used + cost ELSE used END, redundant + (why = 'redundant')::INT, marginal + (why = 'marginal')::INT, over_budget + (why = 'over')::INT "
        f"FROM (SELECT o.query_id, o.rank, o.doc_id, o.words, o.cost, s.ids, s.kept, s.used, s.redundant, s.marginal, s.over_budget, CASE WHEN len(s.ids) >= 5 THEN 'done' WHEN len(s.ids) > 0 AND red >= {redundancy} THEN 'redundant' "
        f"WHEN len(s.ids) > 0 AND greatest(o.similarity, 0) * (1 - red) / (1 + 0.12 * o.rank) / greatest(o.cost, 1) < {marginal} THEN 'marginal' WHEN s.used + o.cost > 2000 THEN 'over' ELSE 'take' END AS why "
        f"FROM s JOIN o ON o.query_id = s.query_id AND o.rank = s.rank + 1, LATERAL (SELECT {_JACCARD} AS red) j)), last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1)"
    )


@query(f"WITH RECURSIVE {_selected(0.86, 0.00002)} SELECT query_id, array_to_string(ids, ',') AS chosen, used, redundant, marginal, over_budget FROM last")
def budgeted_selection(spark, d):
    """Of the ranked candidates at most five, under 2,000 tokens; the least gain is for texts of these lengths."""
    item = F.struct("rank", F.col("doc_id").alias("id"), F.col("similarity").alias("sim"), "cost", "words")
    g = ranked(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    c = g.select("query_id", search.select_within_budget(F.col("r"), 5, 2000, 0.86, 0.00002).alias("c"))
    return c.select("query_id", F.array_join(F.col("c.ids").cast("array<string>"), ",").alias("chosen"), "c.used", "c.redundant", "c.marginal", F.col("c.over").alias("over_budget"))


@query(
    f"WITH RECURSIVE {_selected(0.85, 0.0011)}, c AS (SELECT last.query_id, o.rank, similarity, {_CITE} AS source FROM last JOIN o ON o.query_id = last.query_id AND list_contains(ids, o.doc_id) JOIN md ON md.doc_id = o.doc_id), "
    "g AS (SELECT query_id, avg(similarity) AS mean, string_agg(source, '; ' ORDER BY rank) AS sources FROM c GROUP BY query_id) SELECT last.query_id, array_to_string(ids, ',') AS chosen, used AS tokens, round(mean, 6) AS mean, coalesce(sources, '') AS sources, "
    "CASE WHEN round(mean, 6) >= 0.7 THEN 'alta' WHEN round(mean, 6) >= 0.55 THEN 'media' WHEN round(mean, 6) >= 0.4 THEN 'baixa' ELSE 'sem_rag' END AS confidence FROM last LEFT JOIN g USING (query_id)"
)
def retrieval_pipeline(spark, d):
    """The whole path of a query (V4, V12-V17, V20-V24) for every benchmark item: candidates, ranking, selection by the first
    provider's strategy, confidence and citations of what was chosen."""
    cited = F.struct("rank", F.col("doc_id").alias("id"), F.col("similarity").alias("sim"), "cost", "words", search.citation(F.col("meta")).alias("source"))
    g = ranked(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(cited)).alias("r"))
    g = g.withColumn("s", search.context_strategy(F.lit("openai"), F.lit("gpt-4o-mini"))).withColumn("c", search.select_within_budget(F.col("r"), 5, F.col("s.budget"), F.col("s.redundancy"), F.col("s.marginal")))
    chosen = F.filter("r", lambda x: F.array_contains(F.col("c.ids"), x["id"]))
    mean = F.when(F.size(chosen) > 0, F.aggregate(chosen, F.lit(0.0), lambda a, x: a + x["sim"]) / F.size(chosen))
    told = g.select("query_id", F.array_join(F.transform(chosen, lambda x: x["id"].cast("string")), ",").alias("chosen"), F.col("c.used").alias("tokens"), F.round(mean, 6).alias("mean"), F.array_join(F.transform(chosen, lambda x: x["source"]), "; ").alias("sources"))
    return told.withColumn("confidence", search.confidence(F.coalesce("mean", F.lit(0.0))))


#: Kinds of the cases of a benchmark.
CASE_KINDS = ("artigo", "jurisprudencia", "concurso", "geral")
_CASES = (
    f"{META}, {_UNION}, cs AS (SELECT query_id, doc_id, pos, list_extract([{', '.join(map(quoted, CASE_KINDS))}], CAST(query_id % 4 + 1 AS INT)) AS kind, CAST(query_id % 20 AS VARCHAR) AS article FROM u WHERE pos <= 5), "
    "rel AS (SELECT cs.*, CASE kind WHEN 'artigo' THEN artigo IS NOT NULL AND (query_id % 8 <> 0 OR artigo = article) WHEN 'jurisprudencia' THEN marca_stf OR marca_stj WHEN 'concurso' THEN banca IS NOT NULL OR ano IS NOT NULL ELSE true END AND (query_id % 3 <> 0 OR contains(lower(text), 'the')) AS hit, "
    "CASE kind WHEN 'artigo' THEN artigo IS NOT NULL AND (query_id % 8 <> 0 OR artigo = article) WHEN 'jurisprudencia' THEN marca_stf OR marca_stj WHEN 'concurso' THEN banca IS NOT NULL OR ano IS NOT NULL ELSE documento <> '' END AS cited FROM cs JOIN md USING (doc_id)), "
    "r AS (SELECT query_id, kind, min(pos) FILTER (hit) AS r, coalesce(max(cited::INT) FILTER (pos = 1), 0) AS cited FROM rel GROUP BY ALL)"
)


def judged(spark, d):
    """EV1, W1: for each benchmark item, read as a case, the rank of its first relevant hit, and whether the first is cited rightly."""
    i = F.col("query_id")
    kind = F.element_at(F.array(*map(F.lit, CASE_KINDS)), (i % 4 + 1).cast("int"))
    article = F.when(i % 8 == 0, (i % 20).cast("string"))
    words = F.when(i % 3 == 0, F.array(F.lit("the"))).otherwise(F.array().cast("array<string>"))
    with_mark = F.struct("meta.*", F.lit(False).alias("marca_concurso"))
    hits = search.best(candidates(spark, d), 5).join(described(spark, d).select("doc_id", "text", "meta"), "doc_id").withColumn("kind", kind).withColumn("meta", with_mark)
    none = F.array().cast("array<string>")
    hits = hits.withColumn("hit", evaluation.relevant(F.col("kind"), F.col("meta"), F.col("text"), F.lit(None), article, words)).withColumn("cited", evaluation.relevant(F.col("kind"), F.col("meta"), F.col("text"), F.lit(None), article, none))
    return hits.groupBy("query_id", "kind").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("r"), F.coalesce(F.max(F.when((F.col("rank") == 1), F.col("cited").cast("int"))), F.lit(0)).alias("cited"))


@query(f"WITH {_CASES} SELECT query_id, kind, coalesce(r, 0) AS first_rank, CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_1, CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_3, round(coalesce(1.0 / r, 0), 6)::DOUBLE AS rr, round(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END, 6)::DOUBLE AS ndcg_at_5, cited FROM r")
def case_results(spark, d):
    """EV1, EV2, W1."""
    r = F.col("r")
    at = lambda k: F.when(r <= k, 1.0).otherwise(0.0)
    return judged(spark, d).select("query_id", "kind", F.coalesce("r", F.lit(0)).cast("long").alias("first_rank"), at(1).alias("recall_at_1"), at(3).alias("recall_at_3"), F.round(F.coalesce(1.0 / r, F.lit(0.0)), 6).alias("rr"), F.round(F.when(r <= 5, 1 / F.log2(r + 1)).otherwise(0.0), 6).alias("ndcg_at_5"), "cited")


_ALL_KINDS = ", ".join(f"('{k}')" for k in (*CASE_KINDS, "none", "overall"))


@query(f"WITH {_CASES}, g AS (SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END) AS r3, avg(coalesce(1.0 / r, 0)) AS mrr, avg(cited) AS cited FROM r GROUP BY ROLLUP (kind)) SELECT k.kind, coalesce(n, 0) AS n, round(coalesce(r3, 0), 6)::DOUBLE AS recall_at_3, round(coalesce(mrr, 0), 6)::DOUBLE AS mrr, round(coalesce(cited, 0), 6)::DOUBLE AS citation_rate FROM (VALUES {_ALL_KINDS}) k(kind) LEFT JOIN g USING (kind)")
def case_metrics(spark, d):
    """A8, EV2: by kind and overall; kinds without cases are there with zeros."""
    r = F.col("r")
    g = judged(spark, d).rollup("kind").agg(F.count("*").alias("n"), F.avg(F.when(r <= 3, 1.0).otherwise(0.0)).alias("recall_at_3"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.avg("cited").alias("citation_rate"))
    every = fixture(spark, [(k,) for k in (*CASE_KINDS, "none", "overall")], "kind string")
    j = every.join(g.withColumn("kind", F.coalesce("kind", F.lit("overall"))), "kind", "left")
    return j.select("kind", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("recall_at_3", "mrr", "citation_rate")])


@query("SELECT CAST(i AS BIGINT) AS request, session, length FROM (SELECT i, i % 10 AS session, length(text) AS length FROM (SELECT unnest(range(0, 200)) AS i), (SELECT count(*) AS n FROM benchmark) JOIN benchmark ON item_id = (i * 7 + 3) % n)")
def workload_requests(spark, d):
    """EV5: the requests of a load run: a seeded walk through the benchmark, dealt to sessions."""
    n = t(spark, d, "benchmark").agg(F.count("*").alias("n"))
    i = spark.range(200).crossJoin(F.broadcast(n)).select(F.col("id").alias("request"), ((F.col("id") * 7 + 3) % F.col("n")).alias("item_id"))
    return i.join(t(spark, d, "benchmark"), "item_id").select("request", (F.col("request") % 10).alias("session"), F.length("text").cast("long").alias("length"))


@query(f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, len(embedding) * 4 AS bytes FROM embeddings WHERE {ASKED}")
def vector_codec(spark, d):
    """Vectors as bytes of 32-bit floats, and read back."""
    back = vector.from_bytes(vector.to_bytes(t(spark, d, "embeddings").where(ASKED), "embedding", "b"), "b", "e")
    return back.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.octet_length("b").cast("long").alias("bytes"))


assert QUERIES
