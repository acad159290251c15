
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brevia.functions import pieces
from brevia.functions import text as tx
from brevia.operators import ann, evaluation, search, vector, word_index
from brevia.plans.core import ASKED, COS, FOLD, ORACLES, QUERIES, TERMS, TOK, UNITS, WORDS, query, t
from brevia.streaming import circuit_breaker, token_bucket

FLAGSHIP = "retrieval_pipeline"


# --- vectors -----------------------------------------------------------------------------------------------------
@query(f"SELECT 0 AS query_id, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (ORDER BY {COS} DESC, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND {COS} >= 0.0 QUALIFY rank <= 5")
def vector_topk(spark, d):
    """V1, V3, FLT5, SRC5."""
    v = t(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    return vector.top_k(v, v.where("vec_id = 0"), 5, 0.0).withColumn("query_id", F.col("query_id").cast("int"))


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10")
def vector_topk_batch(spark, d):
    """V2, V5, J9."""
    v = t(spark, d, "embeddings")
    return vector.top_k(v, v.where(ASKED), 10)


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label IN (1, 3) QUALIFY rank <= 5")
def vector_topk_filtered(spark, d):
    """V3 with FLT1 and FLT2: label 1 or 3."""
    v = t(spark, d, "embeddings")
    return vector.top_k(v.where(F.col("label").isin(1, 3)), v.where(ASKED), 5)


@query("WITH m AS (SELECT label, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) SELECT label, CAST(pos AS INT) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS value FROM m")
def centroid_by_label(spark, d):
    """C9."""
    return vector.centroids(t(spark, d, "embeddings"), "label")


@query(f"WITH n AS (SELECT a.vec_id AS q, a.label AS own, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT own AS label, count(*) AS n, round(avg(CASE WHEN label = own THEN 1.0 ELSE 0.0 END), 6) AS precision_at_5 FROM n WHERE r <= 5 GROUP BY own")
def knn_label_precision(spark, d):
    """V3, EV1."""
    v = t(spark, d, "embeddings")
    top = vector.top_k(v, v.where(ASKED), 6).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    top = top.withColumn("r", F.row_number().over(order)).where("r <= 5")
    mine, other = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), v.select("vec_id", "label")
    j = top.join(mine, "query_id").join(other, "vec_id")
    return j.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("precision_at_5"))


@query("SELECT source, count(*) AS n_docs, count(vec_id) AS n_embedded FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source")
def embedding_coverage(spark, d):
    """J2, SRC5."""
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return j.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("vec_id").alias("n_embedded"))


@query(
    f"WITH n AS (SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.{ASKED} QUALIFY r <= 50) "
    "SELECT query_id, vec_id, source, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS rank FROM n JOIN documents ON doc_id = vec_id WHERE lang = 'en' QUALIFY rank <= 5"
)
def index_probe(spark, d):
    """Ten times as many ids as asked for by their distance, joined to their rows; ids without
    a row, or whose row doesn't fit, drop out."""
    v = t(spark, d, "embeddings")
    rows = t(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    hits = vector.top_k(v, v.where(ASKED), 50).join(rows, "vec_id").withColumnRenamed("rank", "r")
    order = Window.partitionBy("query_id").orderBy("r")
    return hits.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("query_id", "vec_id", "source", "similarity", "rank")


@query()
def ann_topk(spark, d):
    """The ten nearest vectors through an index of all rows, for the recall that it was built for."""
    v = t(spark, d, "embeddings")
    return ann.build(v).search(v.where(ASKED), 10)


@query(f"SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10")
def ann_all_clusters(spark, d):
    """V11 with all clusters probed and without codes: exact."""
    v = t(spark, d, "embeddings")
    return ann.build(v).search(v.where(ASKED), 10, probes=10**6, refine=None)


@query("SELECT count(*) AS asked, 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, d):
    """Whether the index finds nine of ten of the ten nearest vectors."""
    v = t(spark, d, "embeddings")
    ask = v.where(ASKED)
    found, near = ann.build(v).search(ask, 10).select("query_id", "vec_id", F.lit(1).alias("hit")), vector.top_k(v, ask, 10).select("query_id", "vec_id")
    j = near.join(found, ["query_id", "vec_id"], "left")
    return j.agg(F.countDistinct("query_id").alias("asked"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("WITH c AS (SELECT o_custkey AS k, count(*) AS chunks, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) SELECT c_custkey AS document, coalesce(chunks, 0) AS chunks, coalesce(first, -1) AS first, (SELECT count(*) FROM orders LEFT JOIN customer x ON x.c_custkey = o_custkey WHERE x.c_custkey IS NULL) AS orphans FROM customer LEFT JOIN c ON k = c_custkey")
def eager_joins(spark, d):
    """Documents with their chunks (customers with their orders), and chunks whose document is missing."""
    docs, chunks = t(spark, d, "customer").select(F.col("c_custkey").alias("document")), t(spark, d, "orders").select(F.col("o_custkey").alias("document"), "o_orderkey")
    of = chunks.groupBy("document").agg(F.count("*").alias("chunks"), F.min("o_orderkey").alias("first"))
    lost = chunks.join(docs, "document", "left_anti").agg(F.count("*").alias("orphans"))  # one row
    j = docs.join(of, "document", "left").crossJoin(F.broadcast(lost))
    return j.select("document", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("first", F.lit(-1)).alias("first"), "orphans")


def _similar(spark, d):
    v = t(spark, d, "embeddings")
    return vector.top_k(v, v.where(ASKED), 5)


TOP5 = f"top5 AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY r <= 5)"


@query(f"WITH {TOP5}, m AS (SELECT query_id, round(avg(round(s, 6)), 6) AS mean, max(round(s, 6)) AS top1, round(max(round(s, 6)) - max(CASE WHEN r = 2 THEN round(s, 6) END), 6) AS gap FROM top5 GROUP BY query_id) SELECT *, CASE WHEN mean >= 0.7 THEN 'alta' WHEN mean >= 0.55 THEN 'media' WHEN mean >= 0.4 THEN 'baixa' ELSE 'sem_rag' END AS confidence FROM m")
def confidence_levels(spark, d):
    """V22, V24."""
    m = _similar(spark, d).groupBy("query_id").agg(
        F.round(F.avg("similarity"), 6).alias("mean"), F.max("similarity").alias("top1"), F.round(F.max("similarity") - F.max(F.when(F.col("rank") == 2, F.col("similarity"))), 6).alias("gap")
    )
    return m.withColumn("confidence", search.confidence(F.col("mean")))


@query(f"WITH {TOP5}, m AS (SELECT query_id, avg(round(s, 6)) AS mean FROM top5 GROUP BY query_id), c AS (SELECT CASE WHEN mean >= 0.7 THEN 'alta' WHEN mean >= 0.55 THEN 'media' WHEN mean >= 0.4 THEN 'baixa' ELSE 'sem_rag' END AS confidence, mean FROM m) SELECT confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM c GROUP BY confidence")
def confidence_distribution(spark, d):
    """A4."""
    m = _similar(spark, d).groupBy("query_id").agg(F.avg("similarity").alias("mean"))
    c = m.groupBy(search.confidence(F.col("mean")).alias("confidence")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query(f"WITH {TOP5}, m AS (SELECT query_id, avg(round(s, 6)) FILTER (s >= 0.3) AS mean, count(*) FILTER (s >= 0.3) AS chunks FROM top5 GROUP BY query_id) SELECT count(*) AS queries, round(coalesce(avg(mean) FILTER (mean > 0), 0), 6) AS mean_similarity, round(avg(chunks), 6) AS mean_chunks, round(100.0 * count(*) FILTER (mean >= 0.55) / count(*), 4) AS good_percent FROM m")
def confidence_summary(spark, d):
    """A4: over all queries the mean of the positive mean similarities, and of the hits of 0.3 and more."""
    hit = F.col("similarity") >= 0.3
    m = _similar(spark, d).groupBy("query_id").agg(F.avg(F.when(hit, F.col("similarity"))).alias("mean"), F.count_if(hit).alias("chunks"))
    mean = F.coalesce(F.avg(F.when(F.col("mean") > 0, F.col("mean"))), F.lit(0.0))
    good = 100.0 * F.count_if(F.coalesce(F.col("mean") >= 0.55, F.lit(False))) / F.count("*")
    return m.agg(F.count("*").alias("queries"), F.round(mean, 6).alias("mean_similarity"), F.round(F.avg("chunks"), 6).alias("mean_chunks"), F.round(good, 4).alias("good_percent"))


# --- lexical search ----------------------------------------------------------------------------------------------
@query(f"WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS.format('text')})) AS term FROM benchmark), s AS (SELECT query_id, doc_id, CAST(count(*) AS INT) AS score FROM q JOIN documents ON contains(lower(text), term) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 5")
def lexical_like_topk(spark, d):
    """V7, V8, V30."""
    return search.like_top_k(t(spark, d, "documents"), t(spark, d, "benchmark"))


_BM25 = (
    f"p AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), "
    f"len AS (SELECT doc_id, len({WORDS.format('text')}) AS n FROM documents), g AS (SELECT count(*) AS docs, avg(n) AS al FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    f"q AS (SELECT DISTINCT query_id, unnest({WORDS.format('w')}) AS term FROM (SELECT item_id AS query_id, unnest({TERMS.format('text')}) AS w FROM benchmark)), "
    "i AS (SELECT *, ln((docs - df + 0.5) / (df + 0.5)) AS raw FROM df, g), s AS (SELECT query_id, tf.doc_id, "
    "round(sum(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))), 6) AS score FROM q JOIN tf USING (term) JOIN i USING (term) JOIN len ON len.doc_id = tf.doc_id GROUP BY ALL) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 5"
)


@query(f"WITH {_BM25}")
def bm25_corpus_topk(spark, d):
    """V6, J1."""
    return search.bm25(t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark"))


@query(f"WITH {_BM25.replace('FROM documents', 'FROM documents WHERE doc_id % 11 <> 5')}")
def stored_bm25_topk(spark, d):
    """V6, SNK3: the same through an index that is kept: half of the documents, some with their texts reversed, then the other half, then
    the reversed ones as they are, and last some deleted."""
    docs, i = t(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    turned = F.when(i % 6 == 0, F.reverse("text")).otherwise(F.col("text"))
    index = word_index.build(docs.where(i % 2 == 0).withColumn("text", turned)).insert(docs.where(i % 2 != 0))
    index = index.update(docs.where(i % 6 == 0)).delete(docs.where(i % 11 == 5).select("doc_id"))
    return index.search(t(spark, d, "benchmark"))


HITS = f"h AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, count(*) AS score FROM (SELECT item_id AS query_id, unnest(list_distinct({TERMS.format('text')})) AS term FROM benchmark) q JOIN documents ON contains(lower(text), term) GROUP BY ALL)) WHERE r <= 5)"


def _hits(spark, d):
    docs, q = t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark")
    top = search.like_top_k(docs, q).select("query_id", "doc_id")
    return top.join(docs, "doc_id").join(F.broadcast(q.select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))), "query_id")


@query(f"WITH {HITS}, x AS (SELECT query_id, h.doc_id, list_distinct({TOK.format('b.text')}) AS q, {TOK.format('d.text')} AS c FROM h JOIN documents d ON d.doc_id = h.doc_id JOIN benchmark b ON b.item_id = h.query_id) SELECT query_id, doc_id, round(CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.0 ELSE least(0.7 * len(list_intersect(q, c)) / len(q) + 0.3 * least(8.0 * len(list_filter(c, lambda w: list_contains(q, w))) / len(c), 1.0), 1.0) END, 6) AS score FROM x")
def lexical_score(spark, d):
    """V12, V13, SET3."""
    return _hits(spark, d).select("query_id", "doc_id", F.round(search.lexical_score(tx.tokens(F.col("q")), tx.tokens(F.col("text"))), 6).alias("score"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {round(a, 6)}, {round(b, 6)}, {round(c, 6)})" for k, a, b, c in search.weights()) + ") w(query_type, semantic, lexical, boost)")
def rerank_weights(spark, d):
    """V16."""
    rows = spark.createDataFrame(search.weights(), "query_type string, semantic double, lexical double, boost double")
    return rows.select("query_type", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "boost")])


# --- filters and text --------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded, length({FOLD.format('text')}) AS n FROM documents")
def normalize_text(spark, d):
    """N3."""
    f = F.col("f")
    return t(spark, d, "documents").select("doc_id", tx.fold(F.col("text")).alias("f")).select("doc_id", F.md5(f).alias("folded"), F.length(f).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len({TOK.format('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOK.format('text')})) AS BIGINT) AS n_distinct, {UNITS.format('text')} AS n_units FROM documents")
def token_counts(spark, d):
    """V12, C7."""
    k = F.col("k")
    folded = t(spark, d, "documents").select("doc_id", tx.fold(F.col("text")).alias("f")).select("doc_id", "f", tx.tokens_of_folded(F.col("f")).alias("k"))
    return folded.select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.size(F.array_distinct(k)).cast("long").alias("n_distinct"), tx.units_of_folded(F.col("f")).cast("long").alias("n_units"))


# --- ingestion ---------------------------------------------------------------------------------------------------
@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash_groups(spark, d):
    """A1, C11."""
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("WITH h AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, CASE WHEN rn = 1 THEN h ELSE sha256(h || ':' || doc_id) END AS content_hash FROM h")
def rehash_duplicates(spark, d):
    """C13."""
    h = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first"))
    return h.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("h")).otherwise(F.sha2(F.concat_ws(":", "h", "doc_id"), 256)).alias("content_hash"))


# --- evaluation and telemetry ------------------------------------------------------------------------------------
RANKS = f"rk AS (SELECT q.vec_id AS query_id, q.label AS kind, min(CASE WHEN x.label = q.label THEN x.r END) AS r FROM embeddings q JOIN (SELECT a.vec_id AS qid, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY r <= 10) x ON x.qid = q.vec_id GROUP BY ALL)"


@query(f"WITH {RANKS} SELECT coalesce(CAST(kind AS VARCHAR), 'overall') AS kind, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr, round(avg(CASE WHEN r <= 5 THEN 1.0 / log2(r + 1) ELSE 0.0 END), 6) AS ndcg_at_5 FROM rk GROUP BY ROLLUP (kind)")
def ir_metrics_rollup(spark, d):
    """EV1, EV2, W1, A8."""
    v = t(spark, d, "embeddings")
    top = vector.top_k(v, v.where(ASKED), 11).where("query_id != vec_id")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 10").join(v.select("vec_id", "label"), "vec_id")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("kind"))
    rk = top.join(own, "query_id").groupBy("query_id", "kind").agg(F.min(F.when(F.col("label") == F.col("kind"), F.col("r"))).alias("r"))
    at = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0))
    g = rk.rollup("kind").agg(
        F.count("*").alias("n"), F.round(at(1), 6).alias("recall_at_1"), F.round(at(5), 6).alias("recall_at_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("r") <= 5, 1.0 / F.log2(F.col("r") + 1)).otherwise(0.0)), 6).alias("ndcg_at_5"),
    )
    return g.withColumn("kind", F.coalesce(F.col("kind").cast("string"), F.lit("overall")))


@query("SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles_nearest_rank(spark, d):
    """P: sorted[ceil(p * n) - 1], A9, A13."""
    p = lambda q: F.expr(f"round(percentile_disc({q}) WITHIN GROUP (ORDER BY value), 6)").alias(f"p{round(q * 100)}")
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5), p(0.95), p(0.99))


@query("SELECT round(coalesce(corr(length(text), n_chars + doc_id % 13), 0), 6) AS pearson FROM documents")
def pearson_corr(spark, d):
    """A6."""
    return t(spark, d, "documents").agg(F.round(F.coalesce(F.corr(F.length("text").cast("double"), (F.col("n_chars") + F.col("doc_id") % 13).cast("double")), F.lit(0.0)), 6).alias("pearson"))


@query("SELECT event_type, CAST(le AS DOUBLE) AS le, sum(CASE WHEN value <= le THEN 1 ELSE 0 END)::BIGINT AS n FROM events, (SELECT unnest([1, 5, 10, 25, 50, 100, 250]) AS le) GROUP BY ALL")
def histogram_buckets(spark, d):
    """Cumulative buckets in one pass."""
    les = (1, 5, 10, 25, 50, 100, 250)
    g = t(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= x).alias(f"b{x}") for x in les])
    return g.select("event_type", F.inline(F.array(*[F.struct(F.lit(float(x)).alias("le"), F.col(f"b{x}").alias("n")) for x in les])))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def counter_labels(spark, d):
    """A17, A20."""
    return t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT source, count(*) AS chunk_count, CAST(sum(n_chars // 4) AS BIGINT) AS token_count, round(sum(n_chars // 4) * 0.02 / 1e6, 9) AS cost FROM documents GROUP BY source")
def document_stats_cost(spark, d):
    """A2, A19, PRJ2."""
    n = F.floor(F.col("n_chars") / 4)
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunk_count"), F.sum(n).alias("token_count"), F.round(F.sum(n) * 0.02 / 1e6, 9).alias("cost"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM conversations) AS messages")
def table_counts(spark, d):
    """A3, V28, SNK10."""
    c = lambda n: t(spark, d, n).agg(F.count("*").alias("messages" if n == "conversations" else n))
    return c("documents").crossJoin(c("embeddings")).crossJoin(c("conversations"))


# --- conversations -----------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 4")
def history_last_runs(spark, d):
    """The last two exchanges."""
    c = t(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("r", r).where("r <= 4").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, count(*) AS message_count, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS from_user, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_info(spark, d):
    """A23, M1."""
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("from_user"), F.max("turn").alias("last_turn"))


@query("WITH s AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations WHERE role <> 'system') SELECT conv_id, count(*) AS kept, sum(n)::BIGINT AS chars, min(turn) AS first_turn FROM s WHERE used <= 1500 GROUP BY conv_id")
def prompt_packing(spark, d):
    """M3: newest first, under a budget of characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    s = t(spark, d, "conversations").where("role != 'system'").select("conv_id", "turn", F.length("text").alias("n"), F.sum(F.length("text")).over(w).alias("used"))
    return s.where("used <= 1500").groupBy("conv_id").agg(F.count("*").alias("kept"), F.sum("n").alias("chars"), F.min("turn").alias("first_turn"))


@query("SELECT user_id, event_id AS last_event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts >= TIMESTAMP '2024-01-10'")
def latest_activity(spark, d):
    """The latest row of each key, and retention."""
    last = t(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.where(F.col("m.ts") >= F.expr("TIMESTAMP_NTZ '2024-01-10'")).select("user_id", F.col("m.event_id").alias("last_event"), F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("WITH gone AS (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) SELECT (SELECT count(DISTINCT user_id) FROM events) - (SELECT count(*) FROM gone) AS conversations, (SELECT count(*) FROM gone) AS deleted, (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM gone)) AS messages")
def retention(spark, d):
    """Conversations without a message in the last hour go, and their messages with them."""
    e = t(spark, d, "events").select("user_id", "ts")
    end = e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("cutoff"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(end))  # one row
    gone = last.where("last < cutoff").select("user_id")
    kept = e.join(gone, "user_id", "left_anti").agg(F.count_distinct("user_id").alias("conversations"), F.count("*").alias("messages"))
    return kept.crossJoin(gone.agg(F.count("*").alias("deleted"))).select("conversations", "deleted", "messages")


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS text_md5 FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def message_pages(spark, d):
    """M1: the first two messages of a role in each conversation."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t(spark, d, "conversations").where("role = 'user'").withColumn("r", r).where("r <= 2")
    return c.select("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


# --- state -------------------------------------------------------------------------------------------------------
@query(
    'WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), s AS (SELECT user_id, event_id, rn, true AS allowed, 1.0::DOUBLE AS tokens, t AS last, NULL::DOUBLE AS until FROM e WHERE rn = 1 UNION ALL SELECT user_id, event_id, rn, ok, CASE WHEN limited THEN tokens WHEN ok THEN filled - 1 ELSE filled END, CASE WHEN limited THEN last ELSE t END, CASE WHEN limited OR ok THEN until ELSE t + (1 - filled) / (2 / 86400.0::DOUBLE) END FROM (SELECT e.user_id, e.event_id, e.rn, e.t, s.tokens, s.last, s.until, coalesce(e.t < s.until, false) AS limited, least(2.0::DOUBLE, s.tokens + (e.t - s.last) * (2 / 86400.0::DOUBLE)) AS filled, NOT coalesce(e.t < s.until, false) AND least(2.0::DOUBLE, s.tokens + (e.t - s.last) * (2 / 86400.0::DOUBLE)) >= 1 AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)) SELECT user_id, event_id, allowed FROM s'
)
def token_bucket_decisions(spark, d):
    """Two requests, refilled at two a day."""
    return token_bucket.decide(t(spark, d, "events"), "user_id", 2, 2 / 86400)


@query("WITH l AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_type, sum(CASE WHEN p IS NOT NULL AND ts - p <= INTERVAL 1 DAY THEN 1 ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 1 DAY THEN 1 ELSE 0 END)::BIGINT AS misses FROM l GROUP BY event_type")
def cache_simulation(spark, d):
    """A hit if the key was asked for within a day before."""
    p = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = t(spark, d, "events").withColumn("p", p).withColumn("hit", F.coalesce(F.col("ts") - F.col("p") <= F.expr("INTERVAL 1 DAY"), F.lit(False)))
    return e.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


# --- evaluation of variants, circuit breaker, pieces -----------------------------------------------------------------
def _results(spark, d):
    """Events read as evaluated cases."""
    v = F.col("value")
    return t(spark, d, "events").select(
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate").alias("variant"), F.col("event_type").alias("tipo"), (v >= 5).cast("double").alias("recall_at_5"),
        (v >= 8).cast("double").alias("citation"), (v < 90).cast("double").alias("coverage"), (v / 100).alias("latency_s"), (v / 10000).alias("cost_usd"), (v > 99).alias("timeout"), (v < 0.5).alias("error"), (v < 2).cast("double").alias("no_basis"),
    )


_LEVEL_NAMES = [name for name, _, _ in evaluation.LEVELS]
_METRICS = """WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS variant, event_type AS tipo, value AS v FROM events),
m AS (SELECT variant, coalesce(tipo, 'overall') AS tipo, count(*) AS n_cases, avg((v >= 5)::INT) AS recall_at_5, avg((v >= 8)::INT) AS citation, avg((v < 90)::INT) AS coverage, avg((v < 2)::INT) AS no_basis, quantile_disc(v / 100, 0.95) AS p95_latency_s,
avg(v / 10000) AS mean_cost_usd, avg((v > 99)::INT) AS timeout_rate, avg((v < 0.5)::INT) AS error_rate FROM r GROUP BY GROUPING SETS ((variant, tipo), (variant)))
"""
_OK = {name: f"{name} {'>=' if more else '<='} {limit}" for name, more, limit in evaluation.LEVELS}


@query(_METRICS + f"SELECT variant, tipo, n_cases, {', '.join(f'round({n}, 6) AS {n}' for n in _LEVEL_NAMES)}, {', '.join(f'{c} AS {n}_ok' for n, c in _OK.items())}, {' AND '.join(_OK.values())} AS all_pass FROM m")
def integrated_slo(spark, d):
    """A9, A10."""
    m = evaluation.service_levels(evaluation.integrated_metrics(_results(spark, d), "variant"))
    return m.withColumns({n: F.round(n, 6) for n in _LEVEL_NAMES}).drop("no_basis")


_DELTA = {n: f"max(CASE WHEN variant = 'candidate' THEN {n} END) - max(CASE WHEN variant = 'baseline' THEN {n} END)" for n in evaluation.COMPARED}
_NOT_WORSE = [_DELTA[n] + (" >= 0" if more else " <= 0") for n, more in evaluation.DOMINANCE.items()]


@query(_METRICS + f"SELECT tipo, {', '.join(f'round({x}, 6) AS {n}_delta' for n, x in _DELTA.items())}, {' AND '.join(_NOT_WORSE)} AS dominates FROM m GROUP BY tipo")
def variant_deltas(spark, d):
    """A11."""
    x = evaluation.deltas(evaluation.integrated_metrics(_results(spark, d), "variant"), "baseline", "candidate")
    return x.withColumns({f"{n}_delta": F.round(f"{n}_delta", 6) for n in evaluation.COMPARED})


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), s AS (SELECT user_id, event_id, rn, 'closed' AS state, CASE WHEN coalesce(value >= 10, false) THEN 0 ELSE 1 END AS failed, NULL::DOUBLE AS since FROM e WHERE rn = 1 UNION ALL SELECT user_id, event_id, rn, now, CASE WHEN now = 'open' THEN failed WHEN good THEN 0 ELSE failed + 1 END, CASE WHEN now = 'open' THEN since WHEN NOT good AND (now = 'half_open' OR failed + 1 >= 3) THEN t END FROM (SELECT e.user_id, e.event_id, e.rn, e.t, s.failed, s.since, coalesce(e.value >= 10, false) AS good, CASE WHEN s.since IS NULL THEN 'closed' WHEN e.t - s.since >= 86400 THEN 'half_open' ELSE 'open' END AS now FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)) SELECT user_id, event_id, state, state <> 'open' AS allowed FROM s"
)
def circuit_breaker_decisions(spark, d):
    """A call fails whose value is under 10; after three in a row a user's calls are refused for a day."""
    return circuit_breaker.decide(t(spark, d, "events"), "user_id", F.coalesce(F.col("value") >= 10, F.lit(False)), 3, 86400.0)


@query(
    "WITH RECURSIVE f AS (SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: list_transform(range(0, CAST(ceil(length(x) / 2000.0) AS BIGINT)), lambda k: substring(x, k * 2000 + 1, 2000)))) AS parts FROM documents), "
    "o AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS rn FROM f), s AS (SELECT doc_id, 0::BIGINT AS rn, '' AS now, NULL::VARCHAR AS done FROM f UNION ALL SELECT doc_id, rn, CASE WHEN fits AND now <> '' THEN now || chr(10) || chr(10) || piece ELSE piece END, CASE WHEN fits THEN NULL ELSE now END "
    "FROM (SELECT o.doc_id, o.rn, o.piece, s.now, s.now = '' OR length(s.now) + 2 + length(o.piece) <= 2000 AS fits FROM s JOIN o ON o.doc_id = s.doc_id AND o.rn = s.rn + 1)), "
    "m AS (SELECT doc_id, rn, done AS message FROM s WHERE done IS NOT NULL UNION ALL SELECT doc_id, 1000000000, now FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) = 1) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS INT) AS pos, message FROM m WHERE message <> ''"
)
def message_pieces(spark, d):
    """N11."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(pieces.messages(F.col("text"), 2000)).alias("pos", "message"))


@query("WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, CAST(i AS INT) AS pos, CAST(least(50, n - i * 40) AS INT) AS n_words FROM (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 10) / 40.0) AS BIGINT)))) AS i FROM w WHERE n > 0)")
def token_windows(spark, d):
    """Windows of 50 words that overlap by 10."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    return t(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.posexplode(pieces.token_windows(F.col("w"), 50, 10)).alias("pos", "win")).select("doc_id", "pos", F.size("win").alias("n_words"))


from brevia.plans import chunking, extraction, filtering, ingestion, retrieval, sources, telemetry, texts  # noqa: E402, F401
