"""Lexical search, hybrid ranking, selection under a budget, confidence and citations."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions.columns import let
from brevia.functions.patterns import Pattern
from brevia.functions.text import fold, fold_letters, terms, tokens, tokens_of_folded, units_of_folded
from brevia.operators.vector import in_blocks
from brevia.storage import kept

#: Query terms that may be broadcast (a term and an id each).
BROADCAST_ROWS = 200_000
#: Terms that a text's words are held against in its row; of more all words are counted.
FEW_TERMS = 5000
#: How each kind of query weighs similarity, words and metadata.
WEIGHTS = {"artigo": (0.90, 0.80, 1.80), "jurisprudencia": (0.95, 0.75, 1.45), "concurso": (0.85, 1.35, 1.10), "geral": (1.0, 1.0, 1.0)}


def words(text: Column) -> Column:
    """The words of a text as a full-text index splits them: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold_letters(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def counted_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, doc_len, hits: the words of the table `wanted` (term) with repeats) of every document, as a table. The text is gone
    through once, and of few wanted terms no other word leaves its row."""
    few = [r.term for r in wanted.limit(FEW_TERMS + 1).collect()]
    rows = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("doc_len"), (F.filter("w", lambda x: x.isin(few)) if len(few) <= FEW_TERMS else F.col("w")).alias("hits"))
    return kept(rows, "words")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """V6: (query_id, doc_id, score, rank) over the whole corpus; a term that most documents hold counts next to nothing."""
    q = queries.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.flatten(F.transform(terms(F.col("text")), words)))).alias("term"))
    rows = counted_words(docs, q.select("term").distinct())
    size = rows.agg(F.count("*").alias("docs"), F.avg("doc_len").alias("avg_len"))
    once = F.broadcast if q.count() <= BROADCAST_ROWS else lambda df: df
    # the words asked for are dealt by document; counts and, where queries are broadcast, scores then stay where they are
    p = rows.where(F.size("hits") > 0).repartition("doc_id").select("doc_id", "doc_len", F.explode("hits").alias("term")).groupBy("term", "doc_id", "doc_len").agg(F.count("*").alias("tf")).join(once(q.select("term").distinct()), "term", "left_semi")
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    j = p.join(once(df), "term").join(once(q), "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    total = j.groupBy("query_id", "doc_id").agg(F.round(F.sum(s), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def like_top_k(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """V7: (query_id, doc_id, score, rank): the number of the query's terms that a text holds, as parts of words too; best k. The
    terms of a block of queries go to the tasks as one automaton, which reads each text once; of the scores of a batch of
    texts only the k best for each query go on to the shuffle."""
    q = queries.select(F.col("item_id").cast("long").alias("query_id"), F.array_distinct(terms(F.col("text"))).alias("t"))
    low = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("low"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def best(block: DataFrame) -> DataFrame:
        asked = [(r.query_id, r.t) for r in block.collect() if r.t]  # BLOCK rows, about
        known = {t: j for j, t in enumerate(sorted({t for _, own in asked for t in own}))}
        ids = np.array([i for i, _ in asked], np.int64)

        def run(batches):
            holds = np.zeros((len(known), len(asked)), np.int32)
            for j, (_, own) in enumerate(asked):
                holds[[known[t] for t in own], j] = 1
            found_in = _finder(known)
            for b in batches:
                for start in range(0, b.num_rows if asked else 0, 512):
                    part = b.slice(start, 512)
                    rows = np.argsort(doc_ids := part.column(0).to_numpy(), kind="stable")  # ties go to the smallest id
                    texts = part.column(1).to_pylist()
                    scores = np.stack([holds[found_in(texts[r])].sum(axis=0) for r in rows])
                    near = min(k, len(rows))
                    key = scores.astype(np.int64) * len(rows) - np.arange(len(rows))[:, None]
                    top = np.argpartition(-key, near - 1, axis=0)[:near]
                    at, j = top.ravel(), np.tile(np.arange(len(asked)), near)
                    at, j = at[keep := scores[at, j] > 0], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(doc_ids[rows[at]]), pa.array(scores[at, j], pa.int32())], ["query_id", "doc_id", "score"])

        found = low.mapInArrow(run, "query_id long, doc_id long, score int")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return in_blocks(q, "query_id", best)


def _finder(known: dict[str, int]):
    """A function from a text to the numbers of the terms that it holds."""
    try:
        import ahocorasick
    except ImportError:  # slower: one search for each term
        return lambda text: [j for t, j in known.items() if t in text]
    automaton = ahocorasick.Automaton()
    for t, j in known.items():
        automaton.add_word(t, j)
    automaton.make_automaton()
    return lambda text: list({j for _, j in automaton.iter(text)})


def simple_bm25(query: Column, doc: Column, k1: float = 1.5) -> Column:
    """V9: idf 1, no length norm; terms of the query count as often as they stand there."""

    def summed(d: Column) -> Column:
        tf = lambda t: F.size(F.filter(d["doc"], lambda x: x == t))
        return F.aggregate(d["query"], F.lit(0.0), lambda s, t: s + tf(t) * (k1 + 1) / (tf(t) + k1))

    return let(F.struct(query.alias("query"), doc.alias("doc")), summed)


def lexical_score(query: Column, doc: Column) -> Column:
    """0.7 * coverage + 0.3 * capped frequency, 1 at most."""

    def scored(x: Column) -> Column:
        freq = F.size(F.filter(x["d"], lambda t: F.array_contains(x["m"], t))) / F.size(x["d"])
        score = 0.7 * F.size(x["m"]) / F.size(x["q"]) + 0.3 * F.least(8 * freq, F.lit(1.0))
        return F.when((F.size(x["q"]) == 0) | (F.size(x["d"]) == 0), 0.0).otherwise(F.least(score, F.lit(1.0)))

    matched = lambda x: F.struct(x["q"].alias("q"), x["d"].alias("d"), F.array_intersect(x["q"], x["d"]).alias("m"))
    return let(let(F.struct(F.array_distinct(query).alias("q"), doc.alias("d")), matched), scored)


#: What a normalised query says about articles, paragraphs and items.
SAID_ARTICLE = Pattern(r"\bart\.?\s*(\d+[a-z]?)")
SAID_PARAGRAPH = Pattern(r"(?:§|par[aá]grafo)\s*(\d+|unico|único)")
SAID_ITEM = Pattern(r"\binciso\s+([ivxlcdm]+|\d+)\b")


def query_type(text: Column) -> Column:
    """V15, of a normalised query: the first that fits."""
    has = lambda *words: reduce(or_, [text.contains(w) for w in words])
    return F.when(has("stf", "stj"), "jurisprudencia").when(has("banca", "questao"), "concurso").when(SAID_ARTICLE.found(text) | SAID_PARAGRAPH.found(text), "artigo").otherwise("geral")


def _reference(text: Column) -> Column:
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


#: What a boost asks of metadata.
BOOSTED = ("artigo", "paragrafo", "inciso", "marca_stf", "marca_stj", "banca", "updated_by_law", "is_revoked", "is_vetoed")


def metadata_boost(query: Column, meta: Column) -> Column:
    """How well metadata (a struct or map with the keys below) fits a normalised query; 1 at most."""
    said = lambda p: F.transform(p.every(query), _reference)
    met = lambda p, key: (_reference(meta[key]) != "") & F.array_contains(said(p), _reference(meta[key]))
    has = lambda *words: reduce(or_, [query.contains(w) for w in words])
    filled = lambda key: F.coalesce(meta[key], F.lit("")) != ""
    on = lambda key: F.coalesce(meta[key].cast("boolean"), F.lit(False))
    parts = (
        (0.40, met(SAID_ARTICLE, "artigo")), (0.20, met(SAID_PARAGRAPH, "paragrafo")), (0.20, met(SAID_ITEM, "inciso")), (0.20, has("stf") & on("marca_stf")), (0.20, has("stj") & on("marca_stj")),
        (0.15, has("concurso", "banca") & filled("banca")), (0.15, has("apos", "depois") & filled("updated_by_law")), (0.10, has("antes", "anterior") & on("is_revoked")),
        (0.20, has("revog") & on("is_revoked")), (0.20, has("vetad") & on("is_vetoed")),
    )
    return F.least(reduce(lambda a, x: a + F.when(F.coalesce(x[1], F.lit(False)), x[0]).otherwise(0.0), parts, F.lit(0.0)), F.lit(1.0))


def weights(base: tuple[float, float, float] = (0.70, 0.20, 0.10)) -> list[tuple[str, float, float, float]]:
    """For each query type the calibrated weights, of sum 1."""
    out = []
    for kind, by in WEIGHTS.items():
        raw = [max(0.0, x * y) for x, y in zip(base, by, strict=True)]
        out.append((kind, *[x / sum(raw) if sum(raw) else y for x, y in zip(raw, (0.70, 0.20, 0.10), strict=True)]))
    return out


def confidence(mean: Column) -> Column:
    """V22."""
    return F.when(mean >= 0.70, "alta").when(mean >= 0.55, "media").when(mean >= 0.40, "baixa").otherwise("sem_rag")


CHOSEN = "struct<ids:array<bigint>,kept:array<array<string>>,used:bigint,rank:int,redundant:int,marginal:int,over:int>"


def select_within_budget(ranked: Column, k: int, budget, redundancy=0.86, marginal=0.001) -> Column:
    """A fold over array<struct<id, sim, cost, words>> in rank order: struct of the chosen ids, the tokens used, and how
    many were skipped as redundant, as of too little gain, and as over the budget. Limits may be columns.

    A candidate's gain is max(sim, 0) * (1 - red) / (1 + 0.12 * rank) / max(cost, 1), with ranks from 1, where red is its
    largest Jaccard similarity with a chosen one. The first that fits is taken whatever its gain; with k it is over."""
    start = F.struct(
        F.array().alias("ids"), F.array().alias("kept"), F.lit(0).alias("used"), F.lit(0).alias("rank"), F.lit(0).alias("redundant"), F.lit(0).alias("marginal"), F.lit(0).alias("over")
    ).cast(CHOSEN)

    def step(s: Column, c: Column) -> Column:
        either = lambda w: F.size(F.array_union(w, c["words"]))
        jaccard = lambda w: F.when((F.size(w) == 0) | (F.size(c["words"]) == 0), 0.0).otherwise(F.size(F.array_intersect(w, c["words"])) / either(w))
        red = F.coalesce(F.array_max(F.transform(s["kept"], jaccard)), F.lit(0.0))
        gain = F.greatest(c["sim"], F.lit(0.0)) * (1 - red) / (1 + 0.12 * (s["rank"] + 1)) / F.greatest(c["cost"], F.lit(1))
        some = F.size(s["ids"]) > 0
        same, little = some & (red >= redundancy), some & (gain < marginal)
        why = F.when(same, "redundant").when(little, "marginal").when(s["used"] + c["cost"] > budget, "over").otherwise("")
        take, count = why == "", lambda name: (s[name] + (why == name).cast("int")).alias(name)
        return F.when(F.size(s["ids"]) >= k, s).otherwise(
            F.struct(
                F.when(take, F.concat(s["ids"], F.array(c["id"]))).otherwise(s["ids"]).alias("ids"),
                F.when(take, F.concat(s["kept"], F.array(c["words"]))).otherwise(s["kept"]).alias("kept"),
                F.when(take, s["used"] + c["cost"]).otherwise(s["used"]).alias("used"),
                (s["rank"] + 1).alias("rank"), count("redundant"), count("marginal"), count("over"),
            ).cast(CHOSEN)
        )

    return F.aggregate(ranked, start, step, lambda s: F.struct(s["ids"].alias("ids"), s["used"].alias("used"), s["redundant"].alias("redundant"), s["marginal"].alias("marginal"), s["over"].alias("over")))


def pool_size(k: int, times: int = 12, least: int = 60, most: int = 240) -> int:
    """How many candidates a ranking of k looks at."""
    return min(max(k * times, least), most)


def candidate_union(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """V4, SET1: the candidates of both kinds, (query_id, doc_id, similarity), each once, the first one's similarity."""
    both = semantic.withColumn("o", F.lit(0)).unionByName(lexical.withColumn("o", F.lit(1)))
    return both.groupBy("query_id", "doc_id").agg(F.min_by("similarity", "o").alias("similarity"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, similarity, rank): the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def asking(queries: DataFrame) -> DataFrame:
    """Queries (q) with what ranking asks of each: normal, q_tokens, query_type."""
    normal = queries.withColumn("normal", fold(F.col("q")))
    return normal.withColumn("q_tokens", tokens_of_folded(F.col("normal"))).withColumn("query_type", query_type(F.col("normal")))


def told(docs: DataFrame) -> DataFrame:
    """Documents (text) with what ranking and selection ask of each: doc_tokens, cost, words."""
    folded = docs.withColumn("_folded", fold(F.col("text")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    return folded.withColumns({"doc_tokens": tokens_of_folded(F.col("_folded")), "cost": units_of_folded(F.col("_folded")), "words": words}).drop("_folded")


def reranked(hits: DataFrame) -> DataFrame:
    """Hits (query_id, pos, similarity, text, meta, q: the query) with query_type, lexical (V13), boost (V14), final (the sum
    weighted by the query's type, V16) and rank: by final, ties in the order of pos. Where a query or text stands in many
    hits, asking() and told() go before the join, and hits need neither q nor text."""
    hits = hits if "normal" in hits.columns else asking(hits)
    hits = hits if "doc_tokens" in hits.columns else hits.withColumn("doc_tokens", tokens(F.col("text")))
    w = hits.sparkSession.createDataFrame(weights(), "query_type string, wa double, wb double, wc double")
    j = hits.join(F.broadcast(w), "query_type")  # four rows
    j = j.withColumn("lexical", F.round(lexical_score(F.col("q_tokens"), F.col("doc_tokens")), 6)).withColumn("boost", F.round(metadata_boost(F.col("normal"), F.col("meta")), 6))
    j = j.withColumn("final", F.round(F.col("wa") * F.col("similarity") + F.col("wb") * F.col("lexical") + F.col("wc") * F.col("boost"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "pos")
    return j.withColumn("rank", F.row_number().over(order)).drop("wa", "wb", "wc", "normal", "q_tokens", "doc_tokens")


def with_fallback(scored: DataFrame, k: int, least: float, floor: float = 0.2, less: float = 0.1) -> DataFrame:
    """V19 and SET2: rows of at least `least`; a query with fewer than k of them takes those of max(floor, least - less) too.
    One pass: the second search's rows hold the first one's, so the merge of both is the lower threshold."""
    lower = max(floor, round(least - less, 6))
    first = F.count_if(F.col("similarity") >= least).over(Window.partitionBy("query_id"))
    limit = F.when((first < k) & F.lit(lower < least), lower).otherwise(least)
    return scored.where(F.col("similarity") >= min(lower, least)).withColumn("effective", limit).where(F.col("similarity") >= F.col("effective"))


def bm25_fusion(similarity: Column, bm25: Column, by: str = "query_id") -> Column:
    """0.7 of the similarity and 0.3 of the BM25 score relative to the query's best (all 0: nothing)."""
    best = F.max(bm25).over(Window.partitionBy(by))
    return 0.7 * similarity + 0.3 * bm25 / F.when(best == 0, 1.0).otherwise(best)


def context_strategy(provider: Column, model: Column, budget: int = 2000) -> Column:
    """Struct of the budget of tokens, the redundancy from which a text is skipped, and the least marginal gain."""
    name, kind = F.lower(F.trim(F.coalesce(provider, F.lit("openai")))), F.trim(F.coalesce(model, F.lit("unknown")))
    google = name == "google"
    lite, mini = google & kind.contains("gemini-2.5-flash-lite"), (name == "openai") & kind.contains("gpt-4o-mini")
    return F.struct(
        F.when(lite, max(200, int(budget * 0.88))).when(google, max(200, int(budget * 0.9))).otherwise(budget).alias("budget"),
        F.when(lite, 0.80).when(google, 0.82).when(mini, 0.85).otherwise(0.86).alias("redundancy"),
        F.when(google, 0.0009).when(mini, 0.0011).otherwise(0.0010).alias("marginal"),
    )


def citation(meta: Column) -> Column:
    """A source as it is cited; what is empty is left out."""
    part = lambda key, name: F.when(F.coalesce(meta[key], F.lit("")) != "", F.concat(F.lit(name), meta[key]))
    return F.concat_ws(
        ", ", meta["documento"], part("artigo", "Art. "), part("paragrafo", "§ "), part("inciso", "Inciso "), F.coalesce(part("titulo", "Título: "), part("capitulo", "Capítulo: ")),
        part("banca", "Banca: "), part("ano", "Ano: "),
    )


#: What is said of each confidence, and around the context.
MESSAGES = {
    "alta": "✅ [ALTA CONFIANÇA] Resposta baseada em documentos jurídicos indexados.",
    "media": "⚠️ [MÉDIA CONFIANÇA] Resposta parcialmente baseada em documentos. Verifique as fontes.",
    "baixa": "❌ [BAIXA CONFIANÇA] Informações limitadas encontradas. Recomendo verificar em fontes oficiais.",
    "sem_rag": "ℹ️ [SEM RAG] Não encontrei informações específicas na base. Resposta baseada em conhecimento geral.",
}
CONTEXT_TITLE = "CONTEXTO JURÍDICO RELEVANTE:"
INSTRUCTIONS = "\nINSTRUÇÕES:\n- Use APENAS as informações fornecidas acima para responder\n- Cite as fontes mencionadas\n- Se a informação não estiver no contexto, diga que não encontrou"


def rendered(hits: DataFrame) -> DataFrame:
    """(query_id, context) of (query_id, rank, similarity, text, tokens, meta, confidence)."""
    m, filled = F.col("meta"), lambda k: F.coalesce(F.col("meta")[k], F.lit("")) != ""
    on = lambda k: F.coalesce(F.col("meta")[k].cast("boolean"), F.lit(False))
    sign = F.when(filled("artigo"), "⚖️").when(on("marca_stf") | on("marca_stj"), "📜").when(filled("banca"), "❓").when(F.col("tokens") < 100, "📝").otherwise("📄")
    head = F.concat(F.lit("\n"), F.col("rank").cast("string"), F.lit(". "), sign, F.lit(" [Similaridade: "), F.format_string("%.2f", F.col("similarity")), F.lit("]"))
    line = F.concat_ws("\n", head, F.concat(F.lit("Fonte: "), citation(m)), F.concat(F.lit("Texto: "), F.substring("text", 1, 500), F.lit("...")))
    rows = hits.select("query_id", "confidence", F.struct("rank", line.alias("line")).alias("x"))
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    start = F.concat(F.element_at(table, F.first("confidence")), F.lit(f"\n\n{CONTEXT_TITLE}\n"))
    return rows.groupBy("query_id").agg(F.concat(start, lines, F.lit("\n" + INSTRUCTIONS)).alias("context"))
