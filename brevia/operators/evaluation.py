"""Integrated evaluation: metrics by kind of case and overall, service levels, and deltas between two variants."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.storage import kept

#: Metric, whether more is better, limit.
LEVELS = (
    ("recall_at_5", True, 0.80),
    ("citation", True, 0.70),
    ("coverage", True, 0.60),
    ("p95_latency_s", False, 0.80),
    ("mean_cost_usd", False, 0.010),
    ("timeout_rate", False, 0.02),
    ("error_rate", False, 0.02),
)
OVERALL = "overall"
#: Metrics that are compared between variants, and those in which a better variant is no worse (more is better?).
COMPARED = (*[name for name, _, _ in LEVELS], "no_basis")
DOMINANCE = {"recall_at_5": True, "citation": True, "coverage": True, "no_basis": False, "timeout_rate": False, "error_rate": False}


def integrated_metrics(results: DataFrame, *by: str) -> DataFrame:
    """For each of `by` and each kind of case (column tipo), and for all kinds together (tipo 'overall').
    results: by, tipo, recall_at_5, citation, coverage, no_basis, latency_s, cost_usd, timeout, error."""
    measured = [
        F.count("*").alias("n_cases"),
        *[F.avg(c).alias(c) for c in ("recall_at_5", "citation", "coverage", "no_basis")],
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_s)").alias("p95_latency_s"),
        F.avg("cost_usd").alias("mean_cost_usd"),
        F.avg(F.col("timeout").cast("double")).alias("timeout_rate"),
        F.avg(F.col("error").cast("double")).alias("error_rate"),
    ]
    keys = [F.col(c) for c in by]
    sets = [[*keys, F.col("tipo")], keys]
    return results.groupingSets(sets, *keys, F.col("tipo")).agg(*measured).withColumn("tipo", F.coalesce("tipo", F.lit(OVERALL)))


def meets(metric: str) -> Column:
    """A10: whether a metric is within its limit."""
    more, limit = next((m, x) for name, m, x in LEVELS if name == metric)
    return F.col(metric) >= limit if more else F.col(metric) <= limit


def service_levels(metrics: DataFrame) -> DataFrame:
    """A10: a boolean <metric>_ok for each level, and all_pass."""
    flags = {f"{name}_ok": meets(name) for name, _, _ in LEVELS}
    return metrics.withColumns(flags | {"all_pass": reduce(and_, flags.values())})


def deltas(metrics: DataFrame, base: str, candidate: str, variant: str = "variant") -> DataFrame:
    """For each tipo the candidate's metrics less the base's, and whether it is worse in none that counts (dominates).
    One aggregation by tipo: no join of the variants."""
    at = lambda name, which: F.max(F.when(F.col(variant) == which, F.col(name)))
    changed = metrics.groupBy("tipo").agg(*[(at(name, candidate) - at(name, base)).alias(f"{name}_delta") for name in COMPARED])
    none_worse = [F.col(f"{name}_delta") >= 0 if more else F.col(f"{name}_delta") <= 0 for name, more in DOMINANCE.items()]
    return changed.withColumn("dominates", reduce(and_, none_worse))


#: How an answer says that it has no basis; dollars for a thousand tokens asked and answered.
NO_BASIS = (
    "sem base", "não encontrei base", "nao encontrei base", "não há base", "nao ha base", "não tenho base", "nao tenho base", "não há informação suficiente", "nao ha informação suficiente",
    "não consta nos documentos", "nao consta nos documentos",
)
ASKED_USD, ANSWERED_USD = 0.00015, 0.00060


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def no_basis(answer: Column) -> Column:
    """E16."""
    out = F.lit(False)
    for phrase in NO_BASIS:
        out = out | _plain(answer).contains(phrase)
    return out


def mentions_article(answer: Column, article: Column) -> Column:
    """Whether an answer names the article; any does where none is asked for."""
    name = F.regexp_replace(article, r"([^\w])", r"\\$1")
    return F.when(F.coalesce(article, F.lit("")) == "", True).otherwise(F.regexp_like(answer, F.concat(F.lit(r"(?iU)\b(?:art\.?|artigo)\s*"), name, F.lit(r"\b"))))


def cites(kind: Column, answer: Column, document: Column, article: Column) -> Column:
    """Whether an answer cites what its kind of question asks for."""
    low = _plain(answer)
    has = lambda *words: reduce(lambda a, w: a | low.contains(w), words, F.lit(False))
    by_kind = F.when(kind == "artigo", mentions_article(answer, article)).when(kind == "jurisprudencia", has("stf", "stj", "tribunal")).when(kind == "concurso", has("banca", "questão", "questao", "concurso")).otherwise(True)
    named = F.when(F.coalesce(document, F.lit("")) == "", True).otherwise(F.contains(low, _plain(document)))
    return (F.trim(answer) != "") & named & by_kind


def coverage(answer: Column, keywords: Column, article: Column) -> Column:
    """The share of keywords, and of the article, that an answer holds."""
    low, none = _plain(answer), F.array().cast("array<string>")
    terms = F.concat(F.filter(keywords, lambda w: w != ""), F.when(F.coalesce(article, F.lit("")) == "", none).otherwise(F.array(F.concat(F.lit("art "), article))))
    met = F.size(F.filter(terms, lambda w: F.contains(low, _plain(w))))
    return F.when(F.size(terms) == 0, (low != "").cast("double")).otherwise(met / F.size(terms))


def cost_usd(question: Column, answer: Column, context_tokens: int = 0) -> Column:
    """EV3: four characters are a token."""
    tokens = lambda x: F.greatest(F.lit(1), F.ceil(F.length(x) / 4))
    return (tokens(question) + max(context_tokens, 0)) / 1000 * ASKED_USD + tokens(answer) / 1000 * ANSWERED_USD


def answer_metrics(context_tokens: int = 0) -> Column:
    """EV3 over the columns tipo, question, doc, article, keywords (joined by |), answer, seconds, timeout, error."""
    lost = F.col("timeout") | F.col("error")
    zero = lambda x: F.when(lost, 0.0).otherwise(x)
    a, art = F.col("answer"), F.col("article")
    return F.struct(
        zero(F.coalesce(cites(F.col("tipo"), a, F.col("doc"), art), F.lit(False)).cast("double")).alias("citation"), F.round(zero(coverage(a, F.split("keywords", r"\|"), art)), 6).alias("coverage"),
        zero(no_basis(a).cast("double")).alias("no_basis"), F.round(zero(cost_usd(F.col("question"), a, context_tokens)), 9).alias("cost_usd"), F.greatest("seconds", F.lit(0.0)).alias("latency_s"),
    )


def relevant(kind: Column, meta: Column, text: Column, document: Column, article: Column, keywords: Column) -> Column:
    """EV1: whether a hit answers a case: its document, all keywords, and what its kind asks for (the article, a court's mark, an
    examination's)."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    on = lambda k: F.coalesce(meta[k].cast("boolean"), F.lit(False))
    named = ~filled(document) | F.contains(_plain(meta["documento"]), _plain(document))
    words = F.forall(keywords, lambda w: F.contains(_plain(text), _plain(w)))
    by_kind = F.when(kind == "artigo", filled(meta["artigo"]) & (~filled(article) | (_plain(meta["artigo"]) == _plain(article)))).when(kind == "jurisprudencia", on("marca_stf") | on("marca_stj"))
    return named & words & by_kind.when(kind == "concurso", filled(meta["banca"]) | filled(meta["ano"]) | on("marca_concurso")).otherwise(True)


#: Ranges that one look divides a range into, and distinct values that one task puts in order.
BUCKETS, MOST_VALUES = 4096, 100_000


def _size(v: Column) -> Column:
    return F.least(F.log2(F.abs(v)), F.lit(1025.0))  # beyond all numbers: infinity


def _magnitude(v: Column, least: Column) -> Column:
    """Rises with v, evenly over orders of magnitude; least: the smallest size of a value other than 0."""
    size = _size(v) - least + 1
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def at_positions(rows: DataFrame, key: str, value: str, positions: dict[str, Column]) -> DataFrame:
    """(key, name, found): for each key the value at a position (from 0) of its values in order; positions are columns over n,
    the number of the key's values. No task orders all values of a key: equal values are counted together, a histogram
    of BUCKETS ranges says in which range a position falls, and only these ranges are put in order. The first ranges are even
    in magnitude, so that an outlier doesn't push all others into one; a range of more than MOST_VALUES distinct values is
    looked at again as BUCKETS even ones, until none is."""
    counts = kept(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "counts")
    n = counts.groupBy("k").agg(F.sum("c").alias("n"))
    asked = n.select("k", F.inline(F.array(*[F.struct(F.lit(x).alias("name"), p.cast("long").alias("pos")) for x, p in positions.items()])))
    asked, values, on = asked.withColumns({"r": F.lit(0).cast("long"), "first": F.lit(0).cast("long")}), counts.withColumn("r", F.lit(0).cast("long")), lambda v: _magnitude(v, F.col("least"))
    values = values.join(counts.groupBy("k").agg(F.min(F.when(F.col("v") != 0, _size(F.col("v")))).alias("least")), "k")
    while True:
        limits = values.groupBy("k", "r").agg(F.min(on(F.col("v"))).alias("lo"), F.max(on(F.col("v"))).alias("hi"))
        share = F.when(F.col("hi") > F.col("lo"), (on(F.col("v")) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        placed = values.join(limits, ["k", "r"]).withColumn("b", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
        before = Window.partitionBy("k", "r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        ranges = placed.groupBy("k", "r", "b").agg(F.sum("c").alias("held"), F.count("*").alias("distinct")).withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))  # BUCKETS rows a key at most
        hit = ranges.join(asked, ["k", "r"]).withColumn("at", F.col("pos") - F.col("first")).where("at >= below AND at < below + held")
        inner = (F.col("r") * BUCKETS + F.col("b")).alias("inner")
        hit = kept(hit.select("k", "r", "b", inner, "name", "pos", (F.col("first") + F.col("below")).alias("first"), "distinct"), "ranges")
        values = placed.select("k", "v", "c", "r", "b").join(hit.select("k", "r", "b", "inner").distinct(), ["k", "r", "b"]).select("k", "v", "c", F.col("inner").alias("r"))
        asked, on = hit.select("k", "name", "pos", F.col("inner").alias("r"), "first"), lambda v: v
        if (hit.agg(F.max("distinct")).first()[0] or 0) <= MOST_VALUES:
            break
        values = kept(values, "values")
        # ranges get new numbers, so that these don't grow from look to look
        numbers = asked.select("k", "r").distinct().withColumn("number", F.row_number().over(Window.partitionBy("k").orderBy("r")).cast("long"))  # a row for each position at most
        asked, values = (df.join(numbers, ["k", "r"]).drop("r").withColumnRenamed("number", "r") for df in (asked, values))
    inside = Window.partitionBy("k", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = values.select("k", "r", "v", "c", F.sum("c").over(inside).alias("upto"))
    found = ordered.join(asked, ["k", "r"]).where("pos - first >= upto - c AND pos - first < upto")
    return found.select(F.col("k").alias(key), "name", F.col("v").alias("found"))


def percentiles_floor(rows: DataFrame, key: str, value: str, **shares: float) -> DataFrame:
    """P floor_index: sorted[min(int(p * n), n - 1)], a column for each share."""
    at = {n: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for n, p in shares.items()}
    return at_positions(rows, key, value, at).groupBy(key).pivot("name", list(shares)).agg(F.first("found"))


def percentiles_exclusive(rows: DataFrame, key: str, value: str, parts: int = 100, **cuts: int) -> DataFrame:
    """P exclusive: the cut points of `parts` equal parts: between the values at j - 1 and j, where j is i * (n + 1) // parts within
    1 and n - 1; 0 with fewer than two values."""
    n = F.col("n")
    j = {name: F.least(F.greatest(F.floor(i * (n + 1) / parts), F.lit(1)), F.greatest(n - 1, F.lit(1))) for name, i in cuts.items()}
    at = {f"{name}{side}": j[name] - 1 + side for name in cuts for side in (0, 1)}
    wide = at_positions(rows, key, value, at).groupBy(key).pivot("name", list(at)).agg(F.first("found"))
    size = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    df = size.join(wide, key, "left")
    told = {}
    for name, i in cuts.items():
        delta = i * (n + 1) - j[name] * parts
        told[name] = F.when(n < 2, 0.0).otherwise((F.col(f"{name}0") * (parts - delta) + F.col(f"{name}1") * delta) / parts)
    return df.select(key, "n", *[c.alias(name) for name, c in told.items()])
