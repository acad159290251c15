"""Latencies, rates, providers and percentiles (A5, A7, A12-A16, A19, A22, P, R2, R3, R5, W8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brevia.operators import evaluation
from brevia.plans.core import fixture, query, t


def events(spark, d):
    return t(spark, d, "events")


_RN = "s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"
_AT = lambda p: f"max(CASE WHEN i = {p} THEN value END)"


@query(f"WITH {_RN} SELECT event_type, {_AT('least(CAST(floor(n * 0.5) AS BIGINT), n - 1)')} AS p50, {_AT('least(CAST(floor(n * 0.95) AS BIGINT), n - 1)')} AS p95, {_AT('least(CAST(floor(n * 0.99) AS BIGINT), n - 1)')} AS p99 FROM s GROUP BY event_type")
def percentiles_floor_index(spark, d):
    """P floor_index."""
    return evaluation.percentiles_floor(events(spark, d), "event_type", "value", p50=0.5, p95=0.95, p99=0.99)


_PART = ("embedding", "vector_search", "rerank", "total", "generation", "e2e")
_UNP = "u AS (SELECT unnest(['embedding', 'vector_search', 'rerank', 'total', 'generation', 'e2e']) AS component, unnest([value, CASE WHEN event_id % 2 = 0 THEN value * 2 END, CASE WHEN event_id % 3 = 0 THEN value + 5 END, value * 3, CASE WHEN event_type = 'click' THEN value * 10 END, NULL]) AS ms FROM events)"


@query(
    f"WITH {_UNP}, s AS (SELECT component, ms, row_number() OVER (PARTITION BY component ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM u WHERE ms IS NOT NULL), g AS (SELECT component, max(CASE WHEN i = n // 2 THEN ms END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN ms END) AS p95, "
    "max(CASE WHEN i = CAST(floor(n * 0.99) AS BIGINT) THEN ms END) AS p99, round(avg(ms), 6) AS mean, count(*) AS n FROM s GROUP BY component) SELECT c.component, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99, coalesce(mean, 0) AS mean, coalesce(n, 0) AS n FROM (SELECT DISTINCT component FROM u) c LEFT JOIN g USING (component)"
)
def latency_by_component(spark, d):
    """A13, P floor_index_log: components unpivoted; one without values is there with zeros."""
    v = F.col("value")
    ms = (v, F.when(F.col("event_id") % 2 == 0, v * 2), F.when(F.col("event_id") % 3 == 0, v + 5), v * 3, F.when(F.col("event_type") == "click", v * 10), F.lit(None).cast("double"))
    u = events(spark, d).select(F.inline(F.array(*[F.struct(F.lit(c).alias("component"), x.alias("ms")) for c, x in zip(_PART, ms, strict=True)])))
    p = evaluation.percentiles_floor(u, "component", "ms", p50=0.5, p95=0.95, p99=0.99)
    g = u.groupBy("component").agg(F.round(F.avg("ms"), 6).alias("mean"), F.count("ms").alias("n"))
    return g.join(p, "component", "left").select("component", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99", "mean")], "n")


def _cut(i: int, parts: int) -> str:
    j = f"least(greatest({i} * (n + 1) // {parts}, 1), greatest(n - 1, 1))"
    at = lambda k: f"list_extract(v, CAST({j} + {k} AS BIGINT))"
    return f"CASE WHEN n < 2 THEN 0.0 ELSE ({at(0)} * ({parts} - ({i} * (n + 1) - {j} * {parts})) + {at(1)} * ({i} * (n + 1) - {j} * {parts})) / {parts} END"


_LISTS = "l AS (SELECT user_id, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id)"


@query(f"WITH {_LISTS} SELECT user_id, n, round({_cut(50, 100)}, 6) AS p50, round({_cut(95, 100)}, 6) AS p95, round({_cut(99, 100)}, 6) AS p99 FROM l")
def percentiles_exclusive(spark, d):
    """P exclusive: of each user's few values."""
    p = evaluation.percentiles_exclusive(events(spark, d), "user_id", "value", p50=50, p95=95, p99=99)
    return p.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(f"WITH {_LISTS} SELECT user_id, round(CASE WHEN n >= 20 THEN {_cut(19, 20)} ELSE v[-1] END, 6) AS p95 FROM l")
def percentile_or_max(spark, d):
    """P p95_or_max: the largest of fewer than twenty values."""
    p = evaluation.percentiles_exclusive(events(spark, d), "user_id", "value", 20, p95=19)
    most = events(spark, d).where("value IS NOT NULL").groupBy("user_id").agg(F.max("value").alias("most"))
    return p.join(most, "user_id").select("user_id", F.round(F.when(F.col("n") >= 20, F.col("p95")).otherwise(F.col("most")), 6).alias("p95"))


_OK = "event_type <> 'error'"


@query(f"WITH l AS (SELECT list(value ORDER BY value) AS v, count(value) AS n FROM events) SELECT round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(100.0 * count(*) FILTER ({_OK}) / count(*), 4) AS success_rate, round((SELECT CASE WHEN n >= 20 THEN {_cut(19, 20)} ELSE v[-1] END FROM l), 6) AS p95 FROM events")
def latency_summary(spark, d):
    """A5."""
    e = events(spark, d).withColumn("one", F.lit(1))
    p = evaluation.percentiles_exclusive(e, "one", "value", 20, p95=19)
    g = e.groupBy("one").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 4).alias("success_rate"), F.max("value").alias("most"))
    return g.join(p, "one").select("mean", "total", "success_rate", F.round(F.when(F.col("n") >= 20, F.col("p95")).otherwise(F.col("most")), 6).alias("p95"))


@query("WITH g AS (SELECT event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1) SELECT round(sum(n) / sum(s), 6) AS throughput, round(max(CASE WHEN event_type = 'view' THEN s / n END) / max(CASE WHEN event_type = 'click' THEN s / n END), 6) AS ratio FROM g")
def operation_throughput(spark, d):
    """Operations for each unit of time, and the mean time of one kind against another's."""
    g = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    mean = lambda k: F.max(F.when(F.col("event_type") == k, F.col("s") / F.col("n")))
    return g.agg(F.round(F.sum("n") / F.sum("s"), 6).alias("throughput"), F.round(mean("view") / mean("click"), 6).alias("ratio"))


_MSG = "CASE WHEN event_id % 13 = 0 THEN 'Request Timeout' WHEN event_id % 17 = 0 THEN 'rate limit hit' WHEN event_id % 19 = 0 THEN 'Database locked' WHEN event_id % 23 = 0 THEN 'boom' END"
_BUCKET = "CASE WHEN contains(lower(m), 'timeout') THEN 'timeout' WHEN contains(lower(m), 'rate') THEN 'rate_limit' WHEN contains(lower(m), 'database') THEN 'database' ELSE 'other' END"
_SIM = "(event_id % 100) / 100.0"


@query(
    f"WITH e AS (SELECT *, {_MSG} AS m, {_SIM} AS s FROM events), l AS (SELECT list(value ORDER BY value) AS v, count(value) AS n FROM e WHERE m IS NULL) SELECT count(*) AS requests, count(*) FILTER (m IS NULL) AS successes, round(avg(value) FILTER (m IS NULL), 6) AS mean_ms, min(value) FILTER (m IS NULL) AS least_ms, max(value) FILTER (m IS NULL) AS most_ms, "
    "(SELECT v[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] FROM l) AS p95_ms, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS qps, round(avg(s) FILTER (s > 0), 6)::DOUBLE AS mean_similarity, "
    f"count(*) FILTER (m IS NOT NULL AND {_BUCKET} = 'timeout') AS timeouts, count(*) FILTER (m IS NOT NULL AND {_BUCKET} = 'rate_limit') AS limited, count(*) FILTER (m IS NOT NULL AND {_BUCKET} = 'database') AS database, count(*) FILTER (m IS NOT NULL AND {_BUCKET} = 'other') AS other FROM e"
)
def load_summary(spark, d):
    """A load run in one aggregation: latencies of successes, requests a second, similarity, errors by what they say."""
    i = F.col("event_id")
    m = F.when(i % 13 == 0, "Request Timeout").when(i % 17 == 0, "rate limit hit").when(i % 19 == 0, "Database locked").when(i % 23 == 0, "boom")
    e = events(spark, d).withColumn("m", m).withColumn("s", (i % 100) / 100).withColumn("one", F.lit(1))
    good, low = F.col("m").isNull(), F.lower("m")
    kind = F.when(low.contains("timeout"), "timeout").when(low.contains("rate"), "rate_limit").when(low.contains("database"), "database").when(~good, "other")
    v = F.when(good, F.col("value"))
    g = e.groupBy("one").agg(
        F.count("*").alias("requests"), F.count_if(good).alias("successes"), F.round(F.avg(v), 6).alias("mean_ms"), F.min(v).alias("least_ms"), F.max(v).alias("most_ms"),
        F.round(F.count("*") / (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) * 1e6, 9).alias("qps"), F.round(F.avg(F.when(F.col("s") > 0, F.col("s"))), 6).alias("mean_similarity"),
        *[F.count_if(F.coalesce(kind == k, F.lit(False))).alias(n) for k, n in (("timeout", "timeouts"), ("rate_limit", "limited"), ("database", "database"), ("other", "other"))],
    )
    p = evaluation.percentiles_floor(e.where(good), "one", "value", p95_ms=0.95)
    return g.join(p, "one").drop("one")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), s AS (SELECT user_id, rn, 1.0::DOUBLE AS tokens, t AS last, NULL::DOUBLE AS until FROM e WHERE rn = 1 UNION ALL SELECT user_id, rn, CASE WHEN limited THEN tokens WHEN filled >= 1 THEN filled - 1 ELSE filled END, "
    "CASE WHEN limited THEN last ELSE t END, CASE WHEN limited OR filled >= 1 THEN until ELSE t + (1 - filled) / (2 / 86400.0::DOUBLE) END FROM (SELECT e.user_id, e.rn, e.t, s.tokens, s.last, s.until, coalesce(e.t < s.until, false) AS limited, least(2.0::DOUBLE, s.tokens + (e.t - s.last) * (2 / 86400.0::DOUBLE)) AS filled FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)), "
    "d AS (SELECT s.user_id, s.rn, s.until IS NOT DISTINCT FROM lag(s.until) OVER (PARTITION BY s.user_id ORDER BY s.rn) AS same FROM s) SELECT count(*) AS tracked, count(*) FILTER (until > (SELECT max(t) FROM e)) AS limited FROM (SELECT user_id, arg_max(until, rn) AS until FROM s GROUP BY user_id)"
)
def rate_limit_stats(spark, d):
    """Users that the limiter knows, and those that are refused at the end of the events: their last refusal reaches beyond it."""
    from brevia.streaming import keyed
    from brevia.streaming.token_bucket import TokenBucket

    class Until(TokenBucket):
        """Says until when requests are refused."""

        says = (("until", "double"), ("at", "double"))

        def step(self, state, at, ok=True):
            state, _ = super().step(state, at, ok)
            return state, (state[2], at)

    said = keyed.decide(events(spark, d), "user_id", Until(2, 2 / 86400))
    last = said.groupBy("user_id").agg(F.max_by("until", F.struct("at", "event_id")).alias("until"))
    end = events(spark, d).agg(keyed.seconds(F.max("ts")).alias("end"))
    return last.crossJoin(F.broadcast(end)).agg(F.count("*").alias("tracked"), F.count_if(F.coalesce(F.col("until") > F.col("end"), F.lit(False))).alias("limited"))  # one row


_P = "p AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'google' END AS provider, *, value < 90 AS ok FROM events)"


@query(f"WITH {_P} SELECT provider, count(*) AS calls, round(count(*) FILTER (ok) / count(*), 6) AS success_rate, round(avg(value) FILTER (ok), 6) AS mean_ms, strftime(max(ts) FILTER (ok), '%Y-%m-%d %H:%M:%S') AS last_success, strftime(max(ts) FILTER (NOT ok), '%Y-%m-%d %H:%M:%S') AS last_failure, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC) FILTER (NOT ok)[1:10], ',') AS last_errors FROM p GROUP BY provider")
def provider_stats(spark, d):
    """Rates, latencies and the last ten errors of each provider; an error list never holds more than ten."""
    e = events(spark, d).withColumn("provider", F.when(F.col("user_id") % 2 == 0, "openai").otherwise("google")).withColumn("ok", F.col("value") < 90)
    at = lambda c: F.date_format(F.max(F.when(c, F.col("ts"))), "yyyy-MM-dd HH:mm:ss")
    order = Window.partitionBy("provider").orderBy(F.desc("ts"), F.desc("event_id"))
    bad = e.where("NOT ok").withColumn("r", F.row_number().over(order)).where("r <= 10").groupBy("provider").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("last_errors"))
    g = e.groupBy("provider").agg(F.count("*").alias("calls"), F.round(F.count_if("ok") / F.count("*"), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("ok"), F.col("value"))), 6).alias("mean_ms"), at(F.col("ok")).alias("last_success"), at(~F.col("ok")).alias("last_failure"))
    return g.join(bad, "provider", "left")


@query("WITH l AS (SELECT ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) SELECT count(*) FILTER (gap <= INTERVAL 1 DAY) AS hits, count(*) - count(*) FILTER (gap <= INTERVAL 1 DAY) AS misses, round(count(*) FILTER (gap <= INTERVAL 1 DAY) / count(*), 6) AS hit_rate FROM l")
def cache_stats(spark, d):
    """Hits and misses of a cache whose entries live for a day, and their rate (0 without requests)."""
    p = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = events(spark, d).select(F.coalesce(F.col("ts") - p <= F.expr("INTERVAL 1 DAY"), F.lit(False)).alias("hit"))
    g = e.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return g.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)), 6))


PRICES = [("openai", "small", 0.02), ("openai", "large", 0.13), ("google", "small", 0.0)]


@query("WITH p(provider, model, price) AS (VALUES ('openai', 'small', 0.02::DOUBLE), ('openai', 'large', 0.13), ('google', 'small', 0.0)), u AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'google' ELSE 'openai' END AS provider, CASE WHEN doc_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, n_chars // 4 AS k FROM documents) SELECT provider, model, CAST(sum(k) AS BIGINT) AS tokens, round(sum(k) * coalesce(any_value(price), 0) / 1e6, 9) AS usd FROM u LEFT JOIN p USING (provider, model) GROUP BY ALL")
def token_costs(spark, d):
    """Tokens times the price of their provider's model; a model without a price costs nothing."""
    i = F.col("doc_id")
    u = t(spark, d, "documents").select(F.when(i % 3 == 0, "google").otherwise("openai").alias("provider"), F.when(i % 2 == 0, "small").otherwise("large").alias("model"), F.floor(F.col("n_chars") / 4).alias("k"))
    g = u.groupBy("provider", "model").agg(F.sum("k").alias("tokens"))
    p = fixture(spark, PRICES, "provider string, model string, price double")
    return g.join(F.broadcast(p), ["provider", "model"], "left").select("provider", "model", "tokens", F.round(F.col("tokens") * F.coalesce("price", F.lit(0.0)) / 1e6, 9).alias("usd"))


@query("SELECT source, sum((contains(lower(text), 'the'))::INT)::BIGINT AS the, sum((n_chars > 1000)::INT)::BIGINT AS long, sum((json_extract_string('{\"m\": ' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || '}', '$.m') = 'true')::INT)::BIGINT AS marked FROM documents GROUP BY source")
def marker_sums(spark, d):
    """Sums of marks, one of them out of JSON."""
    said = F.concat(F.lit('{"m": '), F.when(F.col("doc_id") % 3 == 0, "true").otherwise("false"), F.lit("}"))
    n = lambda c: F.sum(c.cast("int"))
    return t(spark, d, "documents").groupBy("source").agg(n(F.lower("text").contains("the")).alias("the"), n(F.col("n_chars") > 1000).alias("long"), n(F.get_json_object(said, "$.m").cast("boolean")).alias("marked"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value) FILTER (i > n - n // 4) / avg(value) FILTER (i <= n // 4), 6) AS degradation FROM r GROUP BY event_type")
def degradation(spark, d):
    """The mean of the last quarter over that of the first, by time. Two positions of the times say where the quarters end, so
    no task orders all events of a type."""
    e = events(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    quarter = F.floor(F.col("n") / 4)
    ends = evaluation.at_positions(e, "event_type", "at", {"first": quarter - 1, "last": F.col("n") - quarter}).groupBy("event_type").pivot("name", ["first", "last"]).agg(F.first("found"))
    j = e.join(ends, "event_type")  # a row for each type: Spark broadcasts it where it is small
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    return j.groupBy("event_type").agg(F.round(mean(F.col("at") >= F.col("last")) / mean(F.col("at") <= F.col("first")), 6).alias("degradation"))


@query("WITH h AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, CASE WHEN user_id % 4 = 0 THEN list_extract(['a', 'c'], CAST(i % 2 + 1 AS INT)) WHEN user_id % 4 = 1 THEN 'b' WHEN user_id % 4 = 2 THEN list_extract(['a', 'b', 'c'], CAST(i % 3 + 1 AS INT)) END AS provider FROM h")
def round_robin(spark, d):
    """Each user's calls go round among the providers that are healthy for them; without one there is none."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.col("user_id") % 4
    healthy = F.when(kind == 0, F.array(F.lit("a"), F.lit("c"))).when(kind == 1, F.array(F.lit("b"))).when(kind == 2, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    e = events(spark, d).select("event_id", i.alias("i"), healthy.alias("h"))
    return e.select("event_id", F.when(F.size("h") > 0, F.get("h", (F.col("i") % F.size("h")).cast("int"))).alias("provider"))


@query("SELECT event_id, least(1 + (event_id % 5), 3) AS attempts, event_id % 5 < 3 AS ok, CAST(CASE least(event_id % 5, 2) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS INT) AS waited FROM events")
def retries(spark, d):
    """Three attempts at most, waits of 1 and 2 seconds between; a call fails as often at first as its id says."""
    bad = F.col("event_id") % 5
    return events(spark, d).select("event_id", F.least(bad + 1, F.lit(3)).cast("long").alias("attempts"), (bad < 3).alias("ok"), F.when(bad == 0, 0).when(bad == 1, 1).otherwise(3).alias("waited"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 300 SECOND THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, sum(fresh)::BIGINT AS states FROM g GROUP BY user_id")
def stale_keys(spark, d):
    """R2: how often a user's state is made anew, when it is forgotten after 300 seconds without a request."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(spark, d).select("user_id", F.when(gap <= F.expr("INTERVAL 300 SECOND"), 0).otherwise(1).alias("fresh"))
    return e.groupBy("user_id").agg(F.sum("fresh").alias("states"))


@query()
def limiter_resets(spark, d):
    """R2: the limiter over all events, with resets of single users, one of all users, new limits from a time on, and states that are
    forgotten after two days without a request."""
    from brevia.streaming import keyed
    from brevia.streaming.token_bucket import TokenBucket

    e = events(spark, d)
    begin, end = e.agg(keyed.seconds(F.min("ts")), keyed.seconds(F.max("ts"))).first()
    at = lambda share: begin + (end - begin) * share
    first, later = TokenBucket(2, 2 / 86400), TokenBucket(1, 1 / 86400)
    resets = e.where("event_id % 97 = 0").select("user_id", "ts")
    return keyed.decide(e, "user_id", first, resets=resets, changes=((at(0.4), first), (at(0.7), later)), idle=2 * 86400.0)
