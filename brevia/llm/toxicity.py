"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other training documents' texts are unlabelled. A logistic
classifier over hashed words and word beginnings is trained by numpy on the non-negative risk
pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)]), where pi is the class prior.

The training sample is bounded: at most max_positive confirmed and max_unlabelled other documents, those with the
smallest hashes of doc_id, each with one text (the largest, if rows share the doc_id). What the driver gathers is one list
of 32-bit features for each of them, as arrays. Scoring covers every whole text.

Defined results: a null text is scored as the empty text; a label is toxic if any of its document's label rows says
so, null labels count as none; without a positive the score is 0 everywhere; repeated rows get a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pick, small_batches

EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¿¡"
BITS = 22
REMEMBERED = 300_000


def features_of(token: str) -> tuple[int, ...]:
    """Hashes of a token's word and of the word's first 4 and 5 characters, if it is longer than these."""
    w = token.strip(EDGE)
    if not w:
        return ()
    mask = (1 << BITS) - 1
    out = [zlib.crc32(b"w" + w.encode("utf-8", "replace")) & mask]
    out += [zlib.crc32(f"{n}{w[:n]}".encode("utf-8", "replace")) & mask for n in (4, 5) if len(w) > n]
    return tuple(out)


class Features:
    """Distinct features of a text; `only` keeps those of a model."""

    def __init__(self, only: set[int] | None = None):
        self.only, self.known = only, {}

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        known, only = self.known, self.only
        for token in set(text.lower().split()):
            if (got := known.get(token)) is None:
                got = tuple(f for f in features_of(token) if only is None or f in only)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(token) <= 64:
                    known[token] = got
            if got:
                out.update(got)
        return out


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The non-negative risk of the raw scores f of both samples under the logistic loss, and its negative part
    E_U[l(-f)] - pi * E_P[l(-f)] before it is held above zero."""
    loss = lambda z: np.logaddexp(0, -z)
    negative = loss(-unlabelled).mean() - prior * loss(-positive).mean()
    return float(prior * loss(positive).mean() + max(0.0, negative)), float(negative)


class Rows:
    """Lists of features, as one array of values and one of starts."""

    def __init__(self, starts: np.ndarray, values: np.ndarray):
        self.starts, self.values = starts.astype(np.int64), values

    @classmethod
    def of(cls, lists) -> Rows:
        return cls(np.cumsum([0, *map(len, lists)]), np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in lists]]))

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each feature of these rows the position of its row, and the feature."""
        size = self.starts[rows + 1] - self.starts[rows]
        of = np.repeat(np.arange(len(rows)), size)
        first = np.cumsum(size) - size
        return of, self.values[np.arange(len(of)) - first[of] + self.starts[rows][of]]


class NnPu:
    """weights: feature -> weight; bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, features) -> float:
        z = self.bias + sum(self.weights[f] for f in features)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0

    @classmethod
    def fitted(cls, data: Rows, positive: np.ndarray, unlabelled: np.ndarray, prior: float, keep: int = 4096, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> NnPu:
        """positive, unlabelled: rows of data; a row may stand in both. Candidates are the `keep` features with the highest
        lift among the positives."""
        if not len(positive):
            return cls({}, -1e9)
        (pr, pf), (ur, uf) = data.taken(positive), data.taken(unlabelled)
        (p_ids, p_n), (u_ids, u_n) = (np.unique(x, return_counts=True) for x in (pf, uf))
        at = np.searchsorted(u_ids, p_ids).clip(0, max(0, len(u_ids) - 1))
        in_u = np.where(u_ids[at] == p_ids, u_n[at], 0) if len(u_ids) else np.zeros(len(p_ids), int)
        a, b = p_n / len(positive), in_u / max(1, len(unlabelled))
        # positives are prior of the unlabelled: what a pure feature of the positives shows there is prior * a
        rest = np.maximum(0.0, b - prior * a) / max(1e-6, 1 - prior)
        lift = a / (rest + 1 / max(1, len(unlabelled)))
        good = (p_n >= 3) & (lift >= 4)
        chosen = np.sort(p_ids[good][np.argsort(-(lift * np.sqrt(p_n))[good], kind="stable")[:keep]])
        if not len(chosen):
            return cls({}, float(np.log(prior / (1 - prior))))

        def known(rows, features):
            at = np.searchsorted(chosen, features).clip(0, len(chosen) - 1)
            held = chosen[at] == features
            return rows[held], at[held]

        (pr, pc), (ur, uc) = known(pr, pf), known(ur, uf)
        w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        np_, nu = len(positive), max(1, len(unlabelled))

        def gradient(r, c, by_row):
            return np.append(np.bincount(c, by_row[r], len(chosen)), by_row.sum())

        for t in range(1, rounds + 1):
            fp = bias + np.bincount(pr, w[pc], np_)
            fu = bias + np.bincount(ur, w[uc], nu)
            _, negative = risk(fp, fu, prior)
            g_neg = gradient(ur, uc, sigmoid(fu) / nu) - gradient(pr, pc, prior * sigmoid(fp) / np_)
            # below zero the negative part is over-fitted: step back along it instead of on
            g = gradient(pr, pc, -prior * sigmoid(-fp) / np_) + g_neg if negative >= 0 else -g_neg
            g[:-1] += decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        return cls({int(f): float(x) for f, x in zip(chosen, w, strict=True)}, float(bias))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, prior: float | None = None) -> NnPu:
    """From rows that are not held out. prior: share of toxic documents; by default that of the labelled ones."""
    own = pick(labels, doc_id="long", toxic="int").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    own = own.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    if prior is None:
        n, on = own.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first()
        prior = ((on or 0) + 1) / ((n or 0) + 2)
    prior = min(max(prior, 1e-4), 0.9)
    by = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = by(own.where("toxic").select("doc_id"), max_positive)
    ids = pick(docs, doc_id="long").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    other = by(ids.join(own.where("toxic").select("doc_id"), "doc_id", "left_anti").distinct(), max_unlabelled)
    sample = positive.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False)))

    def run(batches):
        get = Features()
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                sets = Rows.of([np.fromiter(sorted(get(t or "")), np.int32) for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(sets.starts.astype(np.int32)), pa.array(sets.values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "positive", "features"])
        give_back()

    # the sample has max_positive + max_unlabelled rows at most, so it may be broadcast
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "positive").agg(F.max("text").alias("text"))
    got = texts.select("doc_id", "text", "positive").mapInArrow(run, "doc_id long, positive boolean, features array<int>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())  # the same model whatever the order of arrival
    lists = got.column("features").combine_chunks()
    data = Rows(lists.offsets.to_numpy(), lists.values.to_numpy())
    on = got.column("positive").to_numpy()[order] if len(order) else np.zeros(0, bool)
    positive, other = order[on], order[~on]
    return NnPu.fitted(data, positive, np.concatenate([other, positive[: round(len(other) * prior / (1 - prior))]]), prior)


def score(docs: DataFrame, model: NnPu, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches):
        get = Features(set(model.weights))
        for b in batches:
            scores = []
            for start in range(0, b.num_rows, 512):
                scores += [model.score(get(t or "")) for t in b.column(1).slice(start, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
