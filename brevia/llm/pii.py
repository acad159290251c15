"""Personal data by weak supervision.

Base spans come from four fixed patterns. Further candidates (obfuscated addresses, numbers without a plus, dotted
cards, IPv6, values assigned to a token, key or password) are voted on by three labelers: a pattern, a gazetteer and a context labeler, each +1, 0 or -1. The
gazetteer knows a few fixed keys (top-level domains, first digits of cards) and learns others from the corpus: those
that at least LEAST base spans have (endings of addresses, first four digits of cards, area codes).
Expectation-maximisation over the counts of all vote patterns estimates each labeler's reliabilities. Its posteriors
train a logistic span classifier over the votes and over hashed features of the span's shape and the words around it;
its probability alone decides about the candidates. Base spans stay whatever it says.

Counts of votes and keys are over all rows. What the driver gathers is bounded by parameters: one count for each vote
pattern (5 kinds * 2 * 27 at most), the GAZETTEER most frequent keys, and FIT spans, those with the smallest hashes, on
which the classifier's weights are fitted.

Defined results: a null text is empty; spans are code points, end exclusive; every row gives one row, repeated ones
too; an empty table gives no rows (and an untrained classifier that adds nothing); other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, pick, small_batches

#: Base spans with a key from which the gazetteer knows it; its size; spans that the classifier is fitted on.
LEAST, GAZETTEER, FIT = 2, 5000, 5000
#: Hashed features of a span and its surroundings.
HASHED = 256
KINDS = ("email", "ip", "card", "phone")
#: Kinds without base spans beside them: credentials that are assigned to a name. They are counted and masked, and not told among
#: the spans of the four kinds.
EVERY_KIND = (*KINDS, "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins: the look-behind spares trying each digit of a long run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kind, pattern of further candidates.
LOOSE = (
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])")),
    ("phone", re.compile(r"(?<![0-9+.\-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.\-])")),
    ("secret", re.compile(r"\b(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{8,200})", re.I)),
)
#: A group of an IPv6 address that key prints and hardware addresses don't have.
LONG_GROUP = re.compile(r"[0-9A-Fa-f]{3}")
#: Top-level domains and words that the gazetteer and the context labelers know.
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "from"),
    "card": ("card", "visa", "mastercard", "credit", "paid"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "whatsapp"),
    "secret": ("token", "secret", "passwd", "password", "pwd", "key", "api-key", "access-key", "auth-key"),
}
AGAINST = ("order", "invoice", "version", "isbn", "item", "part", "sku", "id", "no")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start; leftmost, not overlapping within a kind, failing matches dropped."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        local = len(text[free:at]) - len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        free = m.end() if m else at + 1
        if m:
            out.append(("email", at - local, m.end()))
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _before(text: str, start: int) -> set[str]:
    return set(re.findall(r"[a-z-]+", text[max(0, start - 40) : start].lower())[-4:])


def _well_formed(kind: str, span: str) -> bool:
    """Whether a further candidate's brackets pair up."""
    if kind == "email":
        return all(x + y in ("[]", "()") for x, y in re.findall(r"([\[(]) ?(?:at|dot) ?([\])])", span, re.I))
    return ("(" in span) == (")" in span)


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, int, int]:
    """Of the pattern, the gazetteer and the context labeler."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    before = _before(text, start)
    context = 1 if before & set(CONTEXT[kind]) else -1 if before & set(AGAINST) else 0
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", span.rstrip(")] "))[-1].lower()
        return (1 if base or _well_formed(kind, span) else -1), (1 if last in ENDINGS else -1), context
    if kind == "ip":
        return 1, (-1 if re.fullmatch("[0:.]*", span) else 1 if base or LONG_GROUP.search(span) else 0), context
    if kind == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        return (1 if mixed else -1), (1 if len(span) >= 16 else 0 if len(span) >= 12 else -1), context
    if kind == "card":
        return (1 if luhn(digits) else -1), (1 if digits[:1] in ("3", "4", "5", "6") else -1), context
    return (1 if base or _well_formed(kind, span) else -1), (1 if base or digits[:1] not in ("0", "1") else -1), context


def gazetteer_key(kind: str, span: str) -> str:
    """What the gazetteer looks up: a domain's last label, a card's first four digits, an area code; else nothing."""
    if kind == "email":
        return re.split(r"[^A-Za-z0-9]+", span.rstrip(")] "))[-1].lower()[:20]
    digits = re.sub(r"[^0-9]", "", span)
    return digits[:4] if kind == "card" else digits[-10:-7] if kind == "phone" and len(digits) >= 10 else ""


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashes of the span's shape and of the words around it."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "0", span)))[:40]
    words = [f"-{w}" for w in sorted(_before(text, start))] + [f"+{w}" for w in re.findall(r"[a-z-]+", text[end : end + 30].lower())[:2]]
    names = [f"shape {shape}", f"length {len(span).bit_length()}", f"digits {sum(c in '0123456789' for c in span)}", *words]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "replace")) % HASHED for x in names})


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose matches that touch no base span and no earlier loose match."""
    starts, ends = [], []  # what is taken: sorted, not overlapping
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    out = []
    digits = re.search(r"[0-9]{3}", text) is not None
    lowered = None
    for kind, pattern in LOOSE:
        if kind == "email":
            lowered = text.lower() if lowered is None else lowered
            if "dot" not in lowered or not re.search(r"[\[(] ?at ?[\])]", lowered):
                continue
        elif kind == "ip":
            if text.count(":") < 7:
                continue
        elif kind == "secret":
            lowered = text.lower() if lowered is None else lowered
            if not any(w in lowered for w in ("token", "secret", "passw", "pwd", "key")):
                continue
            out += [(kind, *m.span(1)) for m in pattern.finditer(text)]  # whole, whatever looks like a number in it
            continue
        elif not digits:
            continue
        for m in pattern.finditer(text):
            k = bisect.bisect_left(ends, m.start() + 1)  # the first taken span that ends behind the match's start
            if k == len(starts) or starts[k] >= m.end():
                starts.insert(k, m.start()), ends.insert(k, m.end())
                out.append((kind, m.start(), m.end()))
    return out


FIELDS = [("kind", "string"), ("base", "boolean"), ("start", "int"), ("end", "int"), ("v1", "int"), ("v2", "int"), ("v3", "int"), ("key", "string"), ("f", "array<int>")]
SPANS = f"array<struct<{','.join(f'{n}:{t}' for n, t in FIELDS)}>>"
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
SPAN = pa.struct([(n, ARROW[t]) for n, t in FIELDS])


def spans_of(text: str) -> list[tuple]:
    """All base spans and further candidates of a text, with their votes, key and features, as FIELDS names them."""
    base = base_spans(text)
    both = [(True, x) for x in base] + [(False, x) for x in candidates(text, base)]
    return [(k, on, s, e, *votes(text, k, s, e, on), gazetteer_key(k, text[s:e]), features(text, k, s, e)) for on, (k, s, e) in both]


def find_spans(docs: DataFrame, name: str, *keep: str) -> DataFrame:
    """The columns `keep` of docs, with its texts' spans as the column `name`. docs has a column text."""
    at = docs.columns.index("text")
    kept = [docs.columns.index(c) for c in keep]

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [[dict(zip([n for n, _ in FIELDS], x, strict=True)) for x in spans_of(t or "")] for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(found, pa.list_(SPAN))], [*keep, name])
        give_back()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[k] for k in kept)]
    return docs.mapInArrow(run, ", ".join([*kinds, f"`{name}` {SPANS}"]))


def expectation_maximisation(counts: dict[tuple[int, ...], float], anchored: dict[tuple[int, ...], float], rounds: int = 50):
    """Reliabilities of three labelers from counts of their vote patterns: P(vote | class) for the classes 0 and 1.
    anchored: counts of patterns that are known to be class 1. Returns (prior, rates[labeler][class][vote + 1])."""
    start = rates = np.array([[[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]]] * 3)
    prior = 0.5

    def posterior(v):
        # a labeler is never worse than chance, and says nothing where it abstains
        odds = [np.log(rates[k][1][v[k] + 1] / rates[k][0][v[k] + 1]) for k in range(3)]
        total = np.log(prior / (1 - prior)) + sum(max(x, 0.0) if y > 0 else min(x, 0.0) if y < 0 else 0.0 for x, y in zip(odds, v, strict=True))
        return 1 / (1 + np.exp(-total))

    for _ in range(rounds):
        soft = [(v, n, posterior(v)) for v, n in counts.items()] + [(v, n, 1.0) for v, n in anchored.items()]
        total = sum(n for _, n, _ in soft)
        if not total:
            break
        new = start * (10 + total)  # the first rates count as much as the data: else a labeler that always says yes carries all
        for v, n, p in soft:
            for k in range(3):
                new[k][1][v[k] + 1] += n * p
                new[k][0][v[k] + 1] += n * (1 - p)
        rates = new / new.sum(axis=2, keepdims=True)
        # base spans say nothing about how many of the further candidates hold
        n_free = sum(counts.values())
        prior = (sum(n * p for v, n, p in soft[: len(counts)]) + n_free / 2 + 1) / (2 * n_free + 2)
    return prior, rates, posterior


class SpanClassifier:
    """Logistic regression over one-hot kinds and votes and over hashed features of a span and its surroundings, fitted to
    the posteriors of expectation-maximisation. known: the (kind, key) of the learnt gazetteer."""

    VOTES = 1 + len(EVERY_KIND) + 9

    def __init__(self, weights: np.ndarray | None = None, known: frozenset = frozenset(), threshold: float = 0.9):
        self.weights, self.known, self.threshold = weights, known, threshold

    @classmethod
    def row(cls, kind: str, v, hashed=()) -> np.ndarray:
        x = np.zeros(cls.VOTES + HASHED)
        x[0] = x[1 + EVERY_KIND.index(kind)] = 1
        for k in range(3):
            x[1 + len(EVERY_KIND) + 3 * k + v[k] + 1] = 1
        for f in hashed:
            x[cls.VOTES + f] = 1 / np.sqrt(len(hashed))
        return x

    def accepts(self, span: dict) -> bool:
        """Whether a further candidate (a dict of FIELDS) is personal data."""
        if self.weights is None:
            return False
        v = span["v1"], 1 if (span["kind"], span["key"]) in self.known else span["v2"], span["v3"]
        return 1 / (1 + np.exp(-self.row(span["kind"], v, span["f"]) @ self.weights)) >= self.threshold

    @classmethod
    def fitted(cls, counts: list[tuple], sample: list[tuple] = (), known: frozenset = frozenset(), rounds: int = 400) -> SpanClassifier:
        """counts: kind, base, three votes, count. sample: kind, base, three votes, hashed features."""
        xs, ys, ns, posteriors = [], [], [], {}
        for kind in EVERY_KIND:
            free = {tuple(r[2:5]): float(r[5]) for r in counts if r[0] == kind and not r[1]}
            fixed = {tuple(r[2:5]): float(r[5]) for r in counts if r[0] == kind and r[1]}
            if not free and not fixed:
                continue
            *_, posteriors[kind] = expectation_maximisation(free, fixed)
            for v in itertools.product((-1, 0, 1), repeat=3):  # patterns that were not seen too: else nothing speaks against any
                xs.append(cls.row(kind, v)), ys.append(posteriors[kind](v)), ns.append(np.log1p(free.get(v, 0.0) + 1))
            for v, n in fixed.items():
                xs.append(cls.row(kind, v)), ys.append(1.0), ns.append(np.log1p(n))
        if not xs:
            return cls(known=known)
        for kind, base, *v, hashed in sample:
            xs.append(cls.row(kind, v, hashed)), ys.append(1.0 if base else posteriors[kind](tuple(v))), ns.append(0.0)
        x, y, n = np.array(xs), np.array(ys), np.array(ns)
        if len(sample):  # the spans weigh half as much in all as the patterns
            n[-len(sample) :] = n.sum() / (2 * len(sample))
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= 0.5 * (x.T @ (n * (p - y)) / n.sum() + 1e-3 * w)
        return cls(w, known)


def fit(found: DataFrame, name: str) -> SpanClassifier:
    """From find_spans(): gazetteer and counts of vote patterns over all rows, weights from FIT of the spans."""
    spans = found.select(F.explode(F.col(f"`{name}`")).alias("s")).select("s.*")
    keys = spans.where("base AND key != ''").groupBy("kind", "key").count().where(F.col("count") >= LEAST)
    keys = keys.orderBy(F.desc("count"), "kind", "key").limit(GAZETTEER).select("kind", "key", F.lit(1).alias("known"))
    known = frozenset((r.kind, r.key) for r in keys.collect())
    learnt = found.sparkSession.createDataFrame([(*x, 1) for x in sorted(known)], "kind string, key string, known int")
    spans = spans.join(F.broadcast(learnt), ["kind", "key"], "left").withColumn("v2", F.coalesce("known", "v2"))
    pattern = ["kind", "base", "v1", "v2", "v3"]
    counts = sorted(tuple(r) for r in spans.groupBy(*pattern).count().collect())
    order = [F.xxhash64("start", "end", "key", "f"), *pattern, F.col("start"), F.col("end")]
    sample = [tuple(r) for r in spans.orderBy(*order).select(*pattern, "f").limit(FIT).collect()]
    return SpanClassifier.fitted(counts, sample, known)


def _all(spans: list[dict], model: SpanClassifier):
    found = [(x["kind"], x["start"], x["end"]) for x in spans if x["base"] or model.accepts(x)]
    return sorted(found, key=lambda s: (EVERY_KIND.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all of these kinds); and
    n_secret, and flagged: 1 where the text holds any span or secret."""
    found = cut(find_spans(pick(docs, doc_id="long", text="string"), "found", "doc_id"), "pii")
    model = fit(found, "found")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = [(x["kind"], x["start"], x["end"]) for x in spans if x["base"]]
                n = [sum(s[0] == k for s in base) for k in KINDS]
                every = _all(spans, model)
                told = [x for x in every if x[0] in KINDS]
                out.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(told), len(every) - len(told), int(bool(every))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_secret", "flagged"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, flagged int")


def masked(text: str, spans) -> str:
    """Every span (kind, start, end) replaced by [KIND]; of overlapping spans the union is replaced, under the first
    one's kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked; all columns stay as they are (null texts stay null), but n_chars,
    where there is one, is the new length. Texts are searched once: the spans are written beside the documents."""
    (name,) = fresh(docs, "found_spans")
    found = cut(find_spans(docs, name, *docs.columns), "pii")
    model = fit(found, name)
    names = docs.columns
    where, chars = names.index("text"), "n_chars" in names

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = [t if not x or t is None else masked(t, _all(x, model)) for t, x in zip(part.column(where).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                cols = [pa.array(texts, c.type) if k == where else c for k, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    out = found.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if chars else out
