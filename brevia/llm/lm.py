"""Language-model scoring with an interpolated modified Kneser-Ney n-gram model.

Tasks turn texts into hashes of words and count them in sorted runs; Spark shuffles the runs by ranges of their hashes, so
that each range is summed by one task and stored as an array of sorted hashes beside its values. The vocabulary comes
first: a word's number is its place in it. N-grams of these numbers are counted the same way, and from the sums of
one order come the runs of the next lower (how many words stand before it) and of its contexts (how often, and how many
words follow it once, twice, more often). Nothing is dropped: all n-grams of all training texts are in the model.

The arrays lie in the shared folder. Workers map them into memory and look up the distinct hashes of some texts at a
time in rising order; a worker holds no part of the model itself. So spark.checkpoint.dir has to be a mounted folder.
A range has about `per_range` tokens, whatever the size of the corpus, and each file is replaced as a whole: a task that runs
again writes the same file.

The probability of a word after a context is its discounted share there plus what the discounts leave times the
probability after the context without its first word, down to 1 / (words + 1), unknown words being one more word. Discounts
follow from how many n-grams were counted once to four times; where they can't (small corpora), they are 0.5, 1 and 1.5.

Defined results: null texts are empty, an empty text has the end alone; rows without doc_id are training rows; equal rows
all count; with nothing to learn from, every token has probability 1 / 1; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, give_back, pick, small_batches

#: Bytes of text that are gone through at once, tokens whose runs are gathered before they are sent.
PIECE, GATHERED = 1 << 20, 3_000_000
FALLBACK = (0.5, 1.0, 1.5)
RUN = "kind string, range int, width int, grams binary, counts binary, stats array<long>"
_GAP = re.compile(rb"[\x20\x09-\x0D]")
END = xxhash.xxh64_intdigest(b"\n")


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case, and of the end."""
    out, start = [], 0
    while start < len(text):
        gap = _GAP.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        words = text[start:end].lower().split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate([*out, np.array([END], np.uint64)])


def parts(batches):
    """(ids, hashes of all tokens, number of each text's tokens), of about PIECE bytes of text."""
    for b in batches:
        ids, own, size = [], [], 0
        for k, text in enumerate(b.column(1)):
            text = text.as_py() or b""
            ids.append(k)
            own.append(tokens(text))
            size += len(text)
            if size >= PIECE or k == b.num_rows - 1:
                yield b.column(0).slice(ids[0], len(ids)), np.concatenate(own), np.array([len(x) for x in own])
                ids, own, size = [], [], 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_of(grams: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers; rows that differ only in their last number always differ."""
    out = np.full(len(grams), 0x9E3779B97F4A7C15, np.uint64)
    for column in grams.T:
        out = _mixed(out + column.astype(np.uint64))
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each is found, and the sums of its rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], order[starts], np.add.reduceat(counts[order], starts, axis=0) if len(keys) else counts


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def windows(ids: np.ndarray, lengths: np.ndarray, order: int, begin: int) -> np.ndarray:
    """For each token the `order` numbers that end with it; before a text stand numbers `begin`."""
    pad = order - 1
    seq = np.full(len(ids) + pad * len(lengths), begin, np.uint32)
    at = np.arange(len(ids)) + np.repeat(np.arange(1, len(lengths) + 1) * pad, lengths)
    seq[at] = ids
    return np.stack([seq[at - pad + j] for j in range(order)], axis=1)


@dataclass
class Model:
    path: str
    order: int
    bits: int
    sizes: dict[str, dict[int, int]]
    tokens: int = 0
    discounts: dict[int, tuple[float, ...]] | None = None

    def __post_init__(self):
        own = self.sizes.get("word", {})
        self.words = sum(own.values())
        self.first = np.concatenate([[0], np.cumsum([own.get(k, 0) for k in range(1 << self.bits)])])
        self.open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def file(self, kind: str, k: int, what: str) -> str:
        return f"{self.path}/{kind}-{k:06d}-{what}.npy"

    def mapped(self, kind: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        if (kind, k) not in self.open:
            self.open[kind, k] = tuple(np.load(self.file(kind, k, what), mmap_mode="r") for what in ("keys", "counts"))
        return self.open[kind, k]

    def find(self, kind: str, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct keys their places (the number of all, if not there) and their rows of counts (or zeros)."""
        places, out = np.full(len(keys), self.words, np.int64), np.zeros((len(keys), width), np.int64)
        edges = split(keys, self.bits)
        for k in np.flatnonzero(np.diff(edges)):
            if self.sizes.get(kind, {}).get(int(k)):
                here = slice(edges[k], edges[k + 1])
                stored, counts = self.mapped(kind, int(k))
                at = np.searchsorted(stored, keys[here])
                at[at == len(stored)] = 0
                hit = stored[at] == keys[here]
                out[here][hit] = counts[at[hit]]
                if kind == "word":
                    places[here][hit] = self.first[k] + at[hit]
        return places, out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each token (`words` for unknown ones) and how often it stands in the training texts."""
        keys, which = np.unique(hashes, return_inverse=True)
        places, counts = self.find("word", keys, 1)
        return places[which], counts[which, 0]

    def counts(self, kind: str, grams: np.ndarray, width: int) -> np.ndarray:
        keys, which = np.unique(hash_of(grams), return_inverse=True)
        return self.find(kind, keys, width)[1][which]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last number of each row after the ones before it."""
        p = np.full(len(grams), 1 / (self.words + 1))
        for k in range(1, self.order + 1):
            own = grams[:, self.order - k :]
            c, x = self.counts(f"gram{k}", own, 1)[:, 0], self.counts(f"context{k}", own[:, :-1], 4)
            d = np.array([0.0, *self.discounts[k]])
            total = np.maximum(x[:, 0], 1)
            p = np.where(x[:, 0] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / total + x[:, 1:] @ d[1:] / total * p, p)
        return p


def split(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of 1 << bits begins in sorted keys, and their number."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, starts), len(keys))


def runs(kind: str, bits: int, keys: np.ndarray, grams: np.ndarray, counts: np.ndarray):
    """Rows of RUN, one for each range that the sorted distinct keys meet. Within it rows go by their first word, and column by
    column, which the shuffle compresses."""
    counts = counts.astype(np.min_scalar_type(int(counts.max()))) if counts.size else counts
    edges = split(keys, bits)
    for k in np.flatnonzero(np.diff(edges)):
        own = slice(edges[k], edges[k + 1])
        order = np.argsort(grams[own, 0], kind="stable") if grams.shape[1] else slice(None)
        yield kind, int(k), counts.dtype.itemsize, grams[own][order].T.tobytes(), counts[own][order].T.tobytes(), None


def batches_of(rows):
    """Arrow batches of a few MB."""
    held, size = [], 0
    names = [x.split()[0] for x in RUN.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
    for row in rows:
        held.append(row)
        size += len(row[3] or b"") + len(row[4] or b"")
        if size > 4_000_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def counted(kind: str, bits: int, grams_of):
    """A function for tasks: the runs of grams_of(hashes, lengths) over texts, in (keys, grams) of the same order."""

    def run(batches):
        def gathered():
            held, size = [], 0
            for _, hashes, lengths in parts(batches):
                keys, grams = grams_of(hashes, lengths)
                held.append(summed(keys, np.ones((len(keys), 1), np.int64)))
                held[-1] = (held[-1][0], grams[held[-1][1]], held[-1][2])
                size += len(held[-1][0])
                if size >= GATHERED:
                    yield from send(held)
                    held, size = [], 0
            if held:
                yield from send(held)

        def send(held):
            keys, grams, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at, counts = summed(keys, counts)
            yield from runs(kind, bits, keys, grams[at], counts)

        yield from batches_of(gathered())
        give_back()

    return run


def _saved(path: str, array: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def stored(model: Model):
    """A function for tasks: sums the runs of each range, stores them, and gives the runs of lower orders and statistics."""

    def finish(kind: str, k: int, rows: list):
        """rows: (grams, counts) of runs."""
        grams, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows.clear()
        keys, at, counts = summed(grams[:, 0] if kind == "word" else hash_of(grams), counts.astype(np.int64))
        _saved(model.file(kind, k, "keys"), keys)
        _saved(model.file(kind, k, "counts"), counts.astype(np.min_scalar_type(int(counts.max()))))
        tally = [int((counts[:, 0] == n).sum()) for n in (1, 2, 3, 4)]
        yield kind, k, None, None, None, [len(keys), int(counts[:, 0].sum()), *tally]
        if kind.startswith("gram"):
            n, grams, c = int(kind[4:]), grams[at], counts[:, 0]
            before = grams[:, :-1]
            follow = np.stack([c, c == 1, c == 2, c > 2], axis=1).astype(np.int64)
            keys, at, sums = summed(hash_of(before), follow)
            yield from runs(f"context{n}", model.bits, keys, before[at], sums)
            if n > 1:
                after = grams[:, 1:]
                keys, at, sums = summed(hash_of(after), np.ones((len(after), 1), np.int64))
                yield from runs(f"gram{n - 1}", model.bits, keys, after[at], sums)

    def run(batches):
        def all_rows():
            key, held = None, []
            for b in batches:
                for kind, k, width, grams, counts in zip(*[c.to_pylist() for c in b.columns[:5]], strict=True):
                    if key != (kind, k):
                        if held:
                            yield from finish(*key, held)
                        key, held = (kind, k), []
                    columns = 4 if kind.startswith("context") else 1
                    counts = np.frombuffer(counts, f"u{width}").reshape(columns, -1).T
                    numbers = np.frombuffer(grams, np.uint64 if kind == "word" else np.uint32).reshape(-1, len(counts)).T
                    held.append((numbers, counts))
            if held:
                yield from finish(*key, held)

        yield from batches_of(all_rows())
        give_back()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    if min(n1, n2, n3, n4) == 0:
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return out if all(0 <= d <= k for k, d in enumerate(out, 1)) else FALLBACK


def mounted(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped into memory: spark.checkpoint.dir has to be a mounted folder, not {path}")
    return url.path


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))


def train(docs: DataFrame, order: int = 2, per_range: int = 2_000_000) -> Model:
    """The model of all rows of docs."""
    texts = _texts(docs)
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    model = Model(mounted(fresh_path(docs.sparkSession, "lm")), order, max(3, (size // 6 // per_range).bit_length()), {})
    tally: dict[int, list[int]] = {}

    def step(df: DataFrame, name: str) -> DataFrame:
        by_range = df.repartitionById(1 << model.bits, "range").sortWithinPartitions("kind", "range")
        out = cut(by_range.mapInArrow(stored(model), RUN), name)
        for r in out.where("stats IS NOT NULL").select("kind", "range", "stats").toLocalIterator():  # one for each file
            model.sizes.setdefault(r.kind, {})[r.range] = r.stats[0]
            if r.kind == "word":
                model.tokens += r.stats[1]
            elif r.kind.startswith("gram"):
                n = int(r.kind[4:])
                tally[n] = [a + b for a, b in zip(tally.get(n, [0] * 4), r.stats[2:], strict=True)]
        return out.where("stats IS NULL")

    step(texts.mapInArrow(counted("word", model.bits, lambda hashes, _: (hashes, hashes[:, None])), RUN), "words")
    model.__post_init__()
    vocabulary = Model(model.path, order, model.bits, {"word": model.sizes.get("word", {})})

    def grams_of(hashes, lengths):
        grams = windows(vocabulary.numbers(hashes)[0], lengths, order, vocabulary.words + 1)
        return hash_of(grams), grams

    rest = step(texts.mapInArrow(counted(f"gram{order}", model.bits, grams_of), RUN), f"grams_{order}")
    for n in range(order - 1, -1, -1):
        rest = step(rest, f"grams_{n}")
    model.discounts = {n: discounts(*tally.get(n, [0] * 4)) for n in range(1, order + 1)}
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of a text's probability), perplexity."""

    def run(batches):
        for ids, hashes, lengths in parts(batches):
            numbers, counts = model.numbers(hashes)
            at = starts_of(lengths)
            sums = lambda x: np.add.reduceat(x, at)
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            own = np.log10(model.probabilities(windows(numbers, lengths, model.order, model.words + 1)))
            cols = [ids, pa.array(lengths, pa.int64()), pa.array(sums((counts > 0).astype(np.int64)), pa.int64()), pa.array(sums(base)), pa.array(sums(own))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])
        give_back()

    small_batches(docs.sparkSession)
    scored = _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity)


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """All rows, by a model of those that aren't held out."""
    return score(docs, train(docs.where(~held_out(F.col("doc_id"))), order))
