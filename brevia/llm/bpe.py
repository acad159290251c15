"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring byte symbols that stands in no token of the vocabulary can never be merged across, so it
marks a certain cut. A word is split at its certain cuts, the fragments are encoded on their own, and their ids are
concatenated (and remembered by word). Decoding joins the tokens' strings by one space, as the vocabulary names no decoder.

Defined results: a null text is encoded as the empty text (no ids); every row gives one row, repeated ones too; the
strings of special tokens in a text become their ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, pick, small_batches, text_parts

#: What the vocabulary file's normaliser calls white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"
#: Entries that a worker remembers for runs and for words. A full memory becomes the aged one, which is still read.
RUNS, WORDS = 100_000, 30_000
#: Times as many where nothing but digests of the ids is kept, and the worker has its memory to itself.
MORE = 3


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary whose words end in END."""

    def __init__(self, path: str):
        self.most_runs, self.most_words = RUNS, WORDS
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        ids = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[x], ids[y]] = rank
            self.made.append(ids[x + y])
        symbol = byte_symbols()
        self.inner = [ids[c] for c in symbol]
        self.last = [ids[c + END] for c in symbol]
        #: Pairs of symbols that stand side by side in some token. All others are certain cuts.
        self.joined = {pair for token in self.vocab for pair in self._pairs([ids[c] for c in self._symbols(token) if c in ids])}
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.odd = re.compile("[\x1c-\x1f]")  # white space to str.split() only
        self.forget()

    def forget(self) -> None:
        """Give the memory of runs and words back."""
        self.runs: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.aged_runs, self.aged_words = {}, {}

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if not token.endswith(END):
            return list(token)
        body = list(token[: -len(END)])
        return [*body[:-1], body[-1] + END] if body else [END]

    @staticmethod
    def _pairs(symbols: list[str]):
        return zip(symbols, symbols[1:], strict=False)

    def fragments_of(self, word: str) -> list[tuple[int, ...]]:
        """The ids of the word's byte symbols, split at every certain cut."""
        raw, joined = word.encode("utf-8"), self.joined
        ids = list(map(self.inner.__getitem__, raw))
        ids[-1] = self.last[raw[-1]]
        if joined.issuperset(self._pairs(ids)):
            return [tuple(ids)]
        cuts = [k for k, pair in enumerate(self._pairs(ids), 1) if pair not in joined]
        return [tuple(ids[i:j]) for i, j in zip([0, *cuts], [*cuts, len(ids)], strict=True)]

    def encode_fragment(self, fragment: tuple[int, ...]) -> list[int]:
        """Merges of the lowest rank first, leftmost first."""
        return self._encode_long(list(fragment)) if len(fragment) > 200 else self._merged(list(fragment))

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """Of a word: number of ids, ids and token strings, joined. The words of many runs are the same."""
        if (got := self.words.get(word)) is not None:
            return got
        if (got := self.aged_words.get(word)) is None:
            strings = self.strings
            ids = [i for f in self.fragments_of(word) for i in self.encode_fragment(f)]
            got = len(ids), " ".join(map(str, ids)), " ".join([strings[i] for i in ids])
        if len(word) <= 64:
            if len(self.words) >= self.most_words:
                self.aged_words, self.words = self.words, {}
            self.words[word] = got
        return got

    def _merged(self, ids: list[int]) -> list[int]:
        get, made, never = self.rank.get, self.made, len(self.made)
        ranks = [get(pair, never) for pair in self._pairs(ids)]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), never)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), never)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same merges through a heap over a linked list, for fragments of any length."""
        n, rank, made = len(ids), self.rank, self.made
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not live[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], live[j], after[k] = made[r], False, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) >= 0 and (r := rank.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x, on in zip(ids, live, strict=True) if on]

    def encode_run(self, run: str) -> tuple[int, str, str]:
        """The same of a run without white space."""
        if (got := self.aged_runs.get(run)) is None:
            words = self.word.findall(run)
            if len(words) == 1:
                got = self.encode_word(words[0])
            else:
                parts = [self.encode_word(w) for w in words]
                got = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        if len(run) <= 64:
            if len(self.runs) >= self.most_runs:
                self.aged_runs, self.runs = self.runs, {}
            self.runs[run] = got
        return got

    def normal_runs(self, text: str) -> list[str]:
        """The normalised text's runs without white space: no word reaches over white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # lower-casing is by character, without the final form of sigma
        if self.odd.search(text):
            return self.spaces.split(text.lower())
        return text.lower().split()

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        out, known, encode = [], self.runs.get, self.encode_run
        cuts, at = [], 0
        if self.cut_special and "<|" in text:
            cuts = [(m.start(), m.end(), m.group()) for m in self.cut_special.finditer(text)]
        for start, end, name in [*cuts, (len(text), len(text), "")]:
            out += [known(run) or encode(run) for run in self.normal_runs(text[at:start] if cuts else text)]
            if name:
                i = self.special[name]
                out.append((1, str(i), self.strings[i]))
            at = end
        return [p for p in out if p[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _row_digests(bpe: WordBpe, text: str | None) -> tuple:
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    parts = bpe.parts(text or "")
    return sum([p[0] for p in parts]), sha(" ".join([p[1] for p in parts])), sha(" ".join([p[2] for p in parts]))


def _row_ids(bpe: WordBpe, text: str | None) -> tuple:
    parts = bpe.parts(text or "")
    return np.array(" ".join([p[1] for p in parts]).split(), np.int32), " ".join([p[2] for p in parts])


def _mapped(docs: DataFrame, path: str | None, schema: str, kinds: list, names: list[str], row, times: int = 1) -> DataFrame:
    """docs (doc_id, text, more columns) without text, with the columns that row() makes of a text; part by part."""

    def run(batches):
        bpe = load(path or default_path())
        bpe.most_runs, bpe.most_words = times * RUNS, times * WORDS
        for b in batches:
            at = 0
            for ids, texts in text_parts(b):
                made = zip(*[row(bpe, t) for t in texts], strict=True)
                more = [c.slice(at, len(ids)) for c in b.columns[2:]]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *more, *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names)
        bpe.forget()  # the worker lives on for other stages' tasks
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns for every row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    names, kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    return _mapped(pick(docs, doc_id="long", text="string"), path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", kinds, names, _row_digests, MORE)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (array) and decoded in place of text; all other columns as they are (an underscore is added to the
    new names where docs has them)."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    ids, decoded = fresh(docs, "ids", "decoded")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ["doc_id", *more]] + [f"`{ids}` array<int>", f"`{decoded}` string"])
    return _mapped(rows, path, schema, [pa.list_(pa.int32()), pa.string()], ["doc_id", *more, ids, decoded], _row_ids)
