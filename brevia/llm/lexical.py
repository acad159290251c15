"""Ranked lexical search as a blocked sparse matrix product.

Items by terms holds how often an item has a term (or that it has it), terms by documents int64 impacts. Documents are read
once for a block of items: each becomes a row of the matrix, the item terms that it has with their frequencies. The
corpus' statistics are sums over this matrix. Then each Arrow batch is a block of documents: its rows are transposed to term
rows, and an item's row of the product merges the rows of its terms into one accumulator (Gustavson's way). Of each
block only the k best documents of an item are merged with the k best so far; a task gives k rows an item at most, and
these are reduced in two steps, so that no task sees all of an item's.

Items come to the driver and the tasks in blocks of bounded size (BLOCK_BYTES of text, or one text that is larger); a further block
is a further pass over the documents.

Defined results: a null text has no terms; equal rows of items are one item; an item without terms, or whose terms no
document has, has no rows; documents with the same id are documents of their own; a document without id is ranked before
others of the same score; with no documents or no items there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, pick

#: Characters of an item block's texts, in bytes.
BLOCK_BYTES = 8_000_000
#: Terms are runs of ASCII letters, digits and of all other characters than ASCII; of UTF-8, so, of these bytes.
_LETTERS = b"".join(bytes([b]) if b > 127 or chr(b).isalnum() else b" " for b in range(256)).lower()
PIECE = 1 << 20
NO_ID = -(1 << 63)


def terms(text: bytes):
    """Lists of a text's terms, in order. A long text is cut between terms, so that a list stays short."""
    text, start = text.translate(_LETTERS), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def frequencies(text: bytes, known: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """The number of a text's terms, and how often it has each known one."""
    n, found = 0, Counter()
    for part in terms(text):
        n += len(part)
        found.update(map(known.get, part))
    found.pop(None, None)
    return n, found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m for its number of terms."""
    if len(n) and 90 * n_docs * int(n.max()) >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // n_terms


class Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.of = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        had, had_docs = self.of[item]
        if len(had) == self.k:
            worth = scores >= had[-1]
            scores, docs = scores[worth], docs[worth]
        if len(scores):
            scores, docs = np.concatenate([had, scores]), np.concatenate([had_docs, docs])
            order = np.lexsort((docs, -scores))[: self.k]
            self.of[item] = scores[order], docs[order]


def product(docs: np.ndarray, starts: np.ndarray, term: np.ndarray, impact: np.ndarray, items: list, n_terms: int, best: Best) -> None:
    """One block: documents' rows (starts, term, impact) transposed to term rows, then merged for each item (term, times)."""
    order = np.argsort(term, kind="stable")
    column = np.repeat(np.arange(len(docs)), np.diff(starts))[order]
    impact = impact[order]
    row = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
    for k, own in enumerate(items):
        total = np.zeros(len(docs), np.int64)
        for t, times in own:
            here = slice(row[t], row[t + 1])
            total[column[here]] += times * impact[here]  # a document stands once in a term's row
        hit = np.flatnonzero(total)
        best.add(k, total[hit], docs[hit])


def _blocks(items: DataFrame):
    """The items in blocks of at most BLOCK_BYTES: lists of (item_id, text)."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, largest = 1, total
    while largest > BLOCK_BYTES and n <= 4 * total // BLOCK_BYTES + 4:
        n *= 2
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        largest = items.groupBy(block).agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0]
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()


def rank(docs: DataFrame, items: DataFrame, k: int = 10, repeats: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. repeats: a term counts as often as the item has it."""
    items = pick(items, item_id="long", text="string").where("text IS NOT NULL").distinct()
    found = [_ranked(docs, block, k, repeats) for block in _blocks(items)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ranked(docs: DataFrame, block: list, k: int, repeats: bool) -> DataFrame:
    known: dict[bytes, int] = {}
    wanted = []
    for _, text in block:
        own = Counter(known.setdefault(t, len(known)) for part in terms(text.encode()) for t in part)
        wanted.append(sorted(own.items()) if repeats else [(t, 1) for t in sorted(own)])

    def rows(batches):
        for b in batches:
            n, starts, term, tf = [], [0], [], []
            for text in b.column(1):
                total, own = frequencies(text.as_py() or b"", known)
                n.append(total)
                term.extend(own)
                tf.extend(own.values())
                starts.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        give_back()

    own = pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))
    matrix = cut(own.mapInArrow(rows, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0"), "matrix")
    n_docs, n_terms = matrix.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(known), np.int64)
    for r in matrix.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the block
        weights[r.term] = weight(n_docs, r["count"])

    def scored(batches):
        best = Best(len(wanted), k)
        for b in batches:
            ids, n = (b.column(c) for c in (0, 1))
            lists, tf = b.column(2), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            term = lists.flatten().to_numpy(zero_copy_only=False)
            m = np.repeat(lengths(n.to_numpy(), n_docs, n_terms), np.diff(starts))
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            product(ids.fill_null(NO_ID).to_numpy(), starts, term, impact, wanted, len(known), best)
        item, score, doc = [], [], []
        for i, (scores, which) in enumerate(best.of):
            item += [i] * len(scores)
            score += scores.tolist()
            doc += [None if d == NO_ID else d for d in which.tolist()]
        of = [block[i][0] for i in item]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((item, pa.int32()), (of, pa.int64()), (doc, pa.int64()), (score, pa.int64()))], ["item", "item_id", "doc_id", "score"])

    parts = matrix.mapInArrow(scored, "item int, item_id long, doc_id long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return best(best(parts, "item", "part").drop("rank"), "item").select("item_id", "rank", "doc_id", "score")


#: Equal rows of documents are numbered, so that each counts.
ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), docs AS (SELECT row, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM docs),
asked AS (
  SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), tf AS (
  SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked)
  GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
  SELECT item_id, text, row, doc_id,
    CAST(sum(CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN total GROUP BY item_id, text, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
