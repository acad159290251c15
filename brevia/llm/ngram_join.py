"""N-gram Jaccard join over count vectors.

Every document becomes the set of its distinct word n-grams (64-bit hashes). Documents with equal sets are one class.
The n-grams of a set are hashed into groups; its point holds how many fall into each. Of two sets of sizes a and b with
the points p and q the overlap is at most the sum of min(p, q) over the coordinates, and they link only if it reaches
percent * (a + b) / (100 + percent): only pairs that pass this bound are verified on the whole sets.

1. Blocks. Sizes fall into classes of width 1.5; for the largest size of a class the sets of a linked pair differ in
   at most D n-grams, so of D + 1 ranges of the hash space at least one holds the same n-grams in both. Ranges that
   are empty count too, but a set with more than D filled ranges has a filled one in common with each partner, and
   leaves its empty ones out: else all long texts would meet in these. Each class emits the content hashes of its
   ranges (and those for the next size class, if a partner may be there). Sets that share one stand in one block.
2. Hubs. Blocks with the same smallest class are joined into one, so that texts that share hundreds of ranges meet once.
   A block's hub is its member that shares most ranges in all: of a group of near copies this is one in the middle. Each
   member is paired with the hub, and pairs within the bound are verified: a large group becomes one component by as many
   pairs as it has members.
3. R-tree. Only blocks whose members are still in more than one component go on. Their points, sorted by block and
   size over all tasks, are packed into tiles of TILE; in each tile, and between the tiles of a wide block whose
   bounding boxes the bound allows, an R-tree over the points finds the pairs between components that reach the bound.
   All of these that no hub pair has decided are verified too, so no link between different texts is lost.
4. Components by large-star and small-star rounds.

A set's point has a coordinate for about every PER_COORDINATE n-grams: with more n-grams for each, the bound of a long
text would never be under the threshold. Points of different length are folded to the shorter one's groups.

Defined results: null and wordless texts have an empty set and link with nothing; a text of fewer words than n has its
whole sequence as its one n-gram; rows that share a doc_id are told apart by their sets; null doc_ids get the smallest
doc_id of their component, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, pick, text_parts

#: Coordinates of a point at least, and n-grams for each coordinate, about.
COORDINATES, PER_COORDINATE = 64, 4
#: Rows that are searched together: a power of two.
TILE = 512
LEAF = 16
#: Rows that a task puts in order, about.
ORDERED = 100_000
#: Classes whose key or smallest doc_id may be broadcast to find their texts (8 bytes each).
BROADCAST_ROWS = 500_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE, PART = np.uint64(0x9E3779B97F4A7C15), [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 16)]
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word n-grams for many texts at once: words are hashed as differences of prefix sums."""

    def __init__(self, n: int = 3):
        self.n = n
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, size: int):
        if len(self.power) < size:
            size = max(size, 1 << 18)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
                self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE_INVERSE)]))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * self.power[: len(data)])])
            gap = GAP[data]
            edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
            start, stop = edge[0::2], edge[1::2]
            word = mix((sums[stop] - sums[start]) * self.inverse[start])
            of = np.searchsorted(ends, start, side="right")
            first = np.searchsorted(of, np.arange(len(texts) + 1))
            n = self.n
            if len(word) >= n:
                grams = sum((word[k : len(word) - n + 1 + k] * PART[k] for k in range(1, n)), word[: len(word) - n + 1] * PART[0])
                grams = mix(grams)
            out = []
            for k in range(len(texts)):
                i, j = first[k], first[k + 1]
                if j - i >= n:
                    out.append(np.unique(grams[i : j - n + 1]))
                elif j > i:
                    out.append(mix(np.sum(word[i:j] * np.array(PART[: j - i], np.uint64), keepdims=True) + np.uint64(j - i)))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


class Blocks:
    """Group content hashes under a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.floors = percent, [1]
        while self.floors[-1] < 1 << 40:
            low = self.floors[-1]
            self.floors.append(max(low + 1, low * 3 // 2, -(-low * 100 // percent)))
        self.edges: dict[int, np.ndarray] = {}

    def _groups(self, size_class: int) -> np.ndarray:
        if size_class not in self.edges:
            largest = self.floors[size_class + 1] - 1
            differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
            k = differ + 1 + differ // 16  # some to spare for ranges that hold nothing
            self.edges[size_class] = np.array([i * 2**64 // k for i in range(1, k)], np.uint64)
        return self.edges[size_class]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if not n:
            return hashes
        own = int(np.searchsorted(self.floors, n, side="right")) - 1
        classes = [own] + [own + 1] * (100 * n >= self.percent * self.floors[own + 1])
        out = []
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(1)))])
            for c in classes:
                at = np.concatenate([[0], np.searchsorted(hashes, self._groups(c)), [n]])
                label = np.arange(len(at) - 1, dtype=np.uint64) + (np.uint64(c) << np.uint64(40))
                held = np.diff(at)
                keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(label * PART[3] + held.astype(np.uint64)))
                # with more filled ranges than n-grams can differ, a linked set has a filled one in common with this
                partner = min(self.floors[c + 1] - 1, n * 100 // self.percent)
                differ = (n + partner) * (100 - self.percent) // (100 + self.percent)
                out.append(keys[held > 0] if np.count_nonzero(held) > differ else keys)
        return np.concatenate(out)


def point_of(hashes: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its n-grams fall into each group. The number of groups is a power of two that
    follows the set's size; it is doubled until every count is a byte."""
    c = COORDINATES
    while c * PER_COORDINATE < len(hashes):
        c *= 2
    while len(point := np.bincount((hashes & np.uint64(c - 1)).astype(np.int64), minlength=c)) and point.max() > 255:
        c *= 2
    return point.astype(np.uint8)


def set_key(hashes: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.sum(mix(hashes ^ PART[5]), dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)) * PART[6])[0]


def need(a, b, percent: int):
    """The least overlap of sets of these sizes at which they link."""
    return ((a + b) * percent + 99 + percent) // (100 + percent)


class Points:
    """A binary column of points, without an object for each."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
        self.at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.length = np.diff(self.at)

    def folded(self, rows: np.ndarray, c: int) -> np.ndarray:
        """The points of these rows among c groups; c divides their lengths."""
        out = np.empty((len(rows), c), np.uint32)
        for length in np.unique(self.length[rows]):
            own = np.flatnonzero(self.length[rows] == length)
            points = self.data[self.at[rows[own]][:, None] + np.arange(length)]
            out[own] = points if length == c else points.reshape(len(own), -1, c).sum(axis=1, dtype=np.uint32)
        return out


def bounds(p: Points, i: np.ndarray, q: Points, j: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of pairs of points, pair by pair."""
    out = np.zeros(len(i), np.int64)
    c = np.minimum(p.length[i], q.length[j])
    for width in np.unique(c):
        own = np.flatnonzero(c == width)
        step = max(1, (1 << 20) // int(width))
        for k in range(0, len(own), step):
            at = own[k : k + step]
            out[at] = np.minimum(p.folded(i[at], width), q.folded(j[at], width)).sum(axis=1)
    return out


class RTree:
    """A packed R-tree over count vectors: leaves of LEAF points, boxes of the coordinates' maxima."""

    def __init__(self, points: np.ndarray):
        self.order = np.lexsort([points[:, 1], points[:, 0], points.sum(axis=1)])
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > LEAF:
            low = self.levels[-1]
            self.levels.append(np.maximum.reduceat(low, np.arange(0, len(low), LEAF), axis=0))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices of the points whose summed coordinate minima reach the overlap that a link needs."""
        least = need(size, 0, percent)
        at = np.arange(len(self.levels[-1]))
        for level in range(len(self.levels) - 1, -1, -1):
            boxes = self.levels[level][at]
            bound = np.minimum(boxes, point).sum(axis=1, dtype=np.int64)
            if level == 0:
                return self.order[at[bound >= need(size, boxes.sum(axis=1, dtype=np.int64), percent)]]
            at = at[bound >= least]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.levels[level - 1])]
        return at


def tree_pairs(points: np.ndarray, n: np.ndarray, root: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (i of one, j of two) of rows in different components whose points reach the bound. In each such pair one
    row at least is outside the largest component, so only rows outside it are asked for."""
    roots, size = np.unique(root[np.concatenate([one, two])], return_counts=True)
    outside = root != roots[np.argmax(size)]
    out = [np.zeros((0, 2), np.int64)]
    for asked, there in ((one[outside[one]], two), (two[outside[two]], one[~outside[one]])):
        if not len(asked) or not len(there):
            continue
        tree = RTree(points[there])
        for i in asked:
            j = there[tree.search(points[i], int(n[i]), percent)]
            j = j[root[j] != root[i]]
            out.append(np.stack([np.full(len(j), i), j], axis=1))
    return np.concatenate(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<long> column of arrays of hashes."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *arrays])), pa.int64()))


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), e (class), n, point, blocks for every row. Of rows of one class in a task only the first has
    blocks: copies add nothing to them."""

    def run(batches):
        shingle, blocks, seen, none = Shingler(n), Blocks(percent), set(), np.zeros(0, np.uint64)
        for b in batches:
            row = 0
            for ids, texts in text_parts(b):
                sets = shingle(texts)
                keys = [int(set_key(s)) for s in sets]
                fresh_keys = [k not in seen and not seen.add(k) for k in keys]
                cols = [
                    pa.array(ids, pa.int64()),
                    b.column(2).slice(row, len(ids)),
                    pa.array(_signed(np.array(keys, np.uint64)), pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([point_of(s).tobytes() for s in sets], pa.binary()),
                    _lists([blocks(s) if new else none for s, new in zip(sets, fresh_keys, strict=True)]),
                ]
                row += len(ids)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "e", "n", "point", "blocks"])
        give_back()

    rows = pick(docs, doc_id="long", text="string").withColumn("t", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, t long, e long, n long, point binary, blocks array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        shingle = Shingler(n)
        for b in batches:
            for _, texts in text_parts(b):
                sets = shingle(texts)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.array([set_key(s) for s in sets], np.uint64)), pa.int64()), _lists(sets)], ["e", "grams"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "e long, grams array<long>")


def within_bound(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose points reach the bound."""
    one = points.select(F.col("e").alias("a"), F.col("point").alias("p"), F.col("n").alias("n1"))
    two = points.select(F.col("e").alias("b"), F.col("point").alias("q"), F.col("n").alias("n2"))

    def run(batches):
        for x in batches:
            every = np.arange(x.num_rows)
            sizes = (x.column(k).to_numpy() for k in (3, 5))
            good = bounds(Points(x.column(2)), every, Points(x.column(4)), every) >= need(*sizes, percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in x.columns[:2]], ["a", "b"])
        give_back()

    return pairs.join(one, "a").join(two, "b").select("a", "b", "p", "n1", "q", "n2").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets link. The texts of the classes in pairs are read again, by the smallest
    doc_id of each class."""
    asked = cut(pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct(), "asked")
    few = asked.count() <= BROADCAST_ROWS
    wanted = points.join(F.broadcast(asked) if few else asked, "e", "left_semi").select("rep").distinct()
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = _sets(texts, n).join(F.broadcast(asked) if few else asked, "e", "left_semi")
    sets = cut(sets.dropDuplicates(["e"]), "sets")
    one = sets.select(F.col("e").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("e").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("c"), (F.size("ga") + F.size("gb")).alias("t"))
    return cut(both.where(F.col("c") * (100 + percent) >= F.col("t") * percent).select("a", "b"), "links", replaces=sets)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b); root is the smallest vertex of its component."""

    def known(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    was = known(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hop = e.join(least, "u")
        e = cut(hop.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        if (now := known(e)) == was:
            break
        was = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())


def tree_candidates(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, between the components of a block whose points reach the bound. rows: block, e, root."""
    members = cut(rows.join(points.select("e", "n", "point"), "e").select("block", "e", "n", "point", "root"), "members")
    order = ["block", "n", "e"]
    parts = members.count() // ORDERED + 1
    # a block of any size may go to several tasks; TILE divides the steps of the ids from task to task
    placed = members.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("tile", F.floor(F.monotonically_increasing_id() / TILE))
    tiles = cut(placed, "tiles", replaces=members)

    def told(found: np.ndarray, e: np.ndarray) -> pa.Table:
        x, y = e[found[:, 0]], e[found[:, 1]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    def inside(part: pa.Table) -> pa.Table:
        block, e, n, root = (part.column(c).to_numpy() for c in ("block", "e", "n", "root"))
        points, order = Points(part.column("point")), np.lexsort([e, block])
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        found = [np.zeros((0, 2), np.int64)]
        for own in np.split(order, cuts):
            if len(np.unique(root[own])) > 1:
                some = tree_pairs(points.folded(own, int(points.length[own].min())), n[own], root[own], *[np.arange(len(own))] * 2, percent)
                found.append(own[some])
        return told(np.concatenate(found), e)

    near = tiles.groupBy("tile").applyInArrow(inside, "a long, b long")
    wide = tiles.groupBy("block").agg(F.min("tile").alias("first"), F.max("tile").alias("last")).where("first != last").select("block")
    wide = cut(wide, "wide")
    if not wide.count():
        return cut(near.distinct(), "candidates", replaces=tiles)
    rows = tiles.join(wide, "block", "left_semi")

    def boxes(part: pa.Table) -> pa.Table:
        points = Points(part.column("point"))
        box = points.folded(np.arange(len(part)), int(points.length.min())).max(axis=0)
        low = int(part.column("n").to_numpy().min())
        return pa.table({"block": part.column("block")[:1], "tile": part.column("tile")[:1], "low": [low], "box": [box.tobytes()]})

    box = cut(rows.groupBy("block", "tile").applyInArrow(boxes, "block long, tile long, low long, box binary"), "boxes")
    left = box.select("block", F.col("tile").alias("t1"), F.col("low").alias("l1"), F.col("box").alias("b1"))
    right = box.select("block", F.col("tile").alias("t2"), F.col("low").alias("l2"), F.col("box").alias("b2"))

    def may_link(batches):
        for x in batches:
            one, two = ([np.frombuffer(b.as_py(), np.uint32).astype(np.int64) for b in x.column(k)] for k in (5, 6))
            low = x.column(3).to_numpy(), x.column(4).to_numpy()
            fold = lambda p, c: p.reshape(-1, c).sum(axis=0)
            bound = [int(np.minimum(fold(p, c), fold(q, c)).sum()) for p, q in zip(one, two, strict=True) for c in [min(len(p), len(q))]]
            good = np.array(bound, np.int64) >= need(*low, percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in x.columns[:3]], ["block", "t1", "t2"])

    met = left.join(right, "block").where("t1 < t2").select("block", "t1", "t2", "l1", "l2", "b1", "b2").mapInArrow(may_link, "block long, t1 long, t2 long")
    met = cut(met, "met")
    sides = [met.join(rows.withColumnRenamed("tile", f"t{k}"), ["block", f"t{k}"]).select("block", "t1", "t2", F.lit(k).alias("side"), "e", "n", "point", "root") for k in (1, 2)]

    def across(part: pa.Table) -> pa.Table:
        e, n, root, side = (part.column(c).to_numpy() for c in ("e", "n", "root", "side"))
        points = Points(part.column("point"))
        points = points.folded(np.arange(len(e)), int(points.length.min()))
        return told(tree_pairs(points, n, root, np.flatnonzero(side == 1), np.flatnonzero(side == 2), percent), e)

    far = sides[0].unionByName(sides[1]).groupBy("block", "t1", "t2").applyInArrow(across, "a long, b long")
    return cut(far.unionByName(near).distinct(), "candidates", replaces=tiles)


def blocks_of(signed: DataFrame) -> DataFrame:
    """(block, e, ranges): blocks of several classes, by their smallest class, with the ranges that each shares there."""
    of_block = Window.partitionBy("block")
    rows = signed.where("n > 0").select("e", F.explode("blocks").alias("block"))
    rows = rows.select("e", F.min("e").over(of_block).alias("first"), F.max("e").over(of_block).alias("last"))
    return rows.where("first != last").groupBy(F.col("first").alias("block"), "e").agg(F.count("*").alias("ranges"))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each member of a block with the block's hub, the smaller class first."""
    shared = rows.groupBy("e").agg(F.sum("ranges").alias("shared"))
    hubs = rows.join(shared, "e").groupBy("block").agg(F.max(F.struct("shared", "e"))["e"].alias("hub"))
    pairs = rows.join(hubs, "block").where("e != hub")
    return pairs.select(F.least("hub", "e").alias("a"), F.greatest("hub", "e").alias("b")).distinct()


def links_of(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every, links by hubs, links by the R-tree); every: doc_id, t, e, n of every row; links: (a, b) of classes."""
    signed = cut(signatures(docs, n, percent), "signatures")
    rows = cut(blocks_of(signed), "blocks")
    in_blocks = rows.select("e").distinct()
    reps = signed.where("n > 0").groupBy("e").agg(F.min("doc_id").alias("rep"))
    once = signed.where("n > 0").select("e", "n", "point").dropDuplicates(["e"])
    points = cut(once.join(in_blocks, "e", "left_semi").join(reps, "e"), "points")
    # the blocks are the largest part of the signatures and not asked for again
    every = cut(signed.select("doc_id", "t", "e", "n"), "every", replaces=signed)
    pairs = cut(hub_pairs(rows), "pairs")
    close = cut(within_bound(pairs, points, percent), "close")
    by_hub = verified(close, points, docs, n, percent)
    root = components(by_hub)
    placed = rows.select("block", "e").join(root.withColumnRenamed("v", "e"), "e", "left").withColumn("root", F.coalesce("root", "e"))
    placed = cut(placed, "placed", replaces=rows)
    # a hub and one other member: their one pair is decided
    still = placed.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi AND n > 2").select("block")
    found = tree_candidates(placed.join(still, "block", "left_semi"), points, percent)
    # what hubs have decided isn't asked again
    left = cut(found.join(pairs, ["a", "b"], "left_anti"), "left", replaces=found)
    return every, by_hub, verified(left, points, docs, n, percent)


def classes_joined(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(every, root): root has (e, root) of the classes that link."""
    every, by_hub, by_tree = links_of(docs, n, percent)
    root = components(by_hub if by_tree.isEmpty() else by_hub.unionByName(by_tree))
    return every, cut(root.withColumnRenamed("v", "e"), "roots")


def _least_of(every: DataFrame, root: DataFrame) -> DataFrame:
    """(e, first): for each class with several rows or links the first row (none, doc_id, t) of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    own = every.where("n > 0").groupBy("e").agg(first.alias("first")).join(root, "e", "left")
    of_root = own.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    return own.join(of_root, "root", "left").select("e", F.coalesce("least", "first").alias("first"))


def join_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    every, root = classes_joined(docs, n, percent)
    placed = every.join(_least_of(every, root), "e", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id (null last), of several texts under this
    doc_id the one with the smallest hash. Rows without words stay; repeated rows of the same doc_id and text stay or go
    together; all columns as they are."""
    every, root = classes_joined(docs, n, percent)
    placed = every.where("n > 0").join(_least_of(every, root), "e")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")))
    doc_id, text = fresh(docs, "gone_doc", "gone_text")
    gone = cut(placed.where(other).select(F.col("doc_id").alias(doc_id), F.col("t").alias(text)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    return docs.join(gone, same, "left_anti")
