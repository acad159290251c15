"""Merkle manifest of a table, its nodes kept in external memory.

A leaf is the digest of a row. Leaves of one source are sorted into runs; with the sizes of the runs each leaf gets its
position in its source. A level is one folder of Parquet files: the next level reads it in the order of its runs, in
one pass, and takes the digest of every three consecutive nodes; only families that the end of a run cuts meet in a shuffle.
The sources' roots are the leaves of a further tree, which is built the same way. Proofs are merge-scans: the nodes of
some levels are sorted by the coordinate of the subtree that they belong to, and each task scans subtrees one after the
other. The paths above a subtree's root come from a scan of the higher levels, which has 729 times fewer rows.

Defined results: null values are told from empty ones; a null source is a source of its own, before all others; rows without
doc_id come first in their source, rows with the same doc_id go by their digest, and equal rows are leaves of their own; a
row without doc_id isn't tampered with; the text is hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, pick

#: Children of a node, and levels that one scan for proofs covers (subtrees of 3 ** 6 leaves).
ARITY, DEEP = 3, 6
NODE = "tree string, pos long, n long, digest string, slot int, id long, extra string"
NODES = ["tree", "pos", "n", "digest"]
ROW = "tree string, block long, level int, pos long, n long, digest string, path string, id long, extra string"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its path lead to. A path has, from the leaf up, the place among a node's siblings (one
    digit) and their digests from left to right."""
    for step in path.split(",") if path else []:
        siblings = [step[k : k + 64] for k in range(1, len(step), 64)]
        siblings.insert(int(step[0]), leaf)
        leaf = digest_of(siblings)
    return leaf


def proof_digest(path: str) -> str:
    return digest_of([step[1:] for step in path.split(",")])


def _field(col: Column) -> Column:
    text = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in cols]), 256)


def without_line_ends(doc_id: Column, text: Column) -> Column:
    """The text as it is tampered with where 2 divides the checksum of the id: without \\n."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(chosen, F.lit(False)), F.replace(text, F.lit("\n"), F.lit("")))


def _fold(batches):
    """The next level of a run. Families that aren't whole here give their children instead, with slots."""
    family, kids, out = None, [], []

    def close():
        tree, parent, n = family
        above = (tree, parent, -(-n // ARITY))
        if len(kids) == min(ARITY, n - ARITY * parent):
            out.append((*above, digest_of([d for _, d in sorted(kids)]), None))
        else:
            out.extend((*above, d, pos % ARITY) for pos, d in kids)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], [*NODES, "slot"])

    for b in batches:
        for tree, pos, n, digest in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if family is None or family[:2] != (tree, pos // ARITY):
                if kids:
                    close()
                family, kids = (tree, pos // ARITY, n), []
            kids.append((pos, digest))
        if out:
            yield batch()
            out.clear()
    if kids:
        close()
        yield batch()


class Store:
    """The nodes of the trees whose leaves are df's rows (tree, digest, id, extra), in `order` within each tree."""

    def __init__(self, df: DataFrame, order: list[str], name: str):
        self.spark: SparkSession = df.sparkSession
        self.path = fresh_path(self.spark, name)
        by = ["tree", *order]
        runs = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), f"{name}_runs")
        runs = runs.withColumn("run", F.shiftright("at", 33))
        of = Window.partitionBy("tree")
        before = of.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        sizes = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
        sizes = sizes.select("tree", "run", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(of).alias("n"))
        placed = runs.join(sizes, ["tree", "run"]).select("tree", (F.col("at") - F.col("first") + F.col("offset")).alias("pos"), "n", "digest", F.lit(None).cast("int").alias("slot"), "id", "extra")
        placed.sortWithinPartitions("tree", "pos").write.parquet(f"{self.path}/level=0")
        n = sizes.agg(F.max("n")).first()[0] or 0
        self.depth = 0
        while n > 1:
            self._raise_level(self.depth)
            n, self.depth = -(-n // ARITY), self.depth + 1

    def _read(self, level: int) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.path}/level={level}")

    def _raise_level(self, level: int) -> None:
        below = self._read(level).where("n > 1 AND slot IS NULL").select(*NODES)
        above = f"{self.path}/level={level + 1}"
        below.mapInArrow(_fold, "tree string, pos long, n long, digest string, slot int").write.parquet(above)
        kids = F.sort_array(F.collect_list(F.struct("slot", "digest")))
        cut_families = self._read(level + 1).where("slot IS NOT NULL").groupBy("tree", "pos", "n").agg(kids.alias("kids"))
        whole = cut_families.select("tree", "pos", "n", F.sha2(F.concat_ws("", F.transform("kids", lambda x: x["digest"])), 256).alias("digest"), F.lit(None).cast("int").alias("slot"))
        whole.write.mode("append").parquet(above)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(f"{NODE}, level int").option("basePath", self.path).parquet(*[f"{self.path}/level={k}" for k in range(self.depth + 1)]).where("slot IS NULL").drop("slot")

    def roots(self) -> DataFrame:
        """tree, digest, level of each tree's root."""
        return self.nodes().where("n = 1").select("tree", "digest", "level")

    def scan(self, tails: DataFrame, emit, schema: str, base: int = 0) -> DataFrame:
        """emit(rows) for the nodes of level `base`: rows of (node's tree, pos, id, extra, digest, path, digest of the tree's root).
        tails: for each tree (tree, digest, level) of its root, and the path above it."""
        end = base + DEEP
        inner = self.nodes().where((F.col("level") >= base) & (F.col("level") < end) & ((F.col("n") > 1) | (F.col("level") == base)))
        block = F.expr(f"pos div element_at(array({', '.join(str(ARITY ** (end - k)) + 'L' for k in range(base, end))}), level - {base} + 1)")
        inner = inner.select("tree", block.alias("block"), "level", "pos", "n", "digest", F.lit(None).cast("string").alias("path"), "id", "extra")
        above = tails.where((F.col("level") >= base) & (F.col("level") < end)).select("tree", F.lit(0).cast("long").alias("block"), "digest", "path")
        if self.depth >= end:
            higher = self.scan(tails, _paths, "tree string, block long, digest string, path string", end)
            above = above.unionByName(cut(higher, f"paths_{end}"))
        none = {c: F.lit(None).cast(t) for c, t in (("pos", "long"), ("n", "long"), ("id", "long"), ("extra", "string"))}
        above = above.withColumns(none).withColumn("level", F.lit(-1))
        columns = [x.split()[0] for x in ROW.split(", ")]
        rows = inner.select(*columns).unionByName(above.select(*columns)).repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "pos")
        return rows.mapInArrow(_scanner(emit, base), schema)


def _scanner(emit, base: int):
    def paths(members, levels, counts, tree, tail, root):
        for pos, node, extra in members:
            steps, p = [], pos
            for level in range(base, base + DEEP):
                if counts.get(level, 1) == 1:
                    break
                first = p - p % ARITY
                steps.append(str(p % ARITY) + "".join(levels[level][q] for q in range(first, min(first + ARITY, counts[level])) if q != p))
                p //= ARITY
            yield tree, pos, node, extra, levels[base][pos], ",".join(steps + ([tail] if tail else [])), root

    def run(batches):
        key, members, levels, counts, tail, root = None, [], {}, {}, "", None
        for b in batches:
            found = []
            for tree, block, level, pos, n, digest, path, node, extra in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != (tree, block):
                    if key:
                        found.extend(paths(members, levels, counts, key[0], tail, root))
                    key, members, levels, counts, tail, root = (tree, block), [], {}, {}, "", None
                if level < 0:
                    tail, root = path, digest
                else:
                    levels.setdefault(level, {})[pos] = digest
                    counts[level] = n
                    if level == base:
                        members.append((pos, node, extra))
            if found:
                yield emit(found)
        if key:
            yield emit(list(paths(members, levels, counts, key[0], tail, root)))

    return run


def _batch(cols, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds.values(), strict=True)], list(kinds))


def _paths(rows) -> pa.RecordBatch:
    """For the scan of lower levels: where the path of each node as the root of a subtree goes."""
    tree, pos, _, _, _, path, root = zip(*rows, strict=True)
    return _batch((tree, pos, root, path), {"tree": pa.string(), "block": pa.int64(), "digest": pa.string(), "path": pa.string()})


def _source_paths(rows) -> pa.RecordBatch:
    _, _, _, extra, _, path, _ = zip(*rows, strict=True)
    return _batch((extra, path), {"tree": pa.string(), "path": pa.string()})


def _proofs(rows) -> pa.RecordBatch:
    _, _, node, extra, leaf, path, root = zip(*rows, strict=True)
    proofs = [proof_digest(p) for p in path]
    again = [folded(x or y, p) for x, y, p in zip(extra, leaf, path, strict=True)]
    kinds = {"doc_id": pa.int64()} | dict.fromkeys(("leaf", "subroot", "proof_sha256", "folded_root", "path"), pa.string())
    return _batch((node, leaf, root, proofs, again, path), kinds)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path for every row of docs."""
    own = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    c = {k: F.col(k) for k in own.columns}
    digest = lambda text: leaf_digest(c["doc_id"], c["source"], c["lang"], c["n_chars"], text)
    changed = without_line_ends(c["doc_id"], c["text"])
    tree = F.when(c["source"].isNull(), "0").otherwise(F.concat(F.lit("1"), c["source"]))
    leaves = own.select(tree.alias("tree"), digest(c["text"]).alias("digest"), c["doc_id"].alias("id"), F.when(changed.isNotNull(), digest(changed)).alias("extra"))
    documents = Store(cut(leaves, "leaves"), ["id", "digest"], "documents")
    roots = cut(documents.roots(), "subroots")
    sources = Store(roots.select(F.lit("").alias("tree"), "digest", F.lit(None).cast("long").alias("id"), F.col("tree").alias("extra")), ["extra"], "sources")
    root = (sources.roots().select("digest").first() or [None])[0]
    tops = sources.scan(sources.roots().withColumn("path", F.lit("")), _source_paths, "tree string, path string")
    tails = cut(roots.join(tops, "tree").select("tree", "digest", "level", "path"), "tails")
    proofs = documents.scan(tails, _proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, path string")
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"), "path")


def _levels(name: str, most: int = 20) -> str:
    """SQL: the levels of the trees in {name}0 (tree, pos, n, digest), up to 3 ** most leaves, and their families."""
    up = [
        f"{name}{k + 1} AS (SELECT tree, pos // 3 AS pos, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k} GROUP BY tree, pos // 3, n)"
        for k in range(most)
    ]
    families = " UNION ALL ".join(f"SELECT {k} AS k, tree, pos // 3 AS parent, list(digest ORDER BY pos) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 3" for k in range(most))
    return ", ".join([*up, f"{name}_families AS ({families})"])


def _climb(name: str, start: str) -> str:
    """SQL: proof and folded digest from {start} (row, tree, k, p, n, proof, fold) up to the roots."""
    step = "list_slice(d, 1, p % 3) || {0} || list_slice(d, p % 3 + 2, 3)"
    return (
        f"{name}_climb AS (SELECT row, tree, 0 AS k, p, n, proof, fold FROM {start} UNION ALL SELECT row, c.tree, c.k + 1, p // 3, (n + 2) // 3, proof || array_to_string({step.format('[]::VARCHAR[]')}, ''), sha256(array_to_string({step.format('[fold]')}, '')) "
        f"FROM {name}_climb c JOIN {name}_families f ON f.k = c.k AND f.tree = c.tree AND f.parent = c.p // 3 WHERE c.n > 1)"
    )


_SQL_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _SQL_FIELD + ")"
#: The checksum is the usual one, bit by bit for its table, then byte by byte.
ORACLE = (
    "WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc), "
    "x AS (SELECT row_number() OVER () AS row, *, CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 "
    "THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, t), "
    f"l AS (SELECT row, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {_SQL_LEAF.format('text')} AS leaf, {_SQL_LEAF.format('changed')} AS fold FROM x), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n, '' AS proof FROM l), "
    f"a0 AS (SELECT tree, p AS pos, n, leaf AS digest FROM o), {_levels('a')}, {_climb('a', 'o')}, "
    "s AS (SELECT tree AS source_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM a20), "
    f"b0 AS (SELECT '' AS tree, p AS pos, n, digest FROM s), {_levels('b')}, u AS (SELECT c.row, '' AS tree, s.p, s.n, c.proof, c.fold FROM a_climb c JOIN s ON s.source_tree = c.tree WHERE c.n = 1), {_climb('b', 'u')} "
    "SELECT o.doc_id, o.leaf, s.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = r.digest AS verified FROM b_climb c JOIN o USING (row) JOIN s ON s.source_tree = o.tree CROSS JOIN b20 r WHERE c.n = 1"
)
