"""WARC archives: writing records for pages, and reading them back by boundary-chain verification.

Writing: each task writes archives through Spark's own writer, so any file system will do. Records are sorted into levels
by their size; a file of level k holds records_per_file / 4**k records of at most LEVEL_BYTES * 4**k bytes, so that
records_per_file * LEVEL_BYTES bounds every file but those of a single record. Of records with equal payloads of at least
REVISIT_BYTES bytes the one with the smallest page_id is a response, the others are revisits of it.

Reading: wherever the magic of a record stands, in a header or inside a payload, the task that reads its file emits a
candidate: its offset, that of its successor, and what its header says. By file, pointer jumping over the offsets from
the start of the file keeps only the candidates that the chain of true records reaches, in a logarithmic number of
steps, so magic inside payloads is rejected.

Defined results: null html is the empty payload; rows that share the smallest page_id of a payload are all responses;
a null page_id counts as larger than all others and is read back as null; an empty table gives empty archives and no
rows; other columns are ignored. A chain that doesn't end at the end of its file raises ValueError.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, give_back, pick

REVISIT_BYTES = 100
#: Digests with a smallest page_id that may be broadcast (32 + 8 bytes each).
BROADCAST_ROWS = 200_000
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
SEGMENT = 1 << 22
LEVEL_BYTES = 1 << 16
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _uuid(col):
    h = F.md5(col)
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-" if i < 21 else ">"))])


def records(pages: DataFrame, *more, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """value, the text of a whole record but for the two line ends that close it; and more columns."""
    html = F.coalesce("html", F.lit(""))
    p = pick(pages, page_id="long", url="string", html="string").withColumn("html", html).withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    first = p.where(F.col("size") >= REVISIT_BYTES).groupBy(F.unhex("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(first.where("n > 1 AND first IS NOT NULL").select("of", "first"), "first")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    p = p.join(first, F.unhex("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))
    if_any = lambda cond, text: F.when(cond, text).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"), head("Content-Length", F.col("size")), F.lit(EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    ident = lambda c: _uuid(F.concat_ws("|", F.lit("page"), c.cast("string")))
    return p.withColumn("block", block).select(
        F.concat(
            F.lit(f"WARC/1.0{EOL}"),
            head("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            head("WARC-Record-ID", ident(F.col("page_id"))),
            head("WARC-Date", F.lit(date)),
            head("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "")),
            head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            if_any(F.col("page_id").isNotNull(), head("X-Page-ID", F.col("page_id"))),
            if_any(revisit, F.concat(head("WARC-Profile", F.lit(PROFILE)), head("WARC-Refers-To", ident(F.col("first"))), head("X-Refers-To-Page-ID", F.col("first")))),
            F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
            head("Content-Length", F.octet_length("block")),
            F.lit(EOL),
            F.col("block"),
        ).alias("value"),
        *more,
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = 4000) -> None:
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit(""))) + 4096
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, size / LEVEL_BYTES))).cast("int")
    p = pick(pages, page_id="long", url="string", html="string")
    found = records(p, level.alias("level"))
    levels = sorted(r.level for r in p.select(level.alias("level")).distinct().collect())  # 32 at most
    for k in levels or [0]:  # an empty table makes an empty archive
        one = found.where(F.col("level") == k).select("value")
        one.write.option("lineSep", EOL * 2).option("maxRecordsPerFile", max(1, records_per_file >> 2 * k)).text(f"{path}/level{k}")


def candidates(data: bytes, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, successors) of all that looks like a record and begins in data[start:stop]."""
    offsets, successors = [], []
    for m in MAGIC.finditer(data, start, min(len(data), stop + 10)):
        if m.start() >= stop:
            break
        end = data.find(b"\r\n\r\n", m.end() - 2)
        length = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", data[m.end() - 2 : end + 2], re.I) if end >= 0 else None
        if length:
            offsets.append(m.start())
            successors.append(end + 4 + int(length[1]) + 4)
    return np.array(offsets, np.int64), np.array(successors, np.int64)


def reachable(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Sorted offsets of the records on the chain from 0; ValueError if it doesn't end at size."""
    if not size:
        return np.zeros(0, np.int64)
    order = np.argsort(offsets)
    offsets, successors = offsets[order], successors[order]
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    step = np.full(n + 2, n + 1)  # n: the end of the file, n + 1: nowhere
    step[n] = n
    hit = at < n
    hit[hit] = offsets[at[hit]] == successors[hit]
    step[:n][hit] = at[hit]
    step[:n][successors == size] = n
    seen = np.zeros(n + 2, bool)
    seen[0 if n and offsets[0] == 0 else n + 1] = True
    for _ in range(max(1, n).bit_length() + 1):
        seen[step[seen]] = True
        step = step[step]
    if not seen[n] or seen[n + 1]:
        raise ValueError("the chain of records breaks before the end of the file")
    return offsets[seen[:n]]


def chain(data: bytes) -> np.ndarray:
    """Offsets of a file's true records."""
    parts = [candidates(data, s, s + SEGMENT) for s in range(0, max(1, len(data)), SEGMENT)]
    return reachable(*[np.concatenate(x) for x in zip(*parts, strict=True)], len(data))


def parse(data: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of the record at an offset."""
    end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:end].decode("utf-8").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)", http, re.I)
    return headers | {"payload-length": length[1].decode() if length else str(len(payload))}, payload


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
CANDIDATE = f"file string, size long, start long, successor long, {READ}"


def _told(data: bytes, offset: int, payloads: bool) -> tuple:
    """What a candidate's header says, as READ; nulls where it isn't a record of ours."""
    try:
        h, payload = parse(data, offset)
        full = h["warc-type"] != "revisit"
        digest = hashlib.sha256(payload).hexdigest() if full else h["warc-payload-digest"].partition(":")[2]
        ids = [int(h[x]) if x in h else None for x in ("x-page-id", "x-refers-to-page-id")]
        return ids[0], h.get("warc-target-uri"), len(payload) if full else int(h["payload-length"]), digest, h["warc-type"], ids[1], payload if full and payloads else None
    except (KeyError, ValueError):
        return (None,) * 7


def read_candidates(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each candidate of each archive, CANDIDATE; and for each archive that isn't empty one with start -1."""

    def run(batches):
        names = [x.split()[0] for x in CANDIDATE.split(", ")]
        for b in batches:
            for k in range(b.num_rows):
                file, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, len(data), -1, -1, *(None,) * 7), KINDS, strict=True)], names)
                for start in range(0, len(data), SEGMENT):
                    rows = [(file, len(data), int(x), int(y), *_told(data, int(x), payloads)) for x, y in zip(*candidates(data, start, start + SEGMENT), strict=True)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names)
                del data
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(run, CANDIDATE)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each true record, READ; payload is null for revisits, and for all with payloads=False. The digest of a
    response is taken from its payload, that of a revisit from its header."""
    found = cut(read_candidates(spark, path, payloads), "candidates")

    def chained(part: pa.Table) -> pa.Table:
        offsets, successors = (part.column(c).to_numpy() for c in ("start", "successor"))
        true = reachable(offsets[offsets >= 0], successors[offsets >= 0], part.column("size")[0].as_py())
        return pa.table({"f": pa.array([part.column("file")[0].as_py()] * len(true), pa.string()), "true": true})

    true = found.select("file", "size", "start", "successor").groupBy("file").applyInArrow(chained, "f string, true long")
    kept = found.join(true, (F.col("file") == F.col("f")) & (F.col("start") == F.col("true")), "left_semi")
    return kept.select(*[x.split()[0] for x in READ.split(", ")])


def archive_pages(pages: DataFrame) -> DataFrame:
    """The contract's columns: pages written to the shared folder as archives, and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payloads=False).drop("payload", "url")


ORACLE = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
