"""SRC1: word-processor documents as rows of paragraphs.

A file is a zip of XML parts. Body paragraphs and those in table cells come in the order of the document, then the
footers' paragraphs, each text and style once. A file that is broken, or whose parts would unpack to more than PART_BYTES, or
that declares entities, is a row of its path and what is wrong with it; the others don't mind. Files are read by Spark's own
binary reader and not by a Python data source, since that couldn't open a store that only Spark reads."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.functions import legal
from brevia.storage import kept

#: Names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY, STYLES = "word/document.xml", "word/styles.xml"
#: Bytes that a part may unpack to.
PART_BYTES = 256_000_000


def _on(run, name: str) -> bool:
    found = run.find(f"{W}rPr/{W}{name}")
    return found is not None and found.get(f"{W}val") not in ("0", "false", "none")


def _run(run) -> dict:
    said = "".join("\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else x.text or "" for x in run if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr"))
    font, size = run.find(f"{W}rPr/{W}rFonts"), run.find(f"{W}rPr/{W}sz")
    half_points = size.get(f"{W}val") if size is not None else None
    return {
        "text": said, "is_bold": _on(run, "b"), "is_italic": _on(run, "i"), "is_underline": _on(run, "u"), "font_name": font.get(f"{W}ascii") if font is not None else None,
        "font_size": int(half_points) / 2 if (half_points or "").isdigit() else None,
    }


def _paragraph(p) -> tuple[str, str | None, list[dict]]:
    """Text, style id and runs."""
    style, runs = p.find(f"{W}pPr/{W}pStyle"), [_run(r) for r in p.iter(f"{W}r")]
    return "".join(r["text"] for r in runs), style.get(f"{W}val") if style is not None else None, runs


def _part(z: zipfile.ZipFile, name: str):
    """The XML of a part. Its declared size is checked before, what it really unpacks to while it is read."""
    with z.open(name) as f:
        data = f.read(PART_BYTES + 1) if z.getinfo(name).file_size <= PART_BYTES else b" " * (PART_BYTES + 1)
    if len(data) > PART_BYTES:
        raise ValueError(f"{name} unpacks to more than {PART_BYTES} bytes")
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ET.fromstring(data)


def paragraphs(content: bytes) -> list[tuple[int, str, str, str | None, list[dict]]]:
    """(idx, source, text, style's name, runs) of a file; raises ValueError where it is none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        body = _part(z, BODY).find(f"{W}body")
        styles = _part(z, STYLES) if STYLES in z.namelist() else ()
        footers = [_part(z, n) for n in sorted(z.namelist()) if n.startswith("word/footer") and n.endswith(".xml")]
    except (zipfile.BadZipFile, zlib.error, EOFError, KeyError, NotImplementedError, ET.ParseError) as e:
        raise ValueError(f"no word-processor document: {type(e).__name__}") from e
    names = {}
    for s in styles.iter(f"{W}style") if styles != () else ():
        name = s.find(f"{W}name")
        names[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
    found = []
    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            found.append(("body", child))
        elif child.tag == f"{W}tbl":
            for r, row in enumerate(child.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    found += [(f"table:r{r}c{c}", p) for p in cell.findall(f"{W}p")]
    out, seen = [], set()
    for source, p in found:
        text, style, runs = _paragraph(p)
        out.append((len(out) + 1, source, text, names.get(style, style), runs))
    for footer in footers:
        for p in footer.iter(f"{W}p"):
            text, style, runs = _paragraph(p)
            if (key := (text.strip(), style)) not in seen and text.strip():
                seen.add(key)
                out.append((len(out) + 1, f"footer:{len(seen)}", text, names.get(style, style), runs))
    return out


RUN = "struct<text:string,is_bold:boolean,is_italic:boolean,is_underline:boolean,font_name:string,font_size:double>"
RAW = f"path string, idx int, source string, text string, style string, runs array<{RUN}>, error string"


def read(files: DataFrame) -> DataFrame:
    """RAW of files (path, content): a row for each paragraph; of a file that can't be read one row with the error."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("is_bold", pa.bool_()), ("is_italic", pa.bool_()), ("is_underline", pa.bool_()), ("font_name", pa.string()), ("font_size", pa.float64())]))
    kinds = {"path": pa.string(), "idx": pa.int32(), "source": pa.string(), "text": pa.string(), "style": pa.string(), "runs": kind, "error": pa.string()}

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                path = b.column(0)[k].as_py()
                try:
                    rows = [(path, *p, None) for p in paragraphs(b.column(1)[k].as_py() or b"")]
                except ValueError as e:
                    rows = [(path, None, None, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return files.select("path", "content").mapInArrow(run, RAW)


def described(raw: DataFrame) -> DataFrame:
    """Paragraphs of read() with the heading's level (E13), the kind of line (E12), the kind it goes on with (W6), flags of
    revocation and veto, and whether all text is bold and italic."""
    order = Window.partitionBy("path").orderBy("idx")
    df = raw.where("error IS NULL").drop("error").withColumn("level", legal.heading_level(F.col("style"))).withColumn("line", legal.line_kind(F.col("text")))
    was, said = F.lag(F.col("line.kind")).over(order), F.lag("text").over(order)
    goes_on = (F.col("text") != "") & F.col("line.kind").isNull() & was.isin("paragrafo", "inciso", "artigo") & (F.rtrim(said).rlike(r"[,;:]$") | F.col("text").rlike(r"^\p{Ll}"))
    filled = F.filter("runs", lambda r: F.trim(r["text"]) != "")
    every = lambda k: ((F.size(filled) > 0) & F.forall(filled, lambda r: r[k])).alias(k)
    return df.withColumn("continues", F.when(goes_on, was)).withColumn("status", legal.status(F.col("text"))).select("*", every("is_bold"), every("is_italic"))


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The described() paragraphs of files (path, content), and (path, error) of those that can't be read. Files are read once."""
    raw = kept(read(files), "paragraphs")
    return described(raw), raw.where("error IS NOT NULL").select("path", "error")


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """parsed() of all files in a folder and below."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder)
    return parsed(files)


def written(lines: list[tuple[str, str | None]], table: list[list[str]] = (), footer: list[str] = ()) -> bytes:
    """A small file of paragraphs (text, style), a table and footers."""
    p = lambda text, style=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{escape(style)}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"
    wrap = lambda name, inner: f'<?xml version="1.0" encoding="UTF-8"?><w:{name} xmlns:w="{W[1:-1]}">{inner}</w:{name}>'.encode()
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in row) + "</w:tr>" for row in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # equal documents are equal files
        z.writestr(part(BODY), wrap("document", "<w:body>" + "".join(p(*x) for x in lines) + (f"<w:tbl>{rows}</w:tbl>" if rows else "") + "</w:body>"))
        for k, text in enumerate(footer):
            z.writestr(part(f"word/footer{k}.xml"), wrap("ftr", p(text)))
    return out.getvalue()
