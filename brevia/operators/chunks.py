"""Chunks of legal documents and of code.

A document comes as rows (doc_id, idx, text, style) of its paragraphs or lines, in order of idx. What only looks back (the
last heading, the last article) is a window; packing depends on what was packed before, so it is one fold over a
document's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions import code, legal
from brevia.functions.columns import let
from brevia.functions.patterns import Pattern
from brevia.functions.text import lexical_units

#: Tokens of a chunk at most (of a constitution's chunk), at least, and of what is repeated in the next.
MOST, MOST_OF_CONSTITUTION, LEAST, OVERLAP = 500, 300, 100, 50
#: Names of constitutions, and marks at a paragraph's start.
CONSTITUTIONS = ("cf", "constituicao", "constituição", "cf/88", "cf88")
START = (
    ("artigo", Pattern(r"^\s*Art\.?\s*(\d+[A-Za-z]?)\b", start=True)),
    ("paragrafo", Pattern(r"^\s*(?:§\s*([0-9]+|[úu]nico)\s*[º°]?|par[aá]grafo\s+([úu]nico|\d+)\b)", start=True)),
    ("inciso", Pattern(r"^\s*([IVXLCDM]+)\s*[-–—\)]", start=True)),
    ("alinea", Pattern(r"^\s*([a-z])\)", start=True)),
)


def start_mark(text: Column) -> Column:
    """struct<kind, value> of the mark that a paragraph begins with: content where there is none."""
    kind, value = F.lit("content"), F.lit(None).cast("string")
    for name, p in reversed(START):
        here = p.found(text)
        own = F.coalesce(p.first(text, 1), p.first(text, 2)) if name == "paragrafo" else p.first(text)
        own = {"paragrafo": F.lower(own), "alinea": F.lower(own), "inciso": F.upper(own)}.get(name, own)
        kind, value = F.when(here, name).otherwise(kind), F.when(here, own).otherwise(value)
    return F.struct(kind.alias("kind"), value.alias("value"))


def most_tokens(name: Column) -> Column:
    """The limit of a document of this name."""
    is_constitution = F.lit(False)
    for word in CONSTITUTIONS:
        is_constitution = is_constitution | F.lower(name).contains(word)
    return F.when(is_constitution, MOST_OF_CONSTITUTION).otherwise(MOST)


def in_context(paragraphs: DataFrame) -> DataFrame:
    """Each paragraph with mark (struct), level (of its heading style), and what stood last before it: titulo, capitulo,
    secao (headings of levels 1 to 3), artigo, paragrafo, inciso."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    df = paragraphs.withColumn("mark", start_mark(F.col("text"))).withColumn("level", legal.heading_level(F.col("style")))
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    heading = lambda n: last(F.when((F.col("level") == n) & (F.col("text") != ""), F.col("text")))
    marked = lambda kind: last(F.when(F.col("mark.kind") == kind, F.col("mark.value")))
    return df.withColumns({"titulo": heading(1), "capitulo": heading(2), "secao": heading(3), **{k: marked(k) for k in ("artigo", "paragrafo", "inciso")}})


def own_context(kind: Column, value: Column) -> dict[str, Column]:
    """What a chunk's first paragraph changes of the context before it, and its tipo."""
    is_ = lambda *names: kind.isin(*names)
    return {
        "artigo": F.when(is_("artigo"), value).otherwise(F.col("artigo")),
        "paragrafo": F.when(is_("paragrafo"), value).when(~is_("artigo"), F.col("paragrafo")),
        "inciso": F.when(is_("inciso"), value).when(~is_("artigo", "paragrafo"), F.col("inciso")),
        "tipo": kind,
    }


def blocks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, block, idx (of the first paragraph), kind, level, tokens, texts); empty paragraphs are left out. A block
    begins at each article, paragraph or item."""
    df = paragraphs.where("text != ''").withColumn("kind", start_mark(F.col("text"))["kind"]).withColumn("level", legal.heading_level(F.col("style"))).withColumn("tokens", lexical_units(F.col("text")))
    so_far = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) == 1
    df = df.withColumn("block", F.sum((F.col("kind").isin("artigo", "paragrafo", "inciso") & ~first).cast("int")).over(so_far))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text", "tokens", "kind", "level")))
    g = df.groupBy("doc_id", "block").agg(F.sum("tokens").alias("tokens"), parts.alias("p"))
    return g.select("doc_id", "block", F.col("p")[0]["idx"].alias("idx"), F.col("p")[0]["kind"].alias("kind"), F.col("p")[0]["level"].alias("level"), "tokens", "p")


PART = "struct<idx:bigint,text:string,tokens:int>"
STATE = "struct<cuts:array<struct<a:int,z:int>>,start:int,at:int,tokens:int>"


def packed(blocks_: Column, most: Column | int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> Column:
    """Array of chunks, each array<struct<idx, text, tokens>>, of array<struct<tokens, level, p>>. Before a block
    the chunk ends if it would grow over `most`, or if the block is a heading of level 1 or 2, and it has `least` tokens;
    the next one begins with as many of its last paragraphs as have `overlap` tokens at most, or else with its last.

    The fold goes over numbers alone: a chunk is a range of paragraphs, and its texts are cut out when all ranges are known."""
    most = F.lit(most) if isinstance(most, int) else most
    numbers = F.transform(blocks_, lambda b: F.struct(F.size(b["p"]).alias("n"), b["tokens"].cast("int").alias("tokens"), F.coalesce(b["level"], F.lit(99)).alias("level")))
    tokens = F.flatten(F.transform(blocks_, lambda b: F.transform(b["p"], lambda p: p["tokens"].cast("int"))))

    def tail(tokens_: Column, s: Column) -> Column:
        """The number and tokens of the paragraphs that the next chunk begins with."""
        if overlap <= 0:
            return F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"))
        own = F.slice(tokens_, s["start"] + 1, s["at"] - s["start"])
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))

        def step(x: Column, n: Column) -> Column:
            fits = ~x["full"] & (x["tokens"] + n <= overlap)
            return F.struct(F.when(fits, x["n"] + 1).otherwise(x["n"]).alias("n"), F.when(fits, x["tokens"] + n).otherwise(x["tokens"]).alias("tokens"), (~fits).alias("full"))

        kept = F.aggregate(F.reverse(own), start, step)
        return let(kept, lambda k: F.when(k["n"] > 0, F.struct(k["n"].alias("n"), k["tokens"].alias("tokens"))).otherwise(F.struct(F.lit(1).alias("n"), F.element_at(own, -1).alias("tokens"))))

    def folded(x: Column) -> Column:
        def step(s: Column, b: Column) -> Column:
            ends = ((s["tokens"] + b["tokens"] > most) | (b["level"] <= 2)) & (s["tokens"] >= least) & (s["at"] > s["start"])
            cut = lambda r: F.struct(
                F.concat(s["cuts"], F.array(F.struct(s["start"].alias("a"), s["at"].alias("z")))).alias("cuts"), (s["at"] - r["n"]).alias("start"), (s["at"] + b["n"]).alias("at"), (r["tokens"] + b["tokens"]).alias("tokens")
            ).cast(STATE)
            on = F.struct(s["cuts"].alias("cuts"), s["start"].alias("start"), (s["at"] + b["n"]).alias("at"), (s["tokens"] + b["tokens"]).alias("tokens")).cast(STATE)
            return F.when(ends, let(tail(x["tokens"], s), cut)).otherwise(on)

        start = F.struct(F.array().alias("cuts"), F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).alias("tokens")).cast(STATE)
        last = lambda s: F.when(s["at"] > s["start"], F.concat(s["cuts"], F.array(F.struct(s["start"].alias("a"), s["at"].alias("z"))))).otherwise(s["cuts"])
        return F.aggregate(x["blocks"], start, step, last)

    cuts = let(F.struct(numbers.alias("blocks"), tokens.alias("tokens")), folded)
    parts = F.flatten(F.transform(blocks_, lambda b: F.transform(b["p"], lambda p: F.struct(p["idx"].cast("bigint").alias("idx"), p["text"].alias("text"), p["tokens"].cast("int").alias("tokens")))))
    return let(F.struct(parts.alias("p"), cuts.alias("cuts")), lambda x: F.transform(x["cuts"], lambda c: F.slice(x["p"], c["a"] + 1, c["z"] - c["a"])))


def chunk_id(name: Column, seq: Column) -> Column:
    """C4."""
    return F.concat(F.trim(F.translate(name, "/\\ ", "--_")), F.lit("-"), F.lpad(seq.cast("string"), 4, "0"))


def hierarchy(context: Column) -> Column:
    """C4: the path of a chunk, from its title down to its item."""
    part = lambda k: F.when(F.coalesce(context[k], F.lit("")) != "", F.concat(F.lit(f"{k}:"), context[k]))
    return F.array_compact(F.array(*[part(k) for k in ("titulo", "capitulo", "secao", "artigo", "paragrafo", "inciso")]))


def chunked(paragraphs: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of documents; names: (doc_id, name). chunk_id, doc_id, seq, text, tokens, position, tipo,
    article, paragraph, item, path, parent_id, is_parent."""
    of_doc = blocks(paragraphs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "tokens", "level", "p"))).alias("b"), F.max("idx").alias("last")).join(names, "doc_id")
    c = of_doc.select("doc_id", "name", F.posexplode(packed(F.col("b"), most_tokens(F.col("name")))).alias("seq", "c"))
    text = F.array_join(F.transform("c", lambda p: p["text"]), "\n\n")  # white space ends a unit: a chunk has its paragraphs' units
    c = c.select("doc_id", "name", "seq", F.col("c")[0]["idx"].alias("idx"), F.size("c").alias("n"), text.alias("text"), F.aggregate("c", F.lit(0), lambda n, p: n + p["tokens"]).alias("tokens"))
    total = paragraphs.groupBy("doc_id").agg(F.count("*").alias("total"))
    ctx = in_context(paragraphs).select("doc_id", "idx", "mark", "titulo", "capitulo", "secao", "artigo", "paragrafo", "inciso")
    df = c.join(ctx, ["doc_id", "idx"]).join(total, "doc_id").withColumns(own_context(F.col("mark.kind"), F.col("mark.value")))
    effective = {"artigo": F.coalesce(legal.article(F.col("text")), F.col("artigo")), "paragrafo": F.coalesce(legal.paragraph(F.col("text")), F.col("paragrafo")), "inciso": F.coalesce(legal.item(F.col("text")), F.col("inciso"))}
    df = df.withColumns(effective).withColumn("position", F.round((F.col("idx") + F.col("idx") + F.col("n") - 1) / 2 / F.col("total"), 4)).withColumn("chunk_id", chunk_id(F.col("name"), F.col("seq")))
    path = hierarchy(F.struct("titulo", "capitulo", "secao", "artigo", "paragrafo", "inciso"))
    df = df.withColumn("path", path).withColumn("content_type", legal.content_type(F.col("text")))
    return with_parents(df).select("chunk_id", "doc_id", "seq", "text", "tokens", "position", "tipo", "artigo", "paragrafo", "inciso", "path", "content_type", "is_parent", "parent_id")


def with_parents(df: DataFrame) -> DataFrame:
    """is_parent and parent_id. A chunk whose tipo is artigo, or that has an article and no item, is a parent; one
    of the same article behind it is its child; examination questions are neither."""
    exam = F.col("content_type") == "exam_question"
    parent = ~exam & F.coalesce((F.col("tipo") == "artigo") | (F.col("artigo").isNotNull() & F.col("inciso").isNull()), F.lit(False))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(parent, F.struct("chunk_id", "artigo")), ignorenulls=True).over(before)
    child = ~exam & ~parent & F.col("artigo").isNotNull() & F.col("last").isNotNull() & (F.col("last.artigo").isNull() | (F.col("last.artigo") == F.col("artigo")))
    return df.withColumn("last", last).withColumn("is_parent", parent).withColumn("parent_id", F.when(child, F.col("last.chunk_id"))).drop("last")


def children(chunks: DataFrame) -> DataFrame:
    """(chunk_id, child_chunk_ids in order) of the parents that have children."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.where("parent_id IS NOT NULL").groupBy("doc_id", "parent_id").agg(ids.alias("child_chunk_ids")).select(F.col("parent_id").alias("chunk_id"), "child_chunk_ids")


def parent_links(chunks: DataFrame) -> DataFrame:
    """Distinct (parent, child, link_type) of rows (doc_id, chunk_id, parent_chunk_id, content_type, source_type,
    updated_by_law); the parent has to exist in the document."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    exam = (low(F.col("content_type")) == "exam_question") | (low(F.col("source_type")) == "exam_question")
    change = (low(F.col("source_type")) == "emenda_constitucional") | (F.coalesce("updated_by_law", F.lit("")) != "")
    kind = F.when(exam, "charged_in").when(change, "updates").otherwise("interprets")
    there = chunks.select("doc_id", F.col("chunk_id").alias("parent_chunk_id")).distinct()
    return chunks.join(there, ["doc_id", "parent_chunk_id"], "left_semi").select(F.col("parent_chunk_id").alias("parent"), F.col("chunk_id").alias("child"), kind.alias("link_type")).distinct()


#: What a neighbour of a constitution's chunk is to it.
NEIGHBOURS = {"jurisprudencia": "interpreta", "questao_prova": "cobrada_em", "emenda_constitucional": "atualizacao", "comentario": "interpreta"}


def neighbour_links(chunks: DataFrame, reach: int = 5) -> DataFrame:
    """(chunk, linked, link_type) between chunks of source_type lei_cf and neighbours of the other kinds at most `reach`
    positions apart, where one has no article or both the same. chunks: doc_id, pos, chunk_id, source_type, artigo. Bins of
    `reach` positions make it an equi join, so no task holds a whole document."""
    other = F.create_map(*[F.lit(x) for pair in NEIGHBOURS.items() for x in pair])
    one = chunks.where("source_type = 'lei_cf'").select("doc_id", F.col("pos").alias("p"), F.col("chunk_id").alias("chunk"), F.col("artigo").alias("a"))
    one = one.withColumn("bin", F.explode(F.sequence(F.floor((F.col("p") - reach) / reach), F.floor((F.col("p") + reach) / reach))))
    two = chunks.where(F.col("source_type").isin(*NEIGHBOURS)).withColumn("bin", F.floor(F.col("pos") / reach))
    j = one.join(two, ["doc_id", "bin"]).where(F.abs(F.col("p") - F.col("pos")) <= reach).where("a IS NULL OR artigo IS NULL OR a = '' OR artigo = '' OR a = artigo")
    return j.select("chunk", F.col("chunk_id").alias("linked"), F.element_at(other, F.col("source_type")).alias("link_type"))


def continuations(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, idx, text) with kind (E12) and continues: the kind of the article, paragraph or item that the line
    before has, if this line has none and begins in lower case or that line ends in a comma, semicolon or colon."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    df = lines.withColumn("kind", legal.line_kind(F.col("text"))["kind"])
    was, said = F.lag("kind").over(order), F.lag("text").over(order)
    open_ = F.rtrim(said).rlike(r"[,;:]$") | F.col("text").rlike(r"^\p{Ll}")
    return df.withColumn("continues", F.when((F.col("text") != "") & F.col("kind").isNull() & was.isin("paragrafo", "inciso", "artigo") & open_, was))


#: Tokens of a chunk of code at most and at least.
CODE_MOST, CODE_LEAST = 300, 50
CODE_PART = "struct<first:int,last:int,text:string>"


def code_chunks(text: Column, language: Column, most: int = CODE_MOST, least: int = CODE_LEAST) -> Column:
    """array<struct<first, last (lines from 1), text>>. A file of at most `most` tokens is one chunk; else a chunk ends
    before a line that declares something if it has `least` tokens, and before one with which it would have more than
    `most`."""
    state = f"struct<done:array<{CODE_PART}>,lines:array<string>,tokens:int,first:int>"
    start = F.struct(F.array().alias("done"), F.array().alias("lines"), F.lit(0).alias("tokens"), F.lit(1).alias("first")).cast(state)
    told = lambda s: F.struct(s["first"].alias("first"), (s["first"] + F.size(s["lines"]) - 1).alias("last"), F.array_join(s["lines"], "\n").alias("text")).cast(CODE_PART)

    def step(s: Column, x: Column) -> Column:
        some = F.size(s["lines"]) > 0
        ends = some & ((x["starts"] & (s["tokens"] >= least)) | (s["tokens"] + x["n"] > most))
        after = F.struct(F.concat(s["done"], F.array(told(s))).alias("done"), F.array(x["line"]).alias("lines"), x["n"].alias("tokens"), (s["first"] + F.size(s["lines"])).alias("first"))
        on = F.struct(s["done"].alias("done"), F.concat(s["lines"], F.array(x["line"])).alias("lines"), (s["tokens"] + x["n"]).alias("tokens"), s["first"].alias("first"))
        return F.when(ends, after.cast(state)).otherwise(on.cast(state))

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), lexical_units(x).alias("n"), code.is_boundary(x, language).alias("starts")))
    split = F.aggregate(lines, start, step, lambda s: F.when(F.size(s["lines"]) > 0, F.concat(s["done"], F.array(told(s)))).otherwise(s["done"]))
    whole = F.array(F.struct(F.lit(1).alias("first"), F.size(F.split(text, "\n")).alias("last"), text.alias("text")).cast(CODE_PART))
    return F.when(F.trim(text) == "", F.array().cast(f"array<{CODE_PART}>")).when(lexical_units(text) <= most, whole).otherwise(split)
