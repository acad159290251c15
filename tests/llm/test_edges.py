"""Every operator and pipeline stage on empty tables, nulls, long texts, ties, repeated rows and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brevia.llm import bpe, chat, decontamination, html_text, ngram_join, pii, quality, sharding, toxicity, warc
from brevia.llm import queries as llm_queries

LONG = " ".join(f"word{k}" for k in range(25_000))
TEXTS = [None, None, "", " \t\n", "plain text of a few words", LONG, LONG, "Ärger mit Zeichen \U0001f600", "x" * 40_000, "mail a@b.example.com, call +1 949 555 3739"]
#: Names that the operators use for columns of their own.
CLASHES = "_gone leak_doc leak_row gone_doc gone_text judged_doc judged_row d r w h s i e n t lines host content table kept kept0 left touched found_spans ids decoded size slot shard block text_crc32 g bytes row_hash score positive spans level value".split()
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = [(k if k != 4 else None, text, "en", "s" if k % 2 else None, len(text or "")) for k, text in enumerate(TEXTS)]
    return out + out[4:6]  # repeated rows, one of them without an id


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), DOCUMENT)
    clashing = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return {"empty": docs.limit(0), "odd": docs, "clashing": clashing.repartition(2)}


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "plain text of a few words"), (2, None), (None, "Paris"), (1, "plain text of a few words")], "item_id long, text string")


def trained(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.train(docs, labels))


PER_ROW = {
    "toxicity": trained, "pii": pii.report, "ngram_join": ngram_join.join_documents, "bpe": bpe.encode_digests, "bpe documents": bpe.encode_documents, "quality": quality.judge, "sharding": sharding.shard_documents, "redact": pii.redact,
}


@pytest.mark.parametrize("name", PER_ROW)
@pytest.mark.parametrize("table", ["empty", "odd", "clashing"])
def test_a_row_for_every_row(tables, name, table):
    docs = tables[table]
    got = PER_ROW[name](docs).collect()
    want = [] if table == "empty" else [r[0] for r in rows()]
    assert sorted((r.doc_id for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("table", ["empty", "odd", "clashing"])
def test_filtering_stages_keep_all_columns(tables, benchmark, table):
    docs = tables[table]
    for kept in (quality.filtered(docs), ngram_join.deduplicated(docs), decontamination.clean(docs, benchmark), pii.redact(docs)):
        assert kept.dtypes == docs.dtypes
        for r in kept.collect():
            assert all(r[c] == f"own {c}" for c in CLASHES if c in docs.columns and c not in ("text",))
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    if table == "empty":
        return
    assert ids(quality.filtered(docs)) == [5, 5, 6]  # long enough, and not all one word
    assert 6 not in ids(ngram_join.deduplicated(docs)) and ids(ngram_join.deduplicated(docs)).count(5) == 2
    assert None not in ids(decontamination.clean(docs, benchmark)) and len(ids(decontamination.clean(docs, benchmark))) == len(rows()) - 2
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert masked[9] == ("mail [EMAIL], call [PHONE]", 26) and masked[0] == (None, None)


def test_encoded_documents_keep_their_columns(tables):
    got = bpe.encode_documents(tables["clashing"])
    assert [c for c in got.columns if c not in ("ids_", "decoded_")] == ["doc_id", *[c for c in tables["clashing"].columns if c not in ("doc_id", "text")]]
    r = got.where("doc_id = 0").first()
    assert r.ids == "own ids" and r.ids_ == [] and r.decoded_ == ""


def test_copies_are_treated_alike(tables):
    got = {}
    for r in quality.judge(tables["odd"]).collect() + ngram_join.join_documents(tables["odd"]).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got[5][0] == got[5][1] and got[5][-1] == got[5][-2] == got[6][-1] and got[5][-1][1] == 5
    shards = {}
    for r in sharding.shard_documents(tables["odd"]).collect():
        shards.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_benchmarks_that_are_empty_or_null(spark, tables, benchmark):
    for bench in (benchmark.limit(0), benchmark.where("text IS NULL")):
        assert decontamination.leaks(tables["odd"], bench).count() == 0
        assert decontamination.clean(tables["clashing"], bench).count() == len(rows())
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(tables["odd"], benchmark).collect()} == {(None, 1)}


PAGES = "page_id long, url string, html string, layout string, blocks string, host string, exemplar string, first string, size string"


def test_pages(spark):
    own = ("l", "b", "h", "e", "f", "s")
    html = "<p>" + "x " * 100_000 + "</p>"
    odd = [(1, None, None, *own), (2, "http://h.org", "", *own), (2, "http://h.org", "", *own), (None, "http://h.org", html, *own), (4, "no url", html, *own), (5, "http://h.org", "<div>" * 3000 + "deep", *own), (4, "no url", html, *own)]
    pages = spark.createDataFrame(odd, PAGES)
    text = " ".join(["x"] * 100_000)
    got = sorted(((r.page_id, r.text) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, ""), (2, ""), (2, ""), (None, text), (4, text), (4, text), (5, "deep")], key=repr)
    back = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()), key=repr)
    n = len(html)
    assert back == sorted([(1, 0, "response", None), (2, 0, "response", None), (2, 0, "response", None), (None, n, "revisit", 4), (4, n, "response", None), (4, n, "response", None), (5, 15_004, "response", None)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0 and warc.archive_pages(pages.limit(0)).count() == 0


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string, t string, turns string"
    odd = [(1, 0, "user", LONG, "p", "t", "x"), (1, 1, None, None, "p", "t", "x"), (1, 1, "assistant", "tie", "p", "t", "x"), (1, 1, "assistant", "tie", "p", "t", "x"), (None, None, "user", "", "p", "t", "x"), (None, 2, "user", "b", "p", "t", "x")]
    turns = spark.createDataFrame(odd, schema)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert got == {1: (4, 6), None: (2, 0)}
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("table", ["empty", "clashing"])
def test_stages(spark, tables, tmp_path, benchmark, stage, table):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = tables[table]
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == docs.dtypes
    assert out.count() <= docs.count() and (table != "empty" or out.count() == 0)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries.QUERIES) == list(range(1, 14))
