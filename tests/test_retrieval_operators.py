import io
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from brevia.functions import checks
from brevia.operators import evaluation, filters, search, vector
from brevia.plans import registry, retrieval
from brevia.sources import docx


def test_cosine_of_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_weights_sum_to_one():
    assert all(abs(sum(w[1:]) - 1) < 1e-12 for w in search.weights())


def test_selection_skips_copies_and_keeps_the_budget(spark):
    rows = [[(1, 0.9, 400, ["a", "b"]), (2, 0.8, 400, ["a", "b"]), (3, 0.7, 400, ["c"]), (4, 0.6, 400, ["d"])]]
    df = spark.createDataFrame([(r,) for r in rows], "r array<struct<id:bigint,sim:double,cost:int,words:array<string>>>")
    x = df.select(search.select_within_budget(F.col("r"), 5, 1000, marginal=0.0).alias("x")).first().x
    assert (x.ids, x.used, x.redundant, x.marginal, x.over) == ([1, 3], 800, 1, 0, 1)


def test_ranks_of_the_gain_begin_with_one(spark):
    # 0.8 / (1 + 0.12 * 2) / 400 is over the least gain, 0.8 / (1 + 0.12 * 3) / 400 isn't
    df = spark.createDataFrame([([(1, 0.9, 10, ["a"]), (2, 0.8, 400, ["b"]), (3, 0.8, 400, ["c"])],)], "r array<struct<id:bigint,sim:double,cost:int,words:array<string>>>")
    assert df.select(search.select_within_budget(F.col("r"), 5, 1000, marginal=0.0015).alias("x")).first().x.ids == [1, 2]


def test_hybrid_rank_puts_the_named_article_first(spark):
    meta = "struct<artigo:string,paragrafo:string,inciso:string,marca_stf:boolean,marca_stj:boolean,banca:string,updated_by_law:string,is_revoked:boolean,is_vetoed:boolean>"
    none = (None, None, None, False, False, None, None, False, False)
    rows = [(1, 1, 0.82, "x", none, "Art. 5 direitos fundamentais", 10), (1, 2, 0.72, "x", ("5", *none[1:]), "Art. 5 direitos fundamentais", 20)]
    df = spark.createDataFrame(rows, f"query_id int, pos int, similarity double, text string, meta {meta}, q string, doc_id int")
    got = [(r.doc_id, r.query_type) for r in search.reranked(df).orderBy("rank").collect()]
    assert got == [(20, "artigo"), (10, "artigo")]


def test_top_k_looks_at_all_rows_and_takes_ties_by_id(spark):
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(10)] + [(10, [0.0, 1.0, 0.0]), (11, None), (12, [0.0, 0.0, 0.0]), (13, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.vec_id, r.similarity) for r in vector.top_k(v, q, 3, 0.0).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 10, 1.0) and got[3:] == [(2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    assert vector.top_k(v.limit(0), q, 3).count() == 0 and vector.top_k(v, q.limit(0), 3).count() == 0


def test_filters_refuse_unknown_keys_and_shapes(spark):
    df = spark.createDataFrame([(("1", True),)], "meta struct<artigo:string,marca_stf:boolean>")
    for bad, error in (({"nope": 1}, ValueError), ({"__or__": {"artigo": "1"}}, TypeError), ({"__or__": ["x"]}, TypeError), ({"artigo": {"$gt": 1}}, TypeError)):
        with pytest.raises(error):
            filters.condition(bad, df)
    assert df.where(filters.condition({"__or__": [], "banca": "is_null", "artigo": "1"}, df)).count() == 1
    assert filters.merged({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3} and filters.merged(None, None) is None


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([("mail a.b@c.example.com, cpf 123.456.789-09, password: hunter22",)], "t string")
    assert df.select(checks.redact(F.col("t")).alias("x")).first().x == "mail ***EMAIL***, cpf ***CPF***, ***CREDENTIAL***"


def test_positions_of_values_without_a_global_order(spark):
    rows = [(k % 3, float((k * 7919) % 1000 // 10)) for k in range(5000)] + [(7, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {(r.k, r.name): r.found for r in evaluation.at_positions(df, "k", "v", {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).collect()}
    for k in (0, 1, 2, 7):
        own = sorted(v for x, v in rows if x == k)
        assert [got[k, n] for n in ("first", "mid", "last")] == [own[0], own[len(own) // 2], own[-1]]
    x = {r.k: r for r in evaluation.percentiles_exclusive(df, "k", "v", p1=1, p50=50, p99=99).collect()}
    for k in (0, 1, 2):
        want = statistics.quantiles([v for y, v in rows if y == k], n=100)
        assert [x[k].p1, x[k].p50, x[k].p99] == pytest.approx([want[0], want[49], want[98]])
    assert x[7].p50 == 0.0 and 8 not in x


def test_word_processor_files(spark):
    made = docx.written([("TÍTULO I Das coisas", "Heading 1"), ("Art. 5º Texto,", None), ("que segue revogado", None)], [["a", "b"]], ["rodapé", "rodapé"])
    good, failed = docx.parsed(spark.createDataFrame([("f.docx", made), ("g.docx", b"no zip"), ("h.docx", None)], "path string, content binary"))
    rows = good.orderBy("idx").collect()
    assert {(r.path, r.error) for r in failed.collect()} == {(p, "no word-processor document: BadZipFile") for p in ("g.docx", "h.docx")}
    assert [(r.source, r.text) for r in rows] == [("body", "TÍTULO I Das coisas"), ("body", "Art. 5º Texto,"), ("body", "que segue revogado"), ("table:r0c0", "a"), ("table:r0c1", "b"), ("footer:1", "rodapé")]
    assert rows[0].level == 1 and rows[0].line.kind == "titulo" and rows[1].line.value == "5" and rows[2].status.is_revoked
    assert [r.text for r in rows[1].runs] == ["Art. 5º Texto,"] and not rows[1].is_bold


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def test_bombs_and_odd_word_processor_files(monkeypatch):
    w = f'xmlns:w="{docx.W[1:-1]}"'
    run = '<w:r><w:rPr><w:b/><w:i w:val="0"/><w:u w:val="single"/><w:rFonts w:ascii="Arial"/><w:sz w:val="21"/></w:rPr><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r>'
    ((_, _, text, style, runs),) = docx.paragraphs(_zip(document=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="h"/></w:pPr>{run}</w:p></w:body></w:document>', styles=f'<w:styles {w}><w:style w:styleId="h"><w:name w:val="Heading 3"/></w:style></w:styles>'))
    assert (text, style, runs) == ("x\ty", "Heading 3", [{"text": "x\ty", "is_bold": True, "is_italic": False, "is_underline": True, "font_name": "Arial", "font_size": 10.5}])
    assert docx.paragraphs(_zip(document=f"<w:document {w}/>")) == []
    for bad, why in ((_zip(document="<!DOCTYPE x [<!ENTITY a 'aa'>]><x>&a;</x>"), "entities"), (_zip(document="<x>"), "ParseError"), (_zip(other="<x/>"), "KeyError"), (_zip(document=f"<w:document {w}/>")[:-30], "BadZipFile")):
        with pytest.raises(ValueError, match=why):
            docx.paragraphs(bad)
    monkeypatch.setattr(docx, "PART_BYTES", 1000)
    with pytest.raises(ValueError, match="unpacks"):
        docx.paragraphs(_zip(document=f"<w:document {w}>{' ' * 1000}</w:document>"))


def test_every_query_of_a_large_set_has_its_rows(spark):
    n = 2 * vector.BLOCK + 5
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    items = spark.range(n).select(F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, "alpha beta").otherwise("gamma").alias("text"))
    got = {(r.query_id, r.doc_id, r.score, r.rank) for r in search.like_top_k(docs, items).collect()}
    assert got == {x for k in range(n) for x in ([(k, 1, 2, 1), (k, 2, 1, 2)] if k % 2 == 0 else [(k, 2, 1, 1)])}
    v = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("embedding"))
    top = {(r.query_id, r.vec_id, r.similarity, r.rank) for r in vector.top_k(v.where("vec_id < 2"), v, 1).collect()}
    assert top == {(k, k % 2, 1.0, 1) for k in range(n)}


def test_retrieval_pipeline_serves_all_items(spark):
    data = "/root/testdata/sf0.001"
    items = {r.item_id for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert max(items) >= 20 and {r.query_id for r in retrieval.retrieval_pipeline(spark, data).collect()} == items


def test_candidates_of_both_kinds_have_their_own_similarity(spark, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(k, f"filler{k}") for k in range(100)] + [(500, "alpha beta gamma"), (600, "alpha beta other")], "doc_id long, text string", "documents")
    write([(0, "alpha beta gamma")], "item_id long, text string", "benchmark")
    write([(k, [1.0, 0.0]) for k in range(100)] + [(500, [0.6, 0.8])], "vec_id long, embedding array<float>", "embeddings")
    got = {r.doc_id: r.similarity for r in retrieval.candidates(spark, str(tmp_path)).collect()}
    # 50 semantic candidates, and the lexical one with a vector
    assert len(got) == 51 and got[500] == 0.6 and 600 not in got
