"""Findings of round 3, each by a test that failed before."""

import duckdb
from pyspark.sql import functions as F

from brevia.plans import registry


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, map(tuple, df[cols].astype(str).values)))


def both(spark, name, folder, **tables):
    """A query and its SQL over these tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return rows(registry.QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(registry.ORACLES[name]).df())


def test_f1_ids_of_more_than_six_digits(spark, tmp_path):
    e = spark.createDataFrame([(5, 0), (999_999, 1), (1_000_000, 2), (5_999_999, 3), (-7, 4), (None, 5), (8, None)], "event_id long, s long")
    e = e.select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"))
    got, want = both(spark, "correlation_ids", tmp_path, events=e)
    assert got == want


#: Letters that a pattern without case takes for ASCII ones, marks at starts, and near misses.
ODD_TEXTS = [
    "ModeK x", "ſYſTEM : y", "aſſiſtant:", "JAİL BREAK", "jaılbreak", "İgnore all previous instructİons", "  } {", "x } {", "\n] [", '{"a": "b"}', "{\n\"a\" : \"b\" }", "DAN", "dane", "act  as\tan x",
    "for the rest of this chat", "you are now an x", "[inst] a\nb [/inst]", "<|IM_END|>", "{{x}}", "{ {x} }", "${a}", "", None, " ", "eſTelionato", "crİme militar", "CRİMEſ  HEDIONDOſ", "LEİ nº 8.072/90", "Lei ٣٤", "ART. 5", "arť 5",
    "parÁgrafo ÚNICO", "§§ 3", "INCLUÍDO  PELA\nLEİ 11.340", "31/12/1999", "(ABC-2013)", "ABC 2013", "ſúmula 7", "SÚMULA A7", "İnfo 12", "FUMARC", "ſTF :", "#ATENÇÃO:", "Trıbunal  de Contas da UniÃo", "EC 45", "ec nº 45", "penal", "ação penal pública",
]


def unhinted(patterns):
    from brevia.functions.patterns import Pattern

    return [Pattern(p.text, p.flags) for p in patterns]


def test_f11_patterns_go_over_texts_that_can_match(spark):
    from brevia.functions import checks
    from brevia.functions.patterns import ODD, plain

    assert all(p.needs or p.start for p in checks.INJECTION)
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS], "x string")
    found = df.select(*[p.found(F.col("x")).alias(f"a{k}") for k, p in enumerate(checks.INJECTION)], *[p.found(F.col("x")).alias(f"b{k}") for k, p in enumerate(unhinted(checks.INJECTION))]).collect()
    n = len(checks.INJECTION)
    assert all(list(r)[:n] == list(r)[n:] for r in found) and sum(map(bool, [v for r in found for v in r[:n]])) > 15
    # no other letter of Unicode is taken for an ASCII one
    letters = spark.range(0x80, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).where(F.col("c").rlike("(?iUd)[a-z]"))
    assert {r.c for r in letters.collect()} == set(ODD)
    assert {r.c for r in letters.select(plain(F.col("c")).alias("c")).collect()} == set("isk")


def test_f5_records_of_texts_that_can_match(spark):
    from brevia.functions import legal

    own = [legal.ARTICLE, legal.PARAGRAPH, legal.BOARD, legal.YEAR, legal.LAW, legal.UPDATED_BY, legal.DATE, legal.EXAM_REFERENCE, legal.EXAM_MARK, legal.PRECEDENT, legal.AMENDMENT_NUMBER, *legal.MARKS.values()]
    assert all(p.needs for p in own)
    df = spark.createDataFrame([(x,) for x in ODD_TEXTS], "x string")
    x = F.col("x")
    for of in (lambda p: p.found(x), lambda p: p.first(x, 0), lambda p: p.every(x, 0)):
        found = df.select(*[of(p).alias(f"a{k}") for k, p in enumerate(own)], *[of(p).alias(f"b{k}") for k, p in enumerate(unhinted(own))]).collect()
        assert all(list(r)[: len(own)] == list(r)[len(own) :] for r in found)


def test_f4_starts_and_units_once(spark):
    from brevia.functions import legal
    from brevia.functions.text import lexical_units
    from brevia.operators import chunks

    starts = [p for _, p in chunks.START] + [p for _, p, _ in legal.LINES if p.text.startswith("^")]
    assert all(p.start for p in starts)
    texts = ["Art. 5A x", "x Art. 5", " § Único", "PARÁGRAFO 12 x", "XIV) x", "İV - x", "a) x", "ab) x", "", None, "\n\tI", "TÍTULO İV x", "nota: x", "subseÇão 3 x", " § 3"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for of in (lambda p: p.found(F.col("x")), lambda p: p.first(F.col("x"), int("([" in p.text)), lambda p: p.first(F.col("x"), 0)):
        found = df.select(*[of(p).alias(f"a{k}") for k, p in enumerate(starts)], *[of(p).alias(f"b{k}") for k, p in enumerate(unhinted(starts))]).collect()
        assert all(list(r)[: len(starts)] == list(r)[len(starts) :] for r in found)
    lines = [(1, k, f"{'Art. ' + str(k) if k % 5 == 0 else ''} wörds ﬁ ́x, of.the/line {k} " * 9, None) for k in range(60)]
    p = spark.createDataFrame(lines, "doc_id long, idx long, text string, style string")
    made = chunks.chunked(p, spark.createDataFrame([(1, "Lei")], "doc_id long, name string"))
    assert made.select("text", "tokens")._jdf.queryExecution().optimizedPlan().toString().count("[a-z0-9_]+|") == 1
    rows_ = made.select("tokens", lexical_units(F.col("text")).alias("n")).collect()
    assert len(rows_) > 3 and all(r.tokens == r.n for r in rows_)


def test_f6_f10_records_behind_needs(spark, tmp_path):
    texts = ["Art. 5 da Lei 8.112/90 vetado", "STF: Info 12", "31/12/2005 Art. 7", "ABC-2013 FGV 2010", "nada", "", "§ 3º revogado", "SÚMULA 7", "IV - x\nart. 9-B", "(FCC-2010)"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    for name in ("extracted_boosts", "extracted_citations"):
        got, want = both(spark, name, tmp_path / name, documents=docs)
        assert got == want
        plan = registry.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().optimizedPlan().toString()
        assert "_plain" in plan


def test_f2_postings_stay_with_their_stripe(spark, monkeypatch):
    from brevia.operators import search, word_index

    monkeypatch.setattr(word_index, "STRIPE_ROWS", 10)
    docs = spark.createDataFrame([(k, None if k % 50 == 7 else f"b a b w{k % 7} w{k % 7} ção w{k}" if k % 11 else " ") for k in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "aaa w3 b"), (2, "w11 ção w5"), (3, "w6")], "item_id long, text string")
    index = word_index.build(docs.where("doc_id < 120")).insert(docs.where("doc_id >= 120")).delete(docs.where("doc_id % 9 = 0").select("doc_id"))
    assert {r.doc_id: (r.doc_len, dict(zip(r.words, r.tfs))) for r in index._all("documents").where("doc_id IN (5, 7, 11)").collect()} == {5: (7, {"a": 1, "b": 2, "cao": 1, "w5": 3}), 7: (0, {}), 11: (0, {})}
    left = docs.where("doc_id % 9 != 0")
    assert rows(index.search(items).toPandas()) == rows(search.bm25(left, items).toPandas()) == rows(index.merged().search(items).toPandas())
    # one shuffle carries documents, none their postings
    seen = []
    monkeypatch.setattr(type(docs.write), "parquet", lambda self, path, *a, **k: seen.append(self._df))
    index._write(index._all("documents"), 9)
    assert seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_f3_a_task_holds_few_files():
    import pyarrow as pa

    from brevia.plans import sources

    texts = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(["a\nb"] * 1000)], ["doc_id", "text"])
    made = list(sources.file_writer()(iter([texts])))
    assert sum(b.num_rows for b in made) == 1000 and max(b.num_rows for b in made) <= sources.FILES


def test_f7_f8_f9_texts_stay_where_they_are(spark, monkeypatch):
    from brevia.operators import ingest, library

    plans, real = [], library.Library._write

    def seen(self, df, name, *rest, **counters):
        if name == "chunks":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(self, df, name, *rest, **counters)

    monkeypatch.setattr(library.Library, "_write", seen)
    how = {"parse": library.text_lines, "chunk": library.line_chunks, "embed": lambda x: ingest.hashed_embedding(x, 4)}
    files = lambda *rows_: spark.createDataFrame([(p, "n", c) for p, c in rows_], "path string, name string, content binary")
    lib = library.Library.opened(spark).load(files(("a", b"one\ntwo\ntwo"), ("b", b"three"), ("c", b"\xff")), "1", **how)
    lib = lib.load(files(("a", b"two\none\nnine"), ("d", b"four\none"), ("e", b"\xff")), "2", **how)
    assert "Window" not in plans[0] and "strategy=broadcast" in plans[0]  # of new documents no chunk looks for a vector
    assert {(r.text, r.reused) for r in lib.chunks().collect()} == {("two", True), ("one", True), ("nine", False), ("three", False), ("four", False), ("one", False)}
    assert [(r.new, r.changed, r.failed, r.chunks, r.reused, r.embedded) for r in lib.ledger().orderBy("gen").collect()] == [(2, 0, 1, 4, 0, 4), (1, 1, 1, 5, 2, 3)]
    assert {(r.path, r.error, r.gen) for r in lib.failures().collect()} == {("c", "not UTF-8", 1), ("e", "not UTF-8", 2)}


def test_f12_words_without_white_space_and_scores_by_document(spark):
    from brevia.functions.text import fold, fold_letters
    from brevia.operators import search

    texts = [*ODD_TEXTS, "a b ção  ﬁ́x", "ASCII only\x1cx", "Straße ½ №5", "　x\u0085y"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    of = lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    assert all(r.a == r.b == r.c for r in df.select(of(fold("x")).alias("a"), of(fold_letters("x")).alias("b"), search.words(F.col("x")).alias("c")).collect())
    docs, items = spark.createDataFrame([(k, f"alpha beta w{k % 3} alpha") for k in range(30)], "doc_id long, text string"), spark.createDataFrame([(1, "alpha w1")], "item_id long, text string")
    plan = search.bm25(docs, items)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange hashpartitioning(query_id" in plan and not any("doc_id" in x.split("(")[1] and "query_id" in x for x in plan.splitlines() if "Exchange hashpartitioning(" in x)


#: What texts are put together from, so that many patterns match in them or nearly do.
PARTS = [
    "Art. 5-A", "art 7º", "§ 3º", "§ único", "parágrafo ÚNICO", "\nIV - x", "\n  Inciso ix)", "\nmmxx", "XIV", "\n\n", " – ", "iv", "\nM.", "(STF)", "STJ:", "#TCU:", "FUMARC", "mpsp", "TRF4", "1999", "2013", "(ABC-2013)", "(FCC-10)",
    "Lei nº 8.112/90", "LC 7", "EC 45", "ec nº 9", "incluído pela Lei 11.340/2006", "31/12/2005", "01/02/1999", "Súmula 7", "Info 12", "doutrina", "dica", "atenção", "revogado", "VETADO", "parcialmente", "homicídio", "pena de multa", "ç", " ", ".", "nada",
]


def mixed_texts(n, parts=PARTS, gaps=(" ", "\n")):
    """Texts, each of up to eight parts, alike at every call."""
    from random import Random

    dice = Random(6)
    return [dice.choice(gaps).join(dice.choice(parts) for _ in range(dice.randrange(9))) for _ in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f6_boosts_go_by_what_they_ask(spark, tmp_path):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(mixed_texts(1500))], "doc_id long, text string")
    got, want = both(spark, "extracted_boosts", tmp_path, documents=docs)
    assert got == want and len(got) > 20
    plan = plan_of(registry.QUERIES["extracted_boosts"](spark, str(tmp_path)))
    # no pattern or word that a boost doesn't need, and records that are alike meet the questions once
    assert not [x for x in ("homic", "hediondo", "doutrina", "#tcu", "(LC|", "Lei|LC|EC", "mula", "parcial") if x in plan]
    assert plan.index("Join Cross") < plan.rindex("Aggregate [")


def test_f6_records_are_those_of_single_fields(spark):
    from brevia.functions import legal

    odd = [*PARTS, "\n  İncıſo ix)", "\nİV -", "ſ", "\u212a"]
    df = spark.createDataFrame([(x,) for x in mixed_texts(1500, odd, ("", " ", "\n")) + ODD_TEXTS], "x string")
    t = F.coalesce("x", F.lit(""))
    one = {
        "article": legal.article(t), "paragrafo": legal.paragraph(t), "inciso": legal.item(t), "law_number": legal.law_number(t), "updated_by_law": legal.updated_by(t), "valid_from": legal.valid_from(t), "banca": legal.board(t), "ano": legal.year(t),
        "exam_references": legal.exam_references(t), "exam_marks": legal.exam_marks(t), "jurisprudence_linked": legal.precedents(t), "content_type": legal.content_type(t), "source_type": legal.source_type(t, legal.content_type(t)),
    }
    one |= {v: legal.marks(t)[k] for k, v in legal.MARK_NAMES.items()} | {k: legal.status(t)[k] for k in ("is_revoked", "veto_scope", "temporal_confidence")} | {"effective_text_version": legal.status(t)["version"]}
    found = legal.described(df, "x", secao=F.length("x"))
    assert found.columns == ["x", "meta"] and found.where("meta.secao <> length(x) OR meta.documento <> 'Unknown'").isEmpty()
    found = found.select(*[F.col(f"meta.{k}").alias(f"a_{k}") for k in one], *[c.alias(f"b_{k}") for k, c in one.items()]).collect()
    assert not [(k, r[f"a_{k}"], r[f"b_{k}"]) for r in found for k in one if r[f"a_{k}"] != r[f"b_{k}"]]
    assert sum(r.a_inciso is not None for r in found) > 100


def test_f10_citations_go_by_what_they_ask(spark, tmp_path):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(mixed_texts(1500))], "doc_id long, text string")
    got, want = both(spark, "extracted_citations", tmp_path, documents=docs)
    assert got == want and len(set(got)) > 500
    plan = plan_of(registry.QUERIES["extracted_citations"](spark, str(tmp_path)))
    assert not [x for x in ("homic", "hediondo", "#tcu", "Lei|LC|EC", "inclu[", "parcial") if x in plan]
    # the letters of a text are made once: for the 17 inline texts and for the documents
    assert plan.count("iisk") == 2
