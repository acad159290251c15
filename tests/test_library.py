"""Loading batches of files: what is parsed, embedded, kept and counted."""

import pytest
from pyspark.sql import functions as F

from brevia.operators import ingest, library
from brevia.sources import docx

FILE = "path string, name string, content binary"
HOW = {"parse": library.text_lines, "chunk": library.line_chunks, "embed": lambda x: ingest.hashed_embedding(x, 4)}


def files(spark, *rows):
    return spark.createDataFrame([(p, "n", c.encode() if isinstance(c, str) else c) for p, c in rows], FILE)


def state(lib):
    text = lib.chunks().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return {r.path: (r.status, [x.text for x in r.x]) for r in lib.documents().join(text, "doc_id").collect()}


@pytest.fixture(scope="module")
def first(spark):
    return library.Library.opened(spark).load(files(spark, ("a", "one\ntwo\ntwo"), ("b", "three"), ("c", "four"), ("d", " \n"), ("e", b"\xff")), "first", **HOW)


def test_first_batch(first):
    assert state(first) == {"a": ("new", ["one", "two", "two"]), "b": ("new", ["three"]), "c": ("new", ["four"])}
    assert {(r.path, r.error) for r in first.failures().collect()} == {("d", "no text"), ("e", "not UTF-8")}
    assert first.ledger().drop("batch").collect()[0].asDict() == {"gen": 1, "new": 3, "changed": 0, "unchanged": 0, "failed": 2, "deleted": 0, "chunks": 5, "reused": 0, "embedded": 5, "tokens": 5}


def test_changes_moves_and_failures(spark, first):
    # a changes; b's content now lies at c, whose own document goes; x is new; a broken b leaves nothing, since b's document moved
    lib = first.load(files(spark, ("a", "two\none\nnine"), ("c", "three"), ("x", "four"), ("b", b"\xff\xff")), "second", **HOW)
    assert state(lib) == {"a": ("changed", ["two", "one", "nine"]), "c": ("unchanged", ["three"]), "x": ("unchanged", ["four"])}
    counters = lib.ledger().where("gen = 2").first()
    assert (counters.changed, counters.unchanged, counters.new, counters.failed, counters.reused, counters.embedded) == (1, 2, 0, 1, 2, 1)
    vectors = {r.text: r.embedding for r in lib.chunks().collect()}
    old = {r.text: r.embedding for r in first.chunks().collect()}
    assert all(vectors[t] == old[t] for t in ("one", "two", "three", "four"))
    again = lib.load(files(spark, ("a", "else")), "second", **HOW)
    assert state(again) == state(lib) and again.ledger().count() == 2
    # a document that can't be parsed any more stays as it was
    assert state(lib.load(files(spark, ("a", b"\xfe")), "third", **HOW))["a"] == ("kept", ["two", "one", "nine"])


def test_a_document_whose_path_has_anothers_content_goes(spark):
    lib = library.Library.opened(spark).load(files(spark, ("a", "one"), ("b", "two")), "1", **HOW).load(files(spark, ("a", "two")), "2", **HOW)
    assert state(lib) == {"a": ("unchanged", ["two"])} and lib.ledger().where("gen = 2").first().deleted == 1


def test_a_batch_that_broke_off_counts_for_nothing(spark):
    lib = library.Library.opened(spark).load(files(spark, ("a", "one")), "1", **HOW)
    real, lost = library.Library._write, []

    def broken(self, df, name, gen, *rest, **counters):
        seen = real(self, df, name, gen, *rest, **counters)
        if name == "documents":
            lost.append(gen)
            raise RuntimeError("lost")
        return seen

    with pytest.MonkeyPatch.context() as m:
        m.setattr(library.Library, "_write", broken)
        with pytest.raises(RuntimeError):
            lib.load(files(spark, ("a", "other"), ("b", "more")), "2", **HOW)
    assert state(library.Library.opened(spark, lib.path)) == {"a": ("new", ["one"])}
    whole = library.Library.opened(spark, lib.path).load(files(spark, ("a", "other"), ("b", "more")), "2", **HOW)
    assert state(whole) == {"a": ("changed", ["other"]), "b": ("new", ["more"])} and whole.gens[-1] > lost[0]


def test_counters_need_no_job(spark):
    lib = library.Library.opened(spark)
    sc, seen = spark.sparkContext, []
    sc.setJobGroup("library", "counted")
    try:
        real = library.Library._write

        def counted(self, df, name, *rest, **counters):
            out = real(self, df, name, *rest, **counters)
            before = len(sc.statusTracker().getJobIdsForGroup("library"))
            assert out.get.keys() == counters.keys() - {"keep"}
            seen.append(len(sc.statusTracker().getJobIdsForGroup("library")) - before)
            return out

        with pytest.MonkeyPatch.context() as m:
            m.setattr(library.Library, "_write", counted)
            lib.load(files(spark, ("a", "one"), ("b", "two")), "1", **HOW)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen == [0, 0, 0]


def test_rebuild_forgets_what_was_there(spark, first):
    lib = first.load(files(spark, ("a", "one\ntwo\ntwo"), ("z", "five"), ("y", b"\xff")), "anew", rebuild=True, **HOW)
    assert state(lib) == {"a": ("new", ["one", "two", "two"]), "z": ("new", ["five"])}
    assert lib.ledger().where(F.col("batch") == "anew").first().reused == 0


def test_word_files_through_the_whole_chunker(spark):
    made = docx.written([("TÍTULO I Das coisas", "Heading 1"), ("Art. 1º " + "palavra " * 120, None), ("§ 1º " + "outra " * 120, None), ("Art. 2º " + "mais " * 300, None)])
    lib = library.Library.opened(spark).load(files(spark, ("f", made), ("g", made[:200])), "1", parse=library.word_paragraphs, chunk=library.legal_chunks, embed=HOW["embed"])
    ((_, texts),) = state(lib).values()
    assert len(texts) >= 2 and texts[0].startswith("TÍTULO I") and "Art. 2º" in texts[-1]
    assert [r.path for r in lib.failures().collect()] == ["g"]
