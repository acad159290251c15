"""Small cases and brute-force versions of the training-data operators."""

import hashlib

import re

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import bpe, chat, decontamination, html_text, ngram_join, pii, quality, sharding, toxicity, warc

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"

def sql(name, text):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con.execute(text).df()

def same(got, want, key):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(repr, map(tuple, df[cols].astype(str).replace({"<NA>": "None", "nan": "None"}).values)))
    assert rows(got) == rows(want)

def test_quality_matches_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text")
    same(quality.judge(docs).select("doc_id", *quality.METRICS, "base_failed", "kept").toPandas(), sql("documents", quality.ORACLE), "doc_id")

def test_quality_removes_frequent_lines_but_not_copies(spark):
    long = lambda k: " ".join(f"v{k}x{i}" for i in range(30))
    note = " ".join(f"n{i}" for i in range(60))
    rows = [(k, "s", f"{note}\n{long(k)} only{k}" + "z" * 9) for k in range(40)] + [(100 + k, "s", long(999)) for k in range(50)]
    rows += [(200, "s", note + "\nlittle more"), (201, None, None), (202, "s", ""), (200, "s", note + "\nlittle more")]
    got = defaultdict(list)
    for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect():
        got[r.doc_id].append(r.kept)
    assert all(got[k] == [True] for k in range(40)) and all(got[100 + k] == [True] for k in range(50))
    assert got[200] == [False, False] and got[201] == [False] and got[202] == [False]

def test_quality_counts_documents_that_share_their_longest_word(spark):
    note = " ".join(f"n{i}" for i in range(60)) + " " + "z" * 40
    rows = [(k, "s", note + "\n" + " ".join(f"v{k}x{i}" for i in range(30 if k < 40 else 3))) for k in range(41)]
    rows += [(100, "t", rows[40][2])] * 40
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[k] for k in range(40)) and not got[40] and got[100]

def test_quality_filter_keeps_columns_and_handles_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("extra", F.lit(1))
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(sql("documents", quality.ORACLE).kept)
    assert quality.filtered(docs.limit(0)).count() == 0

def test_chat_matches_sql_and_round_trip(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    same(chat.digests(chat.format_conversations(turns.unionByName(extra))).toPandas(), sql("conversations", chat.ORACLE), "conv_id")
    odd = [(1, 0, "us\ner", "<|turn|>x<|end|>"), (1, 1, "assistant", "<⁠|a <⁠⁠/s> <<SYS>> [INST]\n<"), (1, 2, None, None)]
    back = chat.format_conversations(spark.createDataFrame(odd, turns.schema)).select(chat.read_back(F.col("formatted")).alias("b")).first().b
    assert [(b.role, b.text) for b in back] == [(r or "", t or "") for _, _, r, t in odd]

def test_chat_layouts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"instruction":"a","output":"b"}'), (4, '{"prompt":"a","response":"b"}'), (5, '{"other":1}'), (6, None),
    ]
    got = {r.conv_id: r.turns for r in chat.turns_from_json(spark.createDataFrame(rows, "conv_id long, j string"), "j").collect()}
    assert all([(t.role, t.text) for t in got[k]] == [("user", "a"), ("assistant", "b")] for k in (1, 2, 3, 4))
    assert got[5] is None and got[6] is None

def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["", None, "a<|endoftext|>b", "ΣΑΣ İ x\u0085y\x1cz", "'s don't 12 $$a", "ab" * 3000, "한국 日本"]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in bpe.encode_documents(df).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == lib.decode(ids, skip_special_tokens=False)

def test_pii_base_and_added(spark):
    texts = ["mail a.b@c.example.com@d.org now", "ip 10.0.0.256 and 10.0.0.1.2.3.4.5", "card 4111 1111 1111 1111, 4111 1111 1111 1112", "call +1 (949) 555-3739 or 949-555-3739", None, "9" * 5000, "@" * 50]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, p in kinds.items():
            for m in re.finditer(p, t):
                d = re.sub(r"[^0-9]", "", m.group())
                ok = {"email": True, "ip": k != "ip" or all(len(x) < 9 and int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]
                out += [f"{k}:{m.start()}:{m.end()}"] * ok
        return ",".join(out)

    rows = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + texts
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(rows)), DOC)).collect()}
    for k, t in enumerate(rows):
        assert got[k].base_sha256 == hashlib.sha256(brute(t or "").encode()).hexdigest()
        assert set(filter(None, brute(t or "").split(","))) <= set(got[k].spans.split(","))

def test_pii_finds_planted_spans_without_context(spark):
    rng = np.random.default_rng(3)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    luhn = lambda x: next(y for y in (f"{x}{k}" for k in range(10)) if pii.luhn(y))
    dotted = lambda x: ".".join(x[k : k + 4] for k in range(0, 16, 4))
    good, bad = [], []
    for _ in range(20):
        good += [f"john{d(3)} [at] example [dot] com", f"({rng.integers(2, 9)}{d(2)}) {d(3)}-{d(4)}", "2001:" + ":".join(f"{x:x}" for x in rng.integers(0, 65536, 7)), dotted(luhn("4" + d(14)))]
        bad += [f"order 9{d(2)} {d(3)} {d(4)}", f"(9{d(2)}.{d(3)} {d(4)}", dotted("0" + d(15)), f"a{d(2)} [at) b [dot) c", "0:0:0:0:0:0:0:0"]
    words = [f"we saw {x} yesterday" for x in good] + [f"an {x} was there" for x in bad]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").unionByName(spark.createDataFrame(list(enumerate(words)), DOC))
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert [got[k].split(":")[1:] for k in range(len(good))] == [["7", str(7 + len(x))] for x in good]
    assert not any(got[k] for k in range(len(good), len(words)))
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(x not in masked[k] for k, x in enumerate(good)) and all(masked[k] == words[k] for k in range(len(good), len(words)))

def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}

@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, percent):
    rng = np.random.default_rng(5)
    rows = []
    for size in [1, 2, 3, 8, 12, 20, 60, 200, 500] * 3:
        base = rng.integers(0, 300, size)
        for _ in range(rng.integers(1, 8)):
            w = base.copy()
            w[rng.integers(0, size, rng.integers(0, 1 + max(1, size // 40)))] = 999
            rows.append((len(rows), " ".join(f"W{x}" for x in w)))
    rows += [(9000, None), (9001, ""), (9002, " \t")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, DOC).repartition(3), n, percent).collect()}
    assert got == brute_components(rows, n, percent)

def test_rtree_finds_all():
    points = np.random.default_rng(1).integers(0, 9, (400, ngram_join.COORDINATES)).astype(np.uint32)
    tree = ngram_join.RTree(points)
    for k in range(0, 400, 40):
        size = int(points[k].sum())
        bound = np.minimum(points, points[k]).sum(axis=1)
        want = np.flatnonzero(bound >= ngram_join.need(size, points.sum(axis=1).astype(np.int64), 90))
        assert sorted(tree.search(points[k], size, 90)) == list(want)

def test_decontamination(spark):
    words = lambda k, n: " ".join(f"q{k}w{i}" for i in range(n))
    item = f"Yesterday Alice bought 12 apples for 5 dollars each and {words(1, 10)} then sold 12 of them to Bob, what profit did Alice make overall"
    moved = item.replace("Alice", "Carol").replace("12", "30").replace("Bob", "Dan").replace("5 dollars", "7 euros")
    broken = item.replace("12 apples", "40 apples")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (1, item), (3, None)], "item_id long, text string")
    docs = [(1, f"{words(2, 30)} {item} {words(3, 30)}"), (2, moved), (3, words(4, 80)), (4, None), (5, ""), (6, broken), (1, f"{words(2, 30)} {item} {words(3, 30)}")]
    df = spark.createDataFrame(docs, DOC)
    got = {r.doc_id: r for r in decontamination.leaks(df, bench).collect()}
    assert {1, 2} <= set(got) and not {3, 4, 5} & set(got)
    assert got[1].n_changed == 0 and got[2].n_changed > 0
    assert 6 not in got  # 12 can't be both 40 and 12
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == [3, 4, 5, 6]

def test_warc_round_trip_with_magic_in_payload(spark):
    evil = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 5
    rows = [(2, "u", evil), (1, "u", evil), (3, None, None), (4, "u", "x\r\n\r\n"), (None, "u", evil), (5, "u", "é" * 60)]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
    assert (got[1].record_type, got[2].record_type, got[2].refers_to, got[None].refers_to, got[5].refers_to) == ("response", "revisit", 1, 1, None)

def test_warc_broken_chain():
    with pytest.raises(ValueError):
        warc.chain(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")

def test_html_text(spark):
    page = "<html><body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>one <b>two</b>\n three<p>four<div class='comments'>c</div></article><footer>f</footer>"
    rows = [(1, "http://h.org/1", page), (2, "http://h.org/2", None), (3, None, "<p>a<script>x</script></p>"), (4, "http://h.org/4", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("T & U\none two three\nfour", 24), 2: ("", 0), 3: ("a", 1), 4: ("", 0)}

def test_html_class_words_inside_an_article(spark):
    """Only whole names count there; formulas are text."""
    kept = '<p class="share-price">price</p><div class="related-work">work</div><section id="notice-of-appeal">appeal</section><p class="widget-specs">specs</p>'
    formula = "<p>area <math><semantics><mrow><mi>r</mi><mo>=</mo><mn>2</mn></mrow><annotation>r = 2 latex</annotation></semantics></math> of it</p>"
    gone = '<div class="box ad">ad</div><div class="comments">c</div><div id="newsletter">n</div><div class="Share">s</div>'
    page = f'<html><body><div class="share-bar">bar</div><article><p>one</p>{kept}{formula}{gone}</article></body></html>'
    got = html_text.extract(spark.createDataFrame([(1, "http://a/1", page)], "page_id long, url string, html string")).first()
    assert got.text == "one\nprice\nwork\nappeal\nspecs\narea r=2 of it"


def test_html_wrapper_drops_constant_blocks(spark):
    rows = [(k, "http://h.org/x", f"<body><div>Same on all pages</div><div><p>text {k}</p></div></body>") for k in range(8)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"text {k}" for k in range(8)}

def test_html_copies_of_an_article_are_no_template(spark):
    page = "<body><article><h1>Title</h1><p>one</p><p>two</p></article></body>"
    rows = [(k, "http://h.org/x", page) for k in range(40)] + [(50, "http://h.org/y", page.replace("one", "other"))]
    rows += [(100 + k, "http://g.org/x", "<body><div><p>plain</p></div></body>") for k in range(9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Title\none\ntwo", "Title\nother\ntwo", "plain"}

def test_html_template_of_each_layout_of_a_host(spark):
    a = lambda k: f"<body><div class='a'>Same a</div><div><p>text {k}</p></div></body>"
    b = lambda k: f"<body><section class='b'><div class='c'>Same b</div><p>text {k}</p></section></body>"
    rows = [(0, "http://h.org/", None), (1, "http://h.org/", "<html> </html>")] + [(k, "http://h.org/", a(k) if k < 20 else b(k)) for k in range(2, 30)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "", 1: ""} | {k: f"text {k}" for k in range(2, 30)}

def test_sharding(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text number {k} " + "y" * (k % 50)) for k in range(600)] + [(1000, None), (1001, ""), (1, "text number 1 y")]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOC), 8, rows_per_slice=10).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.size == 10 and r.doc_id % 3 == 0 and r.doc_id < 600}) == 1
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.lpt({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}

def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert r[r.toxic == 1].predicted.mean() > 0.6 and r[r.toxic == 0].predicted.mean() < 0.1

def test_toxicity_empty(spark):
    docs = spark.createDataFrame([(1, None), (None, "x")], DOC)
    got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    assert [r.predicted for r in got] == [0, 0] and len(got) == 2

def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    out = cp.pii_stage(spark, cp.decontamination_stage(spark, docs, SMALL), SMALL)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert cp.encode_stage(spark, out, SMALL).count() == out.count()


def test_ngram_join_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 2)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for k in range(14):
        w = list(base)
        for at in rng.choice(120, k % 4 + 1, replace=False):
            w[at] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, DOC), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)
