"""Each operator's method against a plain version of it, and the cases that the method alone decides."""

import hashlib
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import chat, decontamination, html_text, ngram_join, pii, quality, sharding, toxicity, warc
from test_operators import DOC, SMALL, brute_components

PAGE = "page_id long, url string, html string"


# --- toxicity --------------------------------------------------------------------------------------------------------
def test_risk_by_a_plain_loop():
    rng = np.random.default_rng(1)
    for prior in (0.05, 0.4):
        p, u = rng.normal(1, 2, 30), rng.normal(-1, 2, 50)
        loss = lambda z: np.log(1 + np.exp(-z))
        plain = prior * sum(loss(x) for x in p) / 30
        negative = sum(loss(-x) for x in u) / 50 - prior * sum(loss(-x) for x in p) / 30
        assert np.allclose(toxicity.risk(p, u, prior), (plain + max(0, negative), negative))


def test_training_lowers_the_risk_and_finds_the_positives():
    rng = np.random.default_rng(2)
    toxic = [sorted({*rng.integers(0, 5, 3).tolist(), *rng.integers(10, 200, 20).tolist()}) for _ in range(60)]
    clean = [sorted(set(rng.integers(10, 200, 20).tolist())) for _ in range(200)]
    data = toxicity.Rows.of(toxic + clean)
    model = toxicity.NnPu.fitted(data, np.arange(30), np.arange(30, 260), 0.13)
    scores = [model.score([f for f in row if f in model.weights]) for row in toxic[30:] + clean]
    assert sum(x > 0.7 for x in scores[:30]) >= 25 and max(scores[30:]) < 0.7
    rows = np.array([3, 0, 250])
    of, values = data.taken(rows)
    assert [values[of == k].tolist() for k in range(3)] == [(toxic + clean)[r] for r in rows]


# --- personal data -----------------------------------------------------------------------------------------------
def test_candidates_touch_nothing_taken():
    rng = np.random.default_rng(3)
    pieces = ["949-555-3739", "(555) 123-4567", "4111.1111.1111.1111", "a [at] b [dot] c", "1:2:3:4:5:6:7:8", "4111 1111 1111 1111", "+1 949 555 3739", "x@y.z", "10.0.0.1", "word"]
    for _ in range(50):
        text = " ".join(rng.choice(pieces, 12))
        base = pii.base_spans(text)
        taken, plain = [(s, e) for _, s, e in base], []
        for kind, pattern in pii.LOOSE:
            for m in pattern.finditer(text):
                if not any(s < m.end() and m.start() < e for s, e in taken):
                    taken.append(m.span()), plain.append((kind, *m.span()))
        assert pii.candidates(text, base) == plain


def test_candidates_are_linear():
    text = "949-555-3739 " * 40_000
    start = time.process_time()
    assert len(pii.candidates(text, pii.base_spans(text))) == 40_000
    assert time.process_time() - start < 5


def test_secrets_are_flagged_and_masked(spark):
    secrets = [f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"' for k in range(30)] + ["password: Hunter2Hunter2Hunter2", "api_key=AbC123dEf456GhI789"]
    plain = ["token of thanks: appreciated", "the key: listen carefully", "secret = nothing", "password: incomprehensibilities", "a keyboard: mechanical"]
    rows = [(k, f"we found {x} here") for k, x in enumerate(secrets + plain)] + [(k + 1000, r.text) for k, r in enumerate(spark.read.parquet(f"{SMALL}/documents.parquet").collect())]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert all(got[k].n_secret == got[k].flagged == 1 and not any(x.startswith("secret") for x in got[k].spans.split(",")) for k in range(len(secrets)))
    assert not any(got[k].flagged for k in range(len(secrets), len(secrets + plain)))
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[0] == 'we found token = "[SECRET]" here' and all("[SECRET]" in masked[k] for k in range(len(secrets))) and masked[len(secrets)] == rows[len(secrets)][1]
    tokens = {i for i, t in rows if i >= 1000 and re.search(r'token = "[0-9a-f]{40}"', t)}
    assert all("[SECRET]" in masked[i] for i in tokens)


def test_classifier_reads_context_and_gazetteer():
    span = {"kind": "phone", "base": False, "start": 0, "end": 12, "v1": 1, "v2": 0, "v3": 0, "key": "949", "f": [1]}
    counts = [("phone", True, 1, 1, 1, 50), ("phone", False, 1, 0, 0, 5), ("phone", False, -1, -1, -1, 50)]
    assert not pii.SpanClassifier.fitted(counts, [("phone", False, -1, -1, -1, [1])] * 50).accepts(span)
    assert pii.SpanClassifier.fitted(counts, [("phone", True, 1, 1, 1, [1])] * 50, frozenset({("phone", "949")})).accepts(span)


# --- archives ------------------------------------------------------------------------------------------------------
def test_pointer_jumping_by_walking():
    rng = np.random.default_rng(4)
    for _ in range(100):
        steps = np.cumsum([0, *rng.integers(5, 50, rng.integers(1, 40))])
        true, size = steps[:-1], int(steps[-1])
        decoys = np.array([x for x in rng.integers(1, size, 30) if x not in true], np.int64)
        offsets = np.concatenate([decoys, true])
        successors = np.concatenate([decoys + rng.integers(1, 60, len(decoys)), steps[1:]])
        assert warc.reachable(offsets, successors, size).tolist() == true.tolist()


def test_archives_of_several_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LEVEL_BYTES", 1 << 13)
    rows = [(k, f"http://h.org/{k}", ("WARC/1.0\r\nContent-Length: 9\r\n\r\n" if k % 3 == 0 else "é") * (1 + 2000 * (k % 5 == 0))) for k in range(40)]
    pages = spark.createDataFrame(rows, PAGE).repartition(2)
    warc.write_archives(pages, str(tmp_path / "a"), records_per_file=16)
    files = [f for f in (tmp_path / "a").rglob("part-*")]
    assert len({f.parent for f in files}) > 1 and max(f.stat().st_size for f in files) <= 16 << 13
    got = {r.page_id: bytes(r.payload or b"") for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    whole = {k: h for k, _, h in rows}
    assert set(got) == set(whole) and all(got[k].decode() == whole[k] for k in got if got[k])


# --- chat ------------------------------------------------------------------------------------------------------------
TURNS = [("user", "a"), ("assistant", "b")]


@pytest.mark.parametrize(
    "text",
    [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"instruction":"a","input":"","output":"b"}',
        '{"instruction":"a","output":"b"}',
        '{"prompt":"a","completion":"b"}',
        '{"prompt":"a","response":"b"}',
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"prompt":"known, but of another layout"}',
    ],
)
def test_every_layout_by_its_fingerprint(spark, text):
    json = spark.createDataFrame([(1, text)], "conv_id long, j string")
    got = chat.turns_from_json(json, "j").first()
    assert [(t.role, t.text) for t in got.turns] == TURNS and got.layout in {x.key for x in chat.LAYOUTS}
    kind = spark.sql(f"SELECT schema_of_json('{text}') AS k").first().k
    columns = json.select("conv_id", F.from_json("j", kind).alias("x")).select("conv_id", "x.*")
    assert chat.layout_of(chat.field_paths(columns.drop("conv_id").schema)).key == got.layout
    assert [(t.role, t.text) for t in chat.turns_from_columns(columns).first().turns] == TURNS


def test_json_paths_of_any_element(spark):
    rows = [(1, '{"messages":[{"role":"user","content":null},{"role":"assistant","content":"b"}]}'), (2, '{"messages":[{"role":"user"},{"content":"x"}]}'), (3, '{"messages":"text"}'), (4, "[]"), (5, "not json")]
    got = {r.conv_id: r.turns for r in chat.turns_from_json(spark.createDataFrame(rows, "conv_id long, j string"), "j").collect()}
    assert [(t.role, t.text) for t in got[1]] == [("user", ""), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[2]] == [("user", ""), ("", "x")]
    assert got[3] is None and got[4] is None and got[5] is None


SAID = {
    '{"system":"s","instruction":"a","input":"i","output":"b"}': [("system", "s"), ("user", "a"), ("user", "i"), ("assistant", "b")],
    '{"system":"s","instruction":"a","output":"b"}': [("system", "s"), ("user", "a"), ("assistant", "b")],
    '{"system":"","prompt":"a","completion":"b"}': TURNS,
    '{"system":"s","conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': [("system", "s"), *TURNS],
    '{"prompt":"","completion":"x"}': [("user", ""), ("assistant", "x")],
    '{"prompt":"x","response":""}': [("user", "x"), ("assistant", "")],
    '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"c"}]},{"role":"assistant","content":[{"type":"text","text":"b"}]}]}': [("user", "ac"), ("assistant", "b")],
    '{"messages":[{"role":"user","content":"[{\\"text\\":\\"a\\"}]"}]}': [("user", '[{"text":"a"}]')],
}


@pytest.mark.parametrize("text", SAID)
def test_system_texts_empty_turns_and_contents_in_parts(spark, text):
    json = spark.createDataFrame([(1, text)], "conv_id long, j string")
    got = chat.turns_from_json(json, "j").first()
    assert [(t.role, t.text) for t in got.turns] == SAID[text] and got.unmapped == []
    kind = spark.range(1).select(F.schema_of_json(F.lit(text)).alias("k")).first().k if "\\" not in text else "struct<messages:array<struct<role:string,content:string>>>"
    columns = json.select("conv_id", F.from_json("j", kind).alias("x")).select("conv_id", "x.*")
    assert [(t.role, t.text) for t in chat.turns_from_columns(columns).first().turns] == SAID[text]


def test_what_no_mapping_takes_is_told(spark):
    rows = [(1, '{"prompt":"a","completion":"b","score":1,"meta":{"x":2}}'), (2, '{"messages":[{"role":"user","content":"a","name":"n"}],"id":3}'), (3, '{"messages":[{"role":"user","content":[{"type":"image","url":"u"},"c"]}]}'), (4, '{"prompt":"a","completion":"b"}')]
    got = {r.conv_id: r for r in chat.turns_from_json(spark.createDataFrame(rows, "conv_id long, j string"), "j").collect()}
    assert [got[k].unmapped for k in (1, 2, 3, 4)] == [["meta", "score"], ["id", "messages[].name"], [], []]
    assert [(t.role, t.text) for t in got[3].turns] == [("user", '{"type":"image","url":"u"}c')]
    assert got[1].layout == got[4].layout and got[1].schema != got[4].schema


def test_flat_and_nested_tables_go_through_the_fingerprint(spark, monkeypatch):
    asked, real = [], chat.fingerprint
    monkeypatch.setattr(chat, "fingerprint", lambda paths: asked.append(sorted(paths)) or real(paths))
    flat = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x")], "conv_id long, turn long, role string, text string, prompt string")
    nested = spark.createDataFrame([(2, [("user", "a"), ("assistant", "b")])], "conv_id long, messages array<struct<role:string,content:string>>")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(flat, nested).collect()}
    assert got[1] == got[2] == "<|turn|>user\na<|end|>\n<|turn|>assistant\nb<|end|>\n" and asked
    with pytest.raises(ValueError):
        chat.turns_from_columns(flat.select("conv_id", "prompt"))


# --- n-gram join ---------------------------------------------------------------------------------------------------
@pytest.fixture
def near_threshold():
    """Families whose members differ by about as much as may link: their hubs don't decide all of their pairs."""
    rng = np.random.default_rng(11)
    rows = []
    for family in range(3):
        base = [f"w{x}" for x in rng.integers(0, 2000, 100)]
        for _ in range(40):
            w = list(base)
            for at in rng.choice(100, rng.integers(1, 7), replace=False):
                w[at] = f"x{family}y{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [512, 8])
def test_the_rtree_finds_links_that_hubs_miss(spark, near_threshold, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    docs = spark.createDataFrame(near_threshold, DOC).repartition(3)
    _, by_hub, by_tree = ngram_join.links_of(docs, 3, 80)
    assert by_hub.count() > 0 and by_tree.count() > 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(docs, 3, 80).collect()}
    assert got == brute_components(near_threshold, 3, 80)


def test_points_bound_the_overlap():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in (1, 10, 300, 3000, 30_000)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], sets[k - 1]])) for k, s in enumerate(sets)] + [np.arange(70_000, dtype=np.uint64) << np.uint64(20)]
    import pyarrow as pa

    points = ngram_join.Points(pa.array([ngram_join.point_of(s).tobytes() for s in sets], pa.binary()))
    assert all(points.data[points.at[k] : points.at[k + 1]].sum() == len(s) for k, s in enumerate(sets))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (ngram_join.bounds(points, i, points, j) >= true).all()


def test_pairs_between_components_by_all_pairs():
    rng = np.random.default_rng(13)
    for _ in range(20):
        m = int(rng.integers(2, 60))
        points = rng.integers(0, 4, (m, 64)).astype(np.uint32)
        root, n, every = rng.integers(0, 4, m), points.sum(axis=1).astype(np.int64), np.arange(m)
        one, two = (every, every) if rng.integers(2) else (every[: m // 2], every[m // 2 :])
        got = {tuple(sorted(x)) for x in ngram_join.tree_pairs(points, n, root, one, two, 60).tolist()}
        reach = lambda a, b: np.minimum(points[a], points[b]).sum() >= ngram_join.need(n[a], n[b], 60)  # noqa: B023, E731
        assert got == {tuple(sorted((a, b))) for a in one.tolist() for b in two.tolist() if root[a] != root[b] and reach(a, b)}


def test_deduplication_keeps_other_texts_under_the_same_id(spark):
    t, u = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, t), (2, t), (2, u), (None, t), (3, None), (4, ""), (5, u + " c"), (1, t)]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.deduplicated(spark.createDataFrame(rows, DOC)).collect()), key=repr)
    assert kept == sorted([(1, t), (1, t), (2, u), (3, None), (4, "")], key=repr)


def test_a_class_whose_first_row_has_no_id(spark):
    t = [f"a{i}" for i in range(60)]
    rows = [(None, " ".join(t)), (7, " ".join(t[:-1] + ["z"])), (None, "only " + " ".join(f"q{i}" for i in range(20)))]
    got = [(r.doc_id, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, DOC), 3, 80).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7), (7, 7), (None, None)], key=repr)


# --- quality -------------------------------------------------------------------------------------------------------
def boilerplate():
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    note = "licence https://example.org/a-very-long-licence-address-that-is-the-longest-word " + " ".join(f"n{i}" for i in range(67))
    rows = [(k, "s", f"{note.upper() if k % 2 else note}\n{own(k, 12)}") for k in range(200)]  # depleted
    rows += [(1000 + k, "s", f"{own(1000 + k, 90)}\n  {note} ") for k in range(10)]  # keep enough
    rows += [(2000 + k, "other", f"{note}\n{own(2000 + k, 12)}") for k in range(30)]  # not too many on this host
    rows += [(3000 + k, "copies", f"{note}\n{own(3000, 12)}") for k in range(100)]  # one document
    return rows, note


def test_documents_that_share_a_line_with_a_long_address_are_rejected(spark):
    rows, note = boilerplate()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept == {k: k >= 1000 for k, _, _ in rows}
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    assert dict(db.execute(f"SELECT doc_id, kept FROM ({quality.ORACLE})").fetchall()) == kept
    left = {r.doc_id: (r.text, r.n_chars) for r in quality.filtered(docs.withColumn("n_chars", F.length("text").cast("int"))).collect()}
    assert set(left) == {k for k in kept if kept[k]}
    for k, _, text in rows:
        if 1000 <= k < 2000:
            assert left[k] == (text.split("\n")[0], len(text.split("\n")[0]))
        elif k >= 2000:
            assert left[k] == (text, len(text))


@pytest.mark.parametrize("most", [1, 2, 5])
def test_quality_with_frequent_lines_equals_sql(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = {r[0]: r[1:] for r in db.execute(quality.oracle(most)).fetchall()}
    got = {r.doc_id: tuple(r[c] for c in (*quality.METRICS, "base_failed", "kept")) for r in quality.judge(docs, most).collect()}
    assert got == want


# --- sharding ------------------------------------------------------------------------------------------------------
def test_schedule_is_that_of_the_heap():
    rng = np.random.default_rng(14)
    for _ in range(200):
        n = int(rng.integers(1, 10))
        histogram = {int(rng.integers(1, 80)): int(rng.integers(1, 400)) for _ in range(rng.integers(0, 8))}
        units = {(size, k): size for size, count in histogram.items() for k in range(count)}
        want = {size: [0] * n for size in histogram}
        for (size, _), shard in sharding.lpt(units, n).items():
            want[size][shard] += 1
        assert sharding.schedule(histogram, n) == want


def test_shards_have_the_loads_of_the_heap(spark):
    rng = np.random.default_rng(15)
    rows = [(k, "hot" if k % 3 == 0 else "t" * int(rng.integers(0, 40)) + str(rng.integers(0, 60))) for k in range(900)]
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t) + 1
    loads = [0] * 8
    for t, shard in sharding.lpt(groups, 8).items():
        loads[shard] += groups[t]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOC), 8, rows_per_slice=3).join(spark.createDataFrame(rows, DOC), "doc_id").collect()
    assert len(got) == 900 and [sum(r.size for r in got if r.shard == s) for s in range(8)] == loads
    assert len({(r.text, r.shard) for r in got}) == len(groups)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))


# --- decontamination -------------------------------------------------------------------------------------------------
def plain_leaks(docs, items, window=8, share=0.5):
    """The rule, pair by pair: {(doc_id, item_id)}."""
    C = decontamination

    def canonical(text):
        import regex

        t = regex.sub(r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}\p{M}'’-]*", C.NAME, text or "")
        t = regex.sub(r"[0-9]+(?:[.,:/][0-9]+)*", C.NUMBER, t)
        t = regex.sub(rf"(?i)({C.NUMBER} ?)(?:{C.UNITS})(?![\p{{L}}\p{{N}}])", rf"\1{C.UNIT}", t)
        t = regex.sub(rf"[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D{C.NAME}{C.NUMBER}{C.UNIT}]+", "", t.lower())
        raw = re.split(r"[\x20\x09-\x0D]", text or "")
        value = lambda v: regex.sub(r"^[^\p{L}\p{N}+$€£-]+|[^\p{L}\p{N}%]+$", "", v.lower())
        return [(c, value(v)) for c, v in zip(re.split(r"[\x20\x09-\x0D]", t), raw, strict=True) if c]

    slot, out = re.compile(C.SLOT), set()
    prepared = []
    for item_id, text in items:
        q = canonical(text)
        if not q:
            continue
        n = min(window, len(q))
        forms = {j: [tuple(c for c, _ in q[j : j + n])] for j in range(len(q) - n + 1)}
        if re.match(r"[^\w]*[A-Z]", text):
            forms[0].append((C.NAME, *forms[0][0][1:]))
        rich = {j: [w for w in ws if sum(not slot.search(x) for x in w) >= 3] for j, ws in forms.items()}
        rich = {j: ws for j, ws in rich.items() if ws} or forms
        prepared.append((item_id, q, n, rich))
    for doc_id, text in docs:
        p = canonical(text)
        at = {}
        for n in {x[2] for x in prepared}:
            for i in range(len(p) - n + 1) if n >= 4 or len(p) == n else ():
                at.setdefault(tuple(c for c, _ in p[i : i + n]), []).append(i)
        for item_id, q, n, forms in prepared:
            shifts = {}
            for j, ws in forms.items():
                for w in ws:
                    for i in at.get(w, ()):
                        shifts.setdefault(i - j, set()).add(j)
            covered = set()
            for shift, js in shifts.items():
                spots = {k for j in js for k in range(j, j + n) if slot.search(q[k][0])}
                pairs = {(q[k][1], p[k + shift][1]) for k in spots}
                if len(pairs) == len({x for x, _ in pairs}):
                    covered |= js
            if shifts and len(covered) >= share * len(forms):
                out.add((doc_id, item_id))
    return out


def test_leaks_equal_the_rule_pair_by_pair(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    words = "Anna walked 12 km and then paid 5 dollars for bread in Rome before 3 pm"
    items += [(900, words), (901, "Paris"), (902, "What now then"), (903, "five short words are here"), (904, "Every one knows it well")]
    docs += [(90_000, "yes so " + words.replace("Anna", "Bert").replace("12", "40")), (90_001, "paris!"), (90_002, "in Paris"), (90_003, "What now, then?"), (90_004, "and five short words are here too"), (90_005, "so Every one knows it well"), (90_006, None)]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_leaks(docs, items)
    assert {(90_000, 900), (90_001, 901), (90_003, 902), (90_004, 903), (90_005, 904)} <= got and (90_002, 901) not in got


# --- pages -----------------------------------------------------------------------------------------------------------
def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()}


def test_hostile_pages_are_read_in_linear_time(spark):
    pages = {
        1: ("<div>" * 5000 + "deep", "deep"), 2: ("<p>a</p>" + '<a x="' * 100_001, "a"), 3: ("<p>a</p>" + "<b " * 100_000, "a"), 4: ("x <" + "<" * 100_000, "x " + "<" * 100_001),
        5: ("<!--" * 50_000, ""), 6: ("<p>" + "<b>" * 20_000 + "t" + "</i></u></p>" * 20_000, "t"), 7: ("<ul>" + "<li>a" * 20_000, "\n".join(["a"] * 20_000)), 8: ("<a title=it's>t</a> and <a title=\"x>y\">u</a>", "t and u"),
    }
    start = time.time()
    got = texts(spark, [(k, f"http://h{k}.org/", html) for k, (html, _) in pages.items()])
    assert got == {k: text for k, (_, text) in pages.items()} and time.time() - start < 60


def test_all_articles_of_a_page(spark):
    page = "<body><div>menu</div><article><h1>One</h1><p>a</p></article><div>between</div><article><p>b</p></article><p>end</p></body>"
    assert texts(spark, [(1, "http://h.org/", page)]) == {1: "One\na\nb"}


def test_equal_pages_keep_their_text(spark):
    marked, plain = "<body><article><p>one</p><p>two</p></article></body>", "<body><div><p>one</p><p>two</p></div></body>"
    got = texts(spark, [(k, "http://m.org/", marked) for k in range(30)] + [(100 + k, "http://p.org/", plain) for k in range(30)])
    assert set(got.values()) == {"one\ntwo"}


def test_articles_that_differ_only_in_a_counter_keep_their_text(spark):
    rows = [(k, "http://m.org/", f"<body><p>seen {k} times</p><article><p>one</p><p>two</p></article></body>") for k in range(40)]
    assert set(texts(spark, rows).values()) == {"one\ntwo"}


def test_wrapper_induction_alone_gives_the_text(spark):
    """No element name, class or role tells what is main text."""
    page = lambda k, n: f"<body><div><div><a>Home</a><a>News</a></div><div>Welcome to the site</div></div><div><p>title {k}</p>{''.join(f'<p>par {k} {i}</p>' for i in range(n))}</div><div><p>All rights kept</p></div></body>"
    rows = [(k, "http://h.org/x", page(k, k % 7)) for k in range(25)]
    assert texts(spark, rows) == {k: "\n".join([f"title {k}", *[f"par {k} {i}" for i in range(k % 7)]]) for k in range(25)}


def plain_matching(a, i, b, j):
    """Simple tree matching as defined, where no two neighbouring siblings share a label."""
    if a.labels[i] != b.labels[j]:
        return 0
    x, y = a.children[i], b.children[j]
    m = np.zeros((len(x) + 1, len(y) + 1), int)
    for r, p in enumerate(x, 1):
        for s, q in enumerate(y, 1):
            m[r, s] = max(m[r - 1, s], m[r, s - 1], m[r - 1, s - 1] + plain_matching(a, p, b, q))
    return 1 + int(m[-1, -1])


def test_tree_matching_by_its_definition():
    rng = np.random.default_rng(16)

    def tree(depth, label="r"):
        labels = [x for k, x in enumerate(rng.choice(list("abcd"), rng.integers(0, 5))) if not k or True]
        labels = [x for k, x in enumerate(labels) if k == 0 or x != labels[k - 1]]
        return f"<x-{label}>" + ("".join(tree(depth - 1, x) for x in labels) if depth else "") + f"</x-{label}>"

    for _ in range(60):
        one, two = (html_text.Skeleton(html_text.skeleton(html_text.page_tree(tree(3)), [])) for _ in range(2))
        to = html_text.match(one, two)
        assert sum(k >= 0 for k in to) == plain_matching(one, 0, two, 0)
        assert all(one.labels[k] == two.labels[j] for k, j in enumerate(to) if j >= 0)
        assert len({j for j in to if j >= 0}) == sum(j >= 0 for j in to)


# --- pipeline ------------------------------------------------------------------------------------------------------
def test_pipeline_run_over_the_smallest_tables(spark):
    import corpus_pipeline as cp
    from brevia.llm import bpe

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = quality.filtered(docs).toPandas()
    keeps = brute_components(list(zip(kept.doc_id, kept.text, strict=True)), 5, 80)
    keeps = {i for i, (n, root) in keeps.items() if n == 0 or root == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in zip(kept.doc_id, kept.text, strict=True) if i in keeps]
    leaked = {i for i, _ in plain_leaks(left, items)}
    rows = {r.doc_id: r for r in cp.run(spark, SMALL).collect()}
    assert set(rows) == {i for i, _ in left} - leaked
    coder = bpe.load(bpe.default_path())
    for i, t in left:
        if i in rows:
            spans = pii.base_spans(t)
            if not pii.candidates(t, spans):
                assert list(rows[i].ids) == coder.encode(pii.masked(t, spans))
    assert {"lang", "source", "n_chars"} <= set(rows[next(iter(rows))].asDict())
