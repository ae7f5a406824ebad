"""From files to answers, and back out."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kashf.operators import evaluate, gate, retrieve
from kashf.plans import engine, fixtures
from kashf.sources import chunks as C
from kashf.sources import index as I
from kashf.sources import ingest, sinks
from kashf.streaming import questions as Q


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "chunks.jsonl"
    path.write_text("\n".join(json.dumps({"text": t, "page": p}, ensure_ascii=False) + "," for _, p, t in fixtures.CHUNKS))
    found, mark = C.load_chunks(spark, str(path))
    return found.cache(), mark, path


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    found, mark, _ = corpus
    out = str(tmp_path_factory.mktemp("index"))
    I.save(I.build(found, fingerprint=mark), out)
    assert I.load(spark, out, "other", "hashed-trigrams-256") is None and I.load(spark, out, mark, "other") is None
    assert I.load(spark, out, mark, "hashed-trigrams-256", 3) is None and I.load(spark, out + "-none", mark, "hashed-trigrams-256") is None
    return I.load(spark, out, mark, "hashed-trigrams-256", len(fixtures.CHUNKS))


def test_loading(spark, corpus, tmp_path):
    found, mark, path = corpus
    assert [(r.pos, r.page, r.text) for r in found.orderBy("pos").collect()] == fixtures.CHUNKS
    import hashlib

    assert mark == hashlib.sha256(path.read_bytes()).hexdigest()
    whole = tmp_path / "array.json"
    whole.write_text('[{"text": "x one"}, "bare", 5, {"Page": 3, "content": "y two"}]')
    got = C.load_chunks(spark, str(whole))[0].orderBy("pos").collect()
    assert [(r.pos, r.chunk_id, r.page, r.text) for r in got] == [(0, 0, -1, "x one"), (1, 1, -1, "bare"), (3, 3, 3, "y two")]
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n{broken\n")
    with pytest.raises(ValueError):
        C.load_chunks(spark, str(empty))


def test_hits_and_answers(spark, index):
    asked = spark.createDataFrame(fixtures.QUESTIONS, "qid int, q string")
    hits = engine.hits(index, asked).cache()
    per = {r.qid: (r.n, r.m) for r in hits.groupBy("qid").agg(F.count("*").alias("n"), F.max("rk").alias("m")).collect()}
    assert len(per) == len(fixtures.QUESTIONS) and set(per.values()) == {(8, 8)}
    found = {r.qid: r for r in engine.answer(index, asked).collect()}
    assert found[1].intent == "work_hours" and "8:00" in found[1].body and found[1].found
    assert "14" in found[8].body and 11 in found[8].pages


def test_gate_falls_back_and_reranks(spark, index):
    asked = spark.createDataFrame([(1, "ساعات الدوام"), (2, "شيء آخر تماما")], "qid int, q string")
    postings = gate.parse_postings(spark.createDataFrame([("section:ساعات الدوام", "3"), ("section:ساعات الدوام", "0")], "heading string, posting string"))
    names = spark.createDataFrame([("ساعات الدوام", "الدوام")], "canon string, alias string")
    hits = engine.hits(index, asked, hierarchy=(postings, names)).collect()
    assert {r.pos for r in hits if r.qid == 1} == {0, 3} and len([r for r in hits if r.qid == 2]) == 8
    back = engine.hits(index, asked, reranker=-F.col("pos").cast("double"), k=3).where("qid = 2").orderBy("rk").collect()
    assert [r.pos for r in back] == sorted(r.pos for r in back)


def test_hierarchy_files(spark, tmp_path):
    from kashf.operators import priors
    from kashf.sources import hierarchy as H

    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False))
        return str(tmp_path / name)

    inverted = put("i.json", {"section:الإجازات": ["a.pdf_11_0", "a.pdf_12_1", "x"], "قيد": ["4"], "none": "no list", "empty": []})
    aliases = put("a.json", {"الإجازات": ["إجازة"], "x": []})
    postings, names = H.load_hierarchy(spark, inverted, aliases)
    assert {(r.heading, r.page, r.ordinal, r.pos) for r in postings.collect()} == {("الاجازات", 11, 0, 0), ("الاجازات", 12, 1, 1), ("قيد", None, None, 4)}
    assert [tuple(r) for r in names.collect()] == [("الاجازات", "اجازه")]
    assert "section:الاجازات" in {r.heading for r in H.load_hierarchy(spark, inverted, None, compat=True)[0].collect()}
    assert H.load_hierarchy(spark, None, aliases) is None and H.load_hierarchy(spark, put("e.json", {}), aliases) is None
    chunks = spark.createDataFrame([(0, 11), (1, 12), (2, 12), (3, -1)], "pos long, page int")
    assert {(r.heading, r.pos) for r in gate.locate(postings, chunks).collect()} == {("الاجازات", 0), ("الاجازات", 2), ("قيد", 4)}
    assert [tuple(r) for r in H.heading_tree(spark, put("t.json", {"a": []})).collect()] == [("a", [])]
    assert [tuple(r) for r in H.leaf_nodes(spark, put("l.json", [{"path": ["s", "c"], "title": "c"}])).collect()] == [(["s", "c"], "c")]
    spans = priors.headings(H.section_pages(postings)).first()
    assert (spans.title, spans.page_start, spans.page_end) == ("الاجازات", 11, 12)


def test_models_of_ones_own(spark):
    from kashf.operators import models

    d = spark.createDataFrame([("a", "some text", 0.25)], "q string, text string, score double")
    encode = models.encoder(lambda: lambda texts: [[3.0, 4.0] for _ in texts])
    assert [round(x, 6) for x in d.select(encode(F.col("text")).alias("v")).first().v] == [0.6, 0.8]

    def broken():
        raise RuntimeError("no model")

    assert d.select(models.reranker(broken).alias("s")).first().s == 0.25
    assert d.select(models.reranker(lambda: lambda pairs: [len(t) for _, t in pairs]).alias("s")).first().s == 9.0


def test_command_line(spark, corpus, tmp_path, capsys):
    from kashf import __main__ as cli

    args = cli.options(["--chunks", str(corpus[2]), "--save-index", str(tmp_path / "index"), "--digits", "arabic"])
    found = cli.ready_index(spark, args)
    cli.ask(spark, found, None, args, ["\n", "ما هي ساعات الدوام؟\n", "quit\n", "never\n"])
    said = capsys.readouterr().out
    first = said.splitlines()[0]
    assert first.startswith("ساعات الدوام من ") and not any(c in first for c in "0123456789") and said.count("Sources:") == 1


def test_compat_gate_ranks_first(spark):
    scores = spark.createDataFrame([(1, p, 1.0 - p / 10) for p in range(9)], "qid int, pos int, score double")
    allowed = spark.createDataFrame([(1, 1), (1, 7)], "qid int, pos int")
    from kashf.operators.sparse import top

    assert {r.pos for r in gate.gated(scores, allowed, top, 3).collect()} == {1, 7}
    assert {r.pos for r in gate.gated(scores, allowed, top, 3, compat=True).collect()} == {1}


def test_sparse_never_brings_candidates(spark):
    f = lambda data: spark.createDataFrame(data, "qid int, pos int, score double")
    out = retrieve.combine(f([(1, 1, 0.5), (1, 2, 0.4)]), f([(1, 3, 1.0), (1, 2, 1.0)]), None).orderBy("rk").collect()
    assert [(r.pos, r.score) for r in out] == [(2, 0.44), (1, 0.3)]


def test_run_report_and_results(spark, index, tmp_path):
    asked = spark.createDataFrame(fixtures.QUESTIONS[:4], "qid int, q string")
    rows = engine.run(index, asked).cache()
    text = sinks.summary_text(evaluate.summary(rows), rows)
    assert "questions: 4" in text and text.count("## ") == 4
    sinks.write_summary(text, spark, str(tmp_path / "summary"))
    sinks.write_results(rows, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 4


def test_ingest_and_upsert(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a text that is long enough to be taken")
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.docx").write_text("not of a kind that is read at all")

    def extract(texts, names):
        return [json.dumps({"sections": [{"id": "1", "level": 1, "title": "T", "path": ["T"], "content": t}]}) for t in texts]

    docs = ingest.ingest(ingest.list_files(spark, str(tmp_path)), ingest.plain_text, extract)
    got = docs.collect()
    assert [(r.source_filename, r.doc_title, len(r.sections)) for r in got] == [("a.txt", "a", 1)]
    assert C.sections_to_chunks(docs).first().page == -1
    files = sinks.document_json(docs)
    assert files.first().name == "a.json" and "\n" in files.first().body
    old = spark.createDataFrame([("a.json", "old"), ("z.json", "kept")], "name string, body string")
    assert {r.name: r.body for r in sinks.upsert(old, files).collect()} == {"z.json": "kept", "a.json": files.first().body}


def test_stream(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text('{"qid": 1, "q": "ما هي ساعات الدوام؟"}\n{"qid": 2, "q": "  "}\n{"qid": 3, "q": "quit"}\n')
    run = Q.answer_stream(Q.watch(spark, str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert [r.qid for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_the_rest_stands_without_the_training_data_operators():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(here, "kashf")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, n)).read(), n


def test_only_hits_keep_their_score_and_others_are_rescored(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, 1), (2, 10, 0.9, 1), (2, 11, 0.8, 2), (2, 12, 0.8, 3)], "qid int, pos int, score double, rk int")
    got = sorted((r.qid, r.pos, r.score, r.rk) for r in retrieve.rerank(hits, F.col("pos").cast("double"), 2).collect())
    assert got == [(1, 10, 0.5, 1), (2, 11, 11.0, 2), (2, 12, 12.0, 1)]


def test_best_of_batches_equals_all_scores(spark):
    import random

    from kashf.operators import dense, sparse

    r = random.Random(3)
    vectors = [(i, [r.choice((-1.0, 0.0, 0.5)) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [None, 1.0, 1.0, 1.0]), (None, [9.0] * 4)]
    index = spark.createDataFrame(vectors, "pos long, v array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [r.choice((-1.0, 0.25, 1.0)) for _ in range(4)]) for i in range(7)], "qid int, qv array<double>")
    got = dense.dense_top(asked, index, 9)
    assert dict(got.dtypes) == {"qid": "int", "pos": "bigint", "score": "double", "rk": "int"}
    want = sparse.top(dense.dense_scores(asked, index.where("pos < 300")), 9)
    both = [sorted((x.qid, x.rk, x.pos, x.score) for x in d.collect()) for d in (got, want)]
    assert both[0] == both[1]
    pairs = spark.createDataFrame([(0, 5), (0, 5), (3, 7), (3, 999)], "qid int, pos long")
    assert sorted((x.qid, x.pos) for x in dense.pair_scores(asked, index, pairs).collect()) == [(0, 5), (3, 7)]
    assert dense.dense_top(asked.where("qid < 0"), index, 9).count() == 0


def test_missing_hierarchy_flags_and_versions(spark, tmp_path):
    from kashf.functions.settings import flag
    from kashf.sources.hierarchy import load_hierarchy

    assert load_hierarchy(spark, str(tmp_path / "none.json")) is None
    assert flag("X", True, {}) and not flag("X", True, {"X": "no"}) and flag("X", False, {"X": " ON "})
    old = spark.createDataFrame([("a", "1", "va"), ("b", "2", "vb")], "name string, body string, version string")
    new = spark.createDataFrame([("a", "3", "va"), ("b", "4", "stale"), ("c", "5", None)], "name string, body string, replaces string")
    kept, refused = sinks.upsert_versioned(old, new)
    assert {x.name: x.body for x in kept.collect()} == {"a": "3", "b": "2", "c": "5"} and [x.name for x in refused.collect()] == ["b"]


def test_hot_terms_are_salted_without_changing_weights(spark, monkeypatch):
    from kashf.operators import sparse

    docs = spark.createDataFrame([(i, ["all", f"t{i % 7}"]) for i in range(60)], "pos int, ws array<string>")
    counts = sparse.term_counts(docs, "pos", F.col("ws"))
    weights = sparse.idf(counts, docs.agg(F.count("*").alias("n")))
    want = sorted((r.pos, r.term, round(r.w, 9)) for r in sparse.tfidf(counts, weights, "pos").collect())
    monkeypatch.setattr(sparse, "BROADCAST_TERMS", 3)
    assert sorted((r.pos, r.term, round(r.w, 9)) for r in sparse.tfidf(counts, weights, "pos").collect()) == want
