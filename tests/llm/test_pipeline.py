import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from kashf.llm import toxicity
from kashf.llm.common import tokenizer_path
from kashf.llm.packing import MODEL

from .cases import documents, prose, rows, table
from .test_minhash_dedup import brute as near_brute
from .test_packing import brute_pieces
from .test_packing import check as check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(data):
    """What is left of each text under the rule of 100-byte strings; characters that lose a part go whole."""
    seen, out = set(), {}
    for i, t in sorted(((r[0], r[1] or "") for r in data if r[0] is not None)):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def data_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_against_brute_force(spark):
    data = [r for r in rows() if r[0] is not None and r[0] != 7]
    data = list(dict.fromkeys(data)) + [(900 + i, prose(1, 60) + f" tail{i} " + prose(70 + i, 30), "en", "s", 0) for i in range(4)]
    docs = documents(spark, data, clashing=False)
    near = C.near_dedup_stage(spark, docs, SF)
    assert near.columns == COLUMNS
    kept = {i for i, _, _, k in near_brute(data, 5, 80) if k}
    assert table(data_of(near)) == table(r for r in data if r[0] in kept)
    left = data_of(near)
    after = C.suffix_dedup_stage(spark, near, SF)
    assert after.columns == COLUMNS
    want = cut(left)
    for i, text, _, _, n in data_of(after):
        before = next(r[1] for r in left if r[0] == i)
        assert text == (None if before is None else want[i]) and n == (None if text is None else len(text))
    out = C.packing_stage(spark, after, SF).collect()
    assert table((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute_pieces(data_of(after), 2048)
    check_packing(out, 2048)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    first = C.toxicity_stage(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - rejected
    kept = {i for i, _, _, k in near_brute(data_of(first), 5, 80) if k}
    texts = cut([r for r in data_of(first) if r[0] in kept])
    want = brute_pieces([(i, t) for i, t in texts.items()], 2048)
    out = C.run(spark, SF).collect()
    assert table((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_packing(out, 2048)


def test_rows_without_id_and_empty_tables(spark):
    docs = documents(spark, clashing=False)
    near = C.near_dedup_stage(spark, docs, SF)
    after = data_of(C.suffix_dedup_stage(spark, near, SF))
    ids = [r[0] for r in after]
    assert ids.count(None) == 2 and ids.count(7) == 1
    empty = documents(spark, [], clashing=False)
    for _, stage in C.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0


def test_tokenizer_is_there():
    assert os.path.exists(tokenizer_path(MODEL))


def test_clashing_columns_and_tables_without_n_chars(spark):
    names = ["_cut_id", "_cut_text", "_no_text", "_n", "_row", "score", "predicted", "held_out", "kept", "_c0", "doc", "n_passages"]
    docs = documents(spark).select("*", *[F.lit("clash").alias(c) for c in names]).drop("n_chars")
    for _, stage in C.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got_ = out.collect()
        assert got_ and all(r[c] == "clash" for r in got_ for c in names)
    assert C.packing_stage(spark, docs, SF).count() >= docs.count()


def test_every_stage_takes_an_empty_table(spark):
    empty = documents(spark, [])
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0


def shuffled(node) -> int:
    """Bytes that the exchanges of a plan that has run have taken in."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return shuffled(node.executedPlan())
    if "QueryStage" in name:
        return shuffled(node.plan())
    own = node.metrics().get("dataSize").get().value() if name == "Exchange" else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_near_dedup_shuffles_few_texts_and_leaves_little_on_disk(spark):
    data = [(i, prose(i, 60), "en", "s", 0) for i in range(400)]
    data += [(1000 + i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(data[:40])]
    docs = documents(spark, data, clashing=False)
    shared = spark.conf.get("spark.checkpoint.dir")
    before, broadcast = set(os.listdir(shared)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.near_dedup_stage(spark, docs.localCheckpoint(), SF)
        assert sorted(r.doc_id for r in out.collect()) == list(range(400))
        assert shuffled(out._jdf.queryExecution().executedPlan()) < sum(len(r[1]) for r in data) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    left = set(os.listdir(shared)) - before
    assert not [x for x in left if x.startswith(("kashf-signatures", "kashf-classes"))]
    assert sum(spark.read.parquet(f"{shared}/{x}").count() for x in left if x.startswith("kashf-kept")) == len(data)


def test_bitmaps_tell_which_ids_may_be_held(spark):
    held = spark.createDataFrame([(i,) for i in range(0, 6000, 3)], "doc_id long")
    rows_ = spark.createDataFrame([(i, "t") for i in range(-50, 6000)], "doc_id long, text string")
    for most in (1 << 26, 1 << 12, 1):
        bits = C.bitmap(held, 1, most)
        yes, no = ({r.doc_id for r in C.in_bitmap(rows_, bits, 1, x).collect()} for x in (True, False))
        assert yes | no == set(range(-50, 6000)) and not yes & no and yes >= set(range(0, 6000, 3))
        assert most < 1 << 26 or len(yes) < 2200


def test_near_dedup_is_exact_where_bits_clash(spark, monkeypatch):
    docs = documents(spark, clashing=False)
    want = table(data_of(C.near_dedup_stage(spark, docs, SF)))
    own = C.bitmap
    monkeypatch.setattr(C, "bitmap", lambda ids, salt: own(ids, salt, 2))
    assert table(data_of(C.near_dedup_stage(spark, docs, SF))) == want
