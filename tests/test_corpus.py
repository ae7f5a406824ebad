"""TF-IDF in blocks against the general way, on odd rows; plans without a row for each posting."""

import pytest
from pyspark.sql import functions as F

from kashf.functions import text as T
from kashf.operators import corpus, sparse

ROWS = [
    (1, "The cat sat. The cat ran; über 12 ½ naïve_cats"),
    (2, "مادة رقم ١٢ إجازة uni0041 university the cat"),
    (3, None),
    (4, ""),
    (5, "  \n "),
    (6, "a"),
    (1, "cat the"),
    (1, "cat the"),
    (None, "the cat of no key"),
    (None, None),
    (7, "İstanbul ΣΑΣ ’quoted’ space 日本語 the\x1ccat"),
    (8, "the cat sat"),
    (9, "the cat sat"),
]
ASKED = [(1, "the cat sat"), (2, "إجازة ١٢ university"), (3, "nothing-like-it"), (4, None), (1, "cats naïve_cats"), (None, "the cat"), (5, "日本語 σας the the")]
TERMS = {"words": lambda: T.word_ngrams(T.words(F.col("norm"))), "chars": lambda: T.char_ngrams(F.lower("norm"))}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def general(docs, kind):
    d = docs.select(F.col("doc_id").alias("pos"), T.norm_retrieval("text").alias("norm"))
    counts = sparse.term_counts(d, "pos", TERMS[kind]())
    weights = sparse.idf(counts, d.agg(F.count("*").alias("n")))
    return sparse.tfidf(counts, weights, "pos").where("pos is not null"), weights


def found(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_word_vectors(docs):
    assert found(corpus.word_vectors(docs)) == found(general(docs, "words")[0])


@pytest.mark.parametrize("kind", ["words", "chars"])
def test_cosines_of_all_and_of_pairs(spark, docs, kind):
    asked = spark.createDataFrame(ASKED, "qid int, q string")
    dv, weights = general(docs, kind)
    counts = sparse.term_counts(asked.where("qid is not null").withColumn("norm", T.norm_retrieval("q")), "qid", TERMS[kind]())
    want = found(sparse.cosine(sparse.tfidf(counts, weights, "qid"), dv).select("qid", "pos", "score"))
    assert want and found(corpus.cosines(docs, asked, kind, 100)) == want
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (5, 7), (9, 9), (1, None)], "qid int, pos long")
    assert found(corpus.cosines(docs, asked, kind, pairs=pairs)) == [r for r in want if r[:2] in {(1, 1), (2, 2), (5, 7)}]


def test_ties_go_to_the_smaller_key(spark, docs):
    asked = spark.createDataFrame([(1, "the cat sat")], "qid int, q string")
    assert [r.pos for r in sparse.top(corpus.cosines(docs, asked, "words", 1), 1).collect()] == [8]


def test_counts(docs):
    norm = docs.withColumn("norm", T.norm_retrieval("text"))
    for some in (norm, norm.where("doc_id <> 1")):  # with repeated keys and without
        want = sparse.term_counts(some, "doc_id", T.words(F.col("norm")))
        assert sorted(map(repr, map(tuple, corpus.term_counts(some).collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert found(corpus.document_counts(some)) == found(want.groupBy("term").agg(F.count("*")))


def test_products_of_common_and_rare_terms():
    import numpy as np

    g = np.random.default_rng(1)
    x, w = g.random((130, 50)) * (g.random((130, 50)) < 0.3), g.random((50, 40)) * (g.random((50, 40)) < np.linspace(0, 0.6, 50)[:, None])
    (d, c), (t, q) = np.nonzero(x), np.nonzero(w)
    assert np.allclose(corpus.products(d, c, x[d, c], 130, t, q, w[t, q], 50, 40), x @ w)


@pytest.mark.parametrize("name", ["sparse_topk", "best_snippet", "source_list", "retrieve_full", "word_bigram_tfidf", "char_tfidf_topk", "hybrid_topk", "rerank_topk", "word_tf", "word_idf"])
def test_no_row_for_each_posting(spark, tmp_path, name):
    from kashf.plans import catalog

    docs = [(i, f"the cat {i} sat on mat {i % 3}. It ran away from the dog", "en") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"the cat {i}") for i in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], i % 10) for i in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
