"""The whole way from a question to an answer, for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import compose, dense, evaluate, gate, retrieve, sparse
from ..sources.index import Index, hashed_encoder
from .lineage import cut


def question_terms(questions: DataFrame, terms, weights: DataFrame) -> DataFrame:
    return sparse.tfidf(sparse.term_counts(questions, "qid", terms), weights, "qid")


def weighted(near: DataFrame, chars: DataFrame | None, words: DataFrame | None, k: int = 30) -> DataFrame:
    """(qid, pos, score, rk) of candidates with their gate: the weighted sum is ranked undamped, and what came by the fallback is damped as a whole."""
    damp = near.where("gate = 'fallback'").select("qid").distinct().withColumn("f", F.lit(gate.DAMPING))
    undamped = near.withColumn("score", F.when(F.col("gate") == "fallback", F.col("score") / gate.DAMPING).otherwise(F.col("score")))
    mixed = retrieve.combine(undamped, chars, words, k).join(damp, "qid", "left")
    return mixed.withColumn("score", F.col("score") * F.coalesce("f", F.lit(1.0))).drop("f")


def hits(index: Index, questions: DataFrame, hierarchy: tuple[DataFrame, DataFrame] | None = None, encoder=None, reranker=None, k: int = 8, compat: bool = False) -> DataFrame:
    """(qid, rk, pos, page, text, score) of (qid, q); hierarchy is (postings, aliases)."""
    encoder = encoder or hashed_encoder()
    qn = T.norm_retrieval("q")
    asked = questions.select("qid", encoder(qn).alias("qv"))
    rank = lambda d, n: sparse.top(d, n).drop("rk")
    if hierarchy:
        postings = hierarchy[0].select("heading", "pos") if compat else gate.locate(hierarchy[0], index.chunks)
        allowed = cut(gate.candidates(gate.candidate_keys(questions, hierarchy[1]), postings))
        if compat:
            near = gate.with_fallback(gate.gated(dense.dense_scores(asked, index.dense), allowed, rank, 60, True), dense.dense_top(asked, index.dense).drop("rk"), allowed)
        else:
            inside = rank(dense.pair_scores(asked, index.dense, allowed), 60)
            outside = asked.join(inside.select("qid").distinct(), "qid", "left_anti")
            near = gate.with_fallback(inside, dense.dense_top(outside, index.dense).drop("rk"), allowed)
    else:
        near = dense.dense_top(asked, index.dense).drop("rk").withColumn("gate", F.lit("open"))
    words = sparse.cosine(question_terms(questions, T.word_ngrams(T.words(qn)), index.word_idf), index.words)
    chars = sparse.cosine(question_terms(questions, T.char_ngrams(F.lower(qn)), index.char_idf), index.chars)
    full = weighted(near, chars, words).join(index.chunks.select("pos", "page", "text"), "pos").join(questions.select("qid", "q"), "qid")
    return retrieve.rerank(full, reranker, k).select("qid", "rk", "pos", "page", "text", "score")


def answer(index: Index, questions: DataFrame, **options) -> DataFrame:
    """(qid, q, intent, body, pages, found)"""
    asked = questions.select("qid", "q", L.classify("q").alias("intent"))
    return compose.answers(hits(index, questions, **options), asked, options.get("compat", False))


def run(index: Index, questions: DataFrame, **options) -> DataFrame:
    """Answers, checked and repaired."""
    return evaluate.evaluate(answer(index, questions, **options), index.chunks, options.get("compat", False))
