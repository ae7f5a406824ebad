"""TF-IDF in long form: (pos, term, w), smoothed idf ln((1 + n) / (1 + df)) + 1, rows of length 1.

Postings are narrow rows that partition by term; sums are combined before each
shuffle. A query batch meets the postings through its own terms only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf)"""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf); ``n_docs`` is one row (n), so that its broadcast is bounded."""
    return idf_of(counts.groupBy("term").agg(F.count("*").alias("df")), n_docs)


def idf_of(df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df)"""
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


#: Terms with their idf are broadcast up to this number; beyond it hot terms are dealt over SALTS places.
BROADCAST_TERMS, SALTS = 1_000_000, 16


def with_idf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(..., term, tf, idf): a term that every document holds gathers in no one task."""
    known = weights.select("term", "idf")
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return counts.join(F.broadcast(known), "term")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return counts.withColumn("_salt", F.pmod(F.xxhash64(*counts.columns), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")


def tfidf(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w). Terms without idf are dropped before the norm is taken, which needs one document's terms together, no more."""
    raw = with_idf(counts, weights).select(key, "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("x") / norm).alias("w"))


def cosine(queries: DataFrame, docs: DataFrame, qid: str = "qid", pos: str = "pos") -> DataFrame:
    """(qid, pos, score) of the pairs that share a term; both sides are tfidf() rows."""
    q = queries.select(qid, "term", F.col("w").alias("qw"))
    return q.join(docs, "term").groupBy(qid, pos).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def top(scores: DataFrame, k: int, group: str = "qid", by: str = "score", tie: str = "pos", rank: str = "rk") -> DataFrame:
    """The k best of each group; equal scores go to the smaller tie."""
    w = W.partitionBy(group).orderBy(F.desc(by), tie)
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
