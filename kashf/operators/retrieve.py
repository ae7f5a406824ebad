"""Hybrid retrieval: dense candidates, weighted with sparse scores, optionally reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sparse import top

WEIGHTS = (0.60, 0.20, 0.20)


def combine(dense: DataFrame, chars: DataFrame | None, words: DataFrame | None, k: int = 30, weights=WEIGHTS) -> DataFrame:
    """(qid, pos, score, rk): sparse scores are added to dense candidates and never bring candidates of their own."""
    out = dense.select("qid", "pos", F.col("score").alias("d"))
    for name, part in (("c", chars), ("w", words)):
        out = out.withColumn(name, F.lit(0.0)) if part is None else out.join(part.select("qid", "pos", F.col("score").alias(name)), ["qid", "pos"], "left")
    parts = [F.coalesce(n, F.lit(0.0)) * x for n, x in zip("dcw", weights)]
    return top(out.select("qid", "pos", F.round(parts[0] + parts[1] + parts[2], 6).alias("score")), k)


def rerank(hits: DataFrame, scorer=None, k: int = 8) -> DataFrame:
    """The k best by ``scorer``, a Column; a question's only hit keeps its score, and without a scorer hits keep their rank."""
    if scorer is None:
        return hits.where(F.col("rk") <= k)
    alone = F.count("*").over(W.partitionBy("qid")) == 1
    scored = hits.withColumn("score", F.when(alone, F.col("score")).otherwise(scorer)).drop("rk")
    return top(scored, k)
