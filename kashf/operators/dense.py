"""Dense retrieval by inner product over unit vectors, accumulated in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .sparse import top

#: A batch of questions beyond this size is joined by blocks instead of being broadcast.
BROADCAST_QUESTIONS = 20_000


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v):
    """The vector at length 1; a zero vector stays."""
    return bound(v, lambda w: bound(F.sqrt(dot(w, w)), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(x))))


def dense_scores(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, pos, score) of (qid, qv) against (pos, v): a batch of questions against all rows.

    The batch is broadcast if it is counted to be small, otherwise both sides
    meet block by block. Every row is scored either way.
    """
    n = questions.limit(BROADCAST_QUESTIONS + 1).count()
    score = F.round(dot("qv", "v"), 6).alias("score")
    if n <= BROADCAST_QUESTIONS:
        return index.join(F.broadcast(questions), F.lit(True)).select("qid", "pos", score)
    blocks = 1 + questions.count() // BROADCAST_QUESTIONS
    q = questions.withColumn("_b", F.pmod(F.hash("qid"), F.lit(blocks)))
    return index.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q, "_b").select("qid", "pos", score)


def pair_scores(questions: DataFrame, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, pos, score) of the given (qid, pos) alone: vectors meet the pairs before anything is scored."""
    met = pairs.select("qid", "pos").distinct().join(index.select("pos", "v"), "pos").join(questions.select("qid", "qv"), "qid")
    return met.select("qid", "pos", F.round(dot("qv", "v"), 6).alias("score"))


def best_of_batch(ids: np.ndarray, questions: np.ndarray, pos: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, pos, score) of each question's k best in a batch; equal scores go to the smaller pos."""
    scores = np.round(questions @ vectors.T, 6) + 0.0
    q, p = np.divmod(np.arange(scores.size), max(1, len(pos)))
    if len(pos) > k:
        least = np.partition(scores, len(pos) - k, axis=1)[:, len(pos) - k]
        q, p = np.nonzero(scores >= least[:, None])
    s = scores[q, p]
    order = np.lexsort((pos[p], -s, q))
    q, p, s = q[order], p[order], s[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return ids[q[near]], pos[p[near]], s[near]


def dense_top(questions: DataFrame, index: DataFrame, k: int = 60, chunk: int = 1024) -> DataFrame:
    """(qid, pos, score, rk): the k best of each question. A task keeps k rows a question and batch, so pairs are never rows.

    Questions are broadcast if they are counted to be few; more of them, vectors of several sizes or with null components
    and keys that are no numbers go the way of dense_scores.
    """
    asked = questions.select("qid", "qv").limit(BROADCAST_QUESTIONS + 1).toPandas()
    sizes = {len(v) for v in asked.qv if v is not None}
    kinds = dict(questions.dtypes)["qid"], dict(index.dtypes)["pos"]
    plain = len(asked) and len(asked) <= BROADCAST_QUESTIONS and len(sizes) == 1 and asked.qv.notna().all() and asked.qid.notna().all() and {*kinds} <= {"int", "bigint"}
    if not plain or not all(x is not None and x == x for v in asked.qv for x in v):
        return top(dense_scores(questions, index), k)
    size = sizes.pop()
    shared = questions.sparkSession.sparkContext.broadcast((asked.qid.to_numpy(np.int64), np.array([list(v) for v in asked.qv], float)))

    def best(batches):
        ids, q = shared.value
        for b in batches:
            flat, pos = b.column(1), b.column(0).to_numpy(zero_copy_only=False)
            v = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(pos), size)
            for at in range(0, len(ids), chunk):
                found = best_of_batch(ids[at : at + chunk], q[at : at + chunk], pos, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "pos", "score"])

    usable = (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.col("pos").isNotNull()
    whole = index.where(usable).select(F.col("pos").cast("long"), F.col("v").cast("array<double>"))
    found = whole.mapInArrow(best, "qid long, pos long, score double")
    return top(found.select(F.col("qid").cast(kinds[0]), F.col("pos").cast(kinds[1]), "score"), k)
