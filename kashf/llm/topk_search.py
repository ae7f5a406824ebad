"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments. With the means m and deviations s of the
segments, each of length n, sum n * (m_q * m_c + s_q * s_c) is at least the inner
product (equally, it bounds the distance from below). A coarse resolution
rules out most pairs, a finer one most of the rest; the survivors get
exact integer scores.

Queries come in chunks of at most ``CHUNK``, each broadcast (CHUNK vectors, so
bounded) and held against all rows in blocks; no pair is a row. A chunk's queries are
rows themselves, so their own best scores are the first bounds; a task
tightens them as it goes and returns at most k rows a query.

Vectors that are null or hold null or non-finite components, and null
ids, take no part. Only vectors of the query's length compare. Rows that share the query's id are
its own; other repeated rows are ranked each. Equal scores go to smaller ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, table

CHUNK = 16_384
LEVELS = (4, 16)


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(n) * mean and sqrt(n) * deviation by segment; the product of two such rows bounds the inner product."""
    d = x.shape[1]
    cuts = np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(int)
    cuts = np.unique(cuts)
    if len(cuts) < 2:
        return np.zeros((len(x), 2))
    n = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.concatenate([total / np.sqrt(n), np.sqrt(np.maximum(square - total * total / n, 0))], axis=1)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.q, self.k = ids, q.astype(float), k
        self.wide = q.astype(np.int64)
        self.stats = [segment_stats(self.q, s) for s in LEVELS]
        self.low = floor.astype(float).copy()
        self.found = np.zeros((0, 3), np.int64)  # query's place, score, id

    def add(self, ids: np.ndarray, c: np.ndarray, rows: int = 2048) -> None:
        for at in range(0, len(self.ids), rows):
            self._block(slice(at, at + rows), ids, c)

    def _block(self, at, ids, c):
        x = c.astype(float)
        coarse, fine = (segment_stats(x, s) for s in LEVELS)
        slack = 1e-9 * (np.abs(self.stats[0][at]).sum(1).max(initial=0) * np.abs(coarse).sum(1).max(initial=0) + 1)
        i, j = np.nonzero(self.stats[0][at] @ coarse.T + slack >= self.low[at, None])
        got = []
        for p in range(0, len(i), 200_000):
            a, b = i[p : p + 200_000] + at.start, j[p : p + 200_000]
            ok = np.einsum("ij,ij->i", self.stats[1][a], fine[b]) + slack >= self.low[a]
            a, b = a[ok], b[ok]
            score = np.einsum("ij,ij->i", self.wide[a], c[b])
            ok = (score >= self.low[a]) & (ids[b] != self.ids[a])
            got.append(np.stack([a[ok], score[ok], ids[b[ok]]], axis=1))
        self.found = np.concatenate([self.found, *got])
        if len(self.found) > 4 * self.k * len(self.ids):
            self.cut()

    def cut(self):
        f = self.found[np.lexsort((self.found[:, 2], -self.found[:, 1], self.found[:, 0]))]
        first = np.searchsorted(f[:, 0], f[:, 0])
        place = np.arange(len(f)) - first
        kth = f[place == self.k - 1]
        self.low[kth[:, 0]] = np.maximum(self.low[kth[:, 0]], kth[:, 1])
        self.found = f[place < self.k]


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, v array<long>) of the rows that take part."""
    usable = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def topk(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query."""
    spark = rows.sparkSession
    all_ = whole_vectors(rows, key, vector, scale)
    queries = whole_vectors(rows.where(is_query), key, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = max(1, -(-queries.count() // CHUNK))
    parts = []
    for chunk in range(chunks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk).toPandas()
        by_size: dict = {}
        for i, v in zip(mine.vec_id, mine.v):
            by_size.setdefault(len(v), []).append((i, v))
        ready = {}
        for d, xs in by_size.items():
            ids, q = np.array([i for i, _ in xs], np.int64), np.array([v for _, v in xs], np.int64).reshape(len(xs), d)
            best = Best(ids, q, k, np.full(len(ids), -np.inf))
            for p in range(0, len(ids), 512):
                best.add(ids[p : p + 512], q[p : p + 512])
                best.cut()
            ready[d] = (ids, q, best.low)
        shared = spark.sparkContext.broadcast(ready)

        def setup(shared=shared):
            return {d: Best(ids, q, k, low) for d, (ids, q, low) in shared.value.items()}

        def add(state, cols):
            sizes: dict = {}
            for i, v in zip(cols["vec_id"], cols["v"]):
                if len(v) in state:
                    sizes.setdefault(len(v), ([], []))[0].append(i)
                    sizes[len(v)][1].append(v)
            for d, (ids, vs) in sizes.items():
                state[d].add(np.array(ids, np.int64), np.array(vs, np.int64).reshape(len(ids), d))
                state[d].cut()

        def finish(state):
            for b in state.values():
                b.cut()
            f = [(b.ids[b.found[:, 0]], b.found) for b in state.values()]
            if not f:
                return None
            return {"query_id": np.concatenate([x for x, _ in f]), "vec_id": np.concatenate([x[:, 2] for _, x in f]), "score": np.concatenate([x[:, 1] for _, x in f])}

        parts.append(arrow_map(all_, add, "query_id long, vec_id long, score long", rows=512, setup=setup, finish=finish))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark, sf_dir):
    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 10
"""
