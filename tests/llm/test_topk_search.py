import math

import numpy as np
from pyspark.sql import functions as F

from kashf.llm.topk_search import LEVELS, segment_stats, topk


def brute(data, is_query, k=10):
    ok = [(i, np.array([math.floor(1024 * float(np.float32(x))) for x in v], np.int64)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if is_query(i) and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    out = []
    for q, v in queries.items():
        best = sorted((-int(v @ c), i) for i, c in ok if i != q and len(c) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "0 AS label", "'clash' AS score", "'clash' AS v", "'clash' AS query_id").repartition(7)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    r = np.random.default_rng(0)
    data = [(i, r.normal(size=24).astype("float32").tolist()) for i in range(500)]
    data += [(i, data[i % 7][1]) for i in range(500, 700)]  # ties
    data += [data[100], (200, None), (300, [None] * 24), (800, [float("nan")] * 24), (900, [float("inf")] * 24), (None, data[3][1]), (1000, []), (1100, [1.0, 2.0]), (1101, [0.5, -2.0]), (1200, [0.0] * 24)]
    assert found(topk(frame(spark, data), F.col("vec_id") % 100 == 0)) == brute(data, lambda i: i % 100 == 0)


def test_several_chunks_of_queries(spark, monkeypatch):
    from kashf.llm import topk_search as module

    monkeypatch.setattr(module, "CHUNK", 40)
    r = np.random.default_rng(1)
    data = [(i, r.normal(size=8).astype("float32").tolist()) for i in range(300)]
    assert found(topk(frame(spark, data), F.col("vec_id") % 3 == 0, k=4)) == brute(data, lambda i: i % 3 == 0, 4)


def test_fewer_rows_than_k_and_empty(spark):
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert found(topk(frame(spark, data), F.col("vec_id") % 100 == 0)) == brute(data, lambda i: i % 100 == 0)
    assert topk(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_segment_statistics_bound_the_product():
    r = np.random.default_rng(2)
    a, b = r.integers(-1000, 1000, (200, 50)).astype(float), r.integers(-1000, 1000, (300, 50)).astype(float)
    exact, last = a @ b.T, None
    for level in LEVELS:
        bound = segment_stats(a, level) @ segment_stats(b, level).T
        assert (bound >= exact - 1e-3).all()
        last = bound if last is None else last
    assert bound.mean() <= last.mean()
