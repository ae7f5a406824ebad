import numpy as np
from pyspark.sql import functions as F

from kashf.llm import blocks as B

from .cases import documents, rows


def test_labels_are_even_and_in_order(spark):
    for parts in (1, 8, 51):
        want = [r.p for r in spark.range(3000).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).collect()]
        assert B.partition_of(np.arange(3000), parts).tolist() == want
        for blocks in (1, 7, 63, 800):
            labels = B.even_labels(blocks, parts)
            assert len(labels) == blocks and (np.diff(labels) > 0).all()
            if blocks <= 16 * parts:
                assert np.bincount(B.partition_of(labels, parts), minlength=parts).max() == -(-blocks // parts)


def test_every_row_is_dealt_once(spark):
    want = sorted(((i is not None, i or 0, t or "") for i, t, *_ in rows()))
    for ordered in (True, False):
        dealt, blocks = B.deal(documents(spark), 4, ordered)
        groups = {r._b: [] for r in dealt.select("_b").distinct().collect()}
        for r in dealt.collect():
            groups[r._b] += [(k is not None, k or 0, t) for k, t in B.unpacked(r.data)]
        assert blocks > 8 and len(groups) > 1 and sorted(x for g in groups.values() for x in g) == want
        if ordered:
            ids = [[k for known, k, _ in groups[b] if known] for b in sorted(groups)]
            ids = [x for x in ids if x]
            assert all(max(a) < min(b) for a, b in zip(ids, ids[1:]))
