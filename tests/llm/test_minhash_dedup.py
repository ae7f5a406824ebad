import random
import re

import numpy as np

from kashf.llm import minhash_dedup as M

from .cases import documents, got, prose, rows, table


def shingles(t, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(data, n=3, percent=85):
    docs = [(r[0], shingles(r[1], n)) for r in data]
    label = {i: i for i, _ in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    live = [(i, s) for i, s in docs if s and i is not None]
    for k, (i, a) in enumerate(live):
        for j, b in live[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return table((i, len(s), root(i) if s and i is not None else i, i is None or (root(i) if s else i) == i) for i, s in docs)


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_equals_brute_force(spark):
    assert got(M.near_components(documents(spark)), *COLUMNS) == brute(rows())


def test_chains_hubs_and_thresholds(spark):
    r = random.Random(8)
    data, at = [], 0
    for g in range(12):
        words = prose(500 + g, r.randrange(20, 90)).split()
        for _ in range(14):  # a chain of edits: its ends are not alike
            k = r.randrange(len(words))
            words = [*words[:k], f"edit{at}", *words[k + 1 :]]
            data.append((r.randrange(10**9), " ".join(words), None, None, 0))
            at += 1
    assert got(M.near_components(documents(spark, data)), *COLUMNS) == brute(data)
    assert got(M.near_components(documents(spark, data), n=5, percent=80, bands=38, rows=5), *COLUMNS) == brute(data, 5, 80)


def test_one_large_group_of_copies(spark):
    data = [(i, prose(1, 50) if i % 2 else prose(i, 50), None, None, 0) for i in range(600)]
    assert got(M.near_components(documents(spark, data)), *COLUMNS) == brute(data)


def test_empty_table(spark):
    assert M.near_components(documents(spark, [])).count() == 0


def test_odd_sketches_keep_similar_pairs():
    sampler, r, bits = M.Sampler(32, 6), random.Random(2), M.most_bits(192, 0.85)
    words = M.Words()
    far = 0
    for _ in range(60):
        base = prose(r.randrange(10**9), 400).split()
        a = M.shingle_set(" ".join(base), 3, words)
        near = M.shingle_set(" ".join([*base[:200], *("n%d" % r.randrange(10**9) for _ in range(10)), *base[210:]]), 3, words)
        other = M.shingle_set(prose(r.randrange(10**9), 400), 3, words)
        sketch = [np.unpackbits(sampler.sketch(sampler.samples(s)).view(np.uint8)) for s in (a, near, other)]
        assert (sketch[0] != sketch[1]).sum() <= bits
        far += (sketch[0] != sketch[2]).sum() > bits
    assert far >= 58


def test_fine_sketches_lose_no_link_and_rule_out_the_rest(spark):
    """Pairs of known similarity: sets of up to SAMPLE shingles that are as similar always pass; a little below, next to none."""
    sampler, r, bits = M.Sampler(32, 6), np.random.default_rng(9), M.most_bits(192, 0.85)
    rows_, truth = [], []
    for k in range(1500):
        n = int(r.integers(5, 1000 if k % 5 else 6000))
        base = r.integers(0, 2**63, n).astype(np.uint64)
        swap = int(n * r.uniform(0, 0.16))
        a, b = np.unique(base), np.unique(np.concatenate([base[swap:], r.integers(0, 2**63, swap).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        truth.append((100 * both >= 85 * (len(a) + len(b) - both), both / (len(a) + len(b) - both), max(len(a), len(b))))
        ma, mb = sampler.samples(a), sampler.samples(b)
        rows_.append((k, len(a), len(b), *(x.tolist() for x in (sampler.sketch(ma), sampler.sketch(mb), sampler.fine(a), sampler.fine(b)))))
    df = spark.createDataFrame(rows_, "k int, na long, nb long, ka array<long>, kb array<long>, fa array<long>, fb array<long>")
    passed = {x.k for x in df.where(M.can_link(85, bits)).collect()}
    assert all(k in passed for k, (linked, _, _) in enumerate(truth) if linked)
    below = [k for k, (_, s, n) in enumerate(truth) if s < 0.82 and 200 < n <= M.SAMPLE]
    assert len(below) > 50 and sum(k in passed for k in below) < len(below) / 5


def test_links_of_a_whole_table_are_all_found(spark):
    """Recall of links, not of components alone: every pair of sf0.001 as an exact join finds it is in one component."""
    import os

    import pytest

    d = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(d):
        pytest.skip("no test data")
    docs = spark.read.parquet(d)
    data = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    assert got(M.near_components(docs), *COLUMNS) == brute(data)
    assert got(M.near_components(docs, n=5, percent=80, bands=38, rows=5), *COLUMNS) == brute(data, 5, 80)
