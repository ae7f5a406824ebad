import hashlib
import random

import numpy as np

from kashf.llm import suffix_dedup as S
from kashf.llm.suffix_dedup import WINDOW, SuffixLevels, suffix_dedup

from .cases import documents, got, prose, rows, table


def brute(data):
    seen, out = set(), []
    for i, t in sorted(((r[0], r[1] or "") for r in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - WINDOW + 1):
            w = b[s : s + WINDOW]
            if w in seen:
                gone[s : s + WINDOW] = b"\1" * WINDOW
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return table(out)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_equals_brute_force(spark):
    assert got(suffix_dedup(documents(spark), block_docs=3), *COLUMNS) == brute(rows())


def test_random_small_alphabets(spark):
    r = random.Random(11)
    pool = ["".join(r.choice("ab ") for _ in range(260)) for _ in range(6)]
    data = []
    for i in range(60):
        parts = [p[r.randrange(120) : r.randrange(120, 260)] for p in r.choices(pool, k=3)]
        data.append((i, "".join(parts) + "z" * r.randrange(0, 230), None, None, 0))
    assert got(suffix_dedup(documents(spark, data), block_docs=4), *COLUMNS) == brute(data)


def test_anchors_too_frequent_for_a_bucket_are_asked_window_by_window(spark, monkeypatch):
    from kashf.llm import suffix_dedup as module

    # the functions are shipped by value, so the bound goes along
    monkeypatch.setattr(module, "HOT", 3)
    assert got(suffix_dedup(documents(spark), block_docs=3), *COLUMNS) == brute(rows())


def test_empty_table(spark):
    assert suffix_dedup(documents(spark, [])).count() == 0


def test_spans_and_text(spark):
    out = suffix_dedup(documents(spark, [(1, "q" * 150, None, None, 0), (2, "q" * 99, None, None, 0)]), with_text=True).orderBy("doc_id").collect()
    assert out[0].n_removed == 149 and out[0].kept_text == "q" and [tuple(s) for s in out[0].spans] == [(1, 150)]
    assert out[1].n_removed == 0


def test_levels_grow_geometrically():
    family, seen, r = SuffixLevels(4), set(), np.random.default_rng(3)
    for _ in range(200):
        batch = r.integers(97, 101, (20, 4)).astype(np.uint8).view("S4").ravel()
        expected = []
        for x in batch.tolist():
            expected.append(x in seen)
            seen.add(x)
        assert family.add(batch).tolist() == expected
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_blocks_are_hashed_in_little_memory():
    import tracemalloc

    texts = [prose(i, 400).encode() for i in range(700)]
    assert sum(map(len, texts)) > 1 << 21
    S._hasher()
    tracemalloc.start()
    S.Block(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
