import zlib

import numpy as np
import pytest

from kashf.llm.toxicity import learn, op2_toxicity, score, segments

from .cases import documents, got, rows


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the segment of the greatest sum (the longest leftmost has no part that can be cut), then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[0]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute_segments(scores[:i]) + [best] + [(a, b + j, c + j) for a, b, c in brute_segments(scores[j:])]


def test_segments_are_maximal():
    r = np.random.default_rng(0)
    for _ in range(200):
        x = r.normal(size=12)
        want = brute_segments(x.tolist())
        have = sorted(segments(x), key=lambda t: t[1])
        assert [(a, b) for _, a, b in have] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in have], [s for s, _, _ in want])


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS text", "'clash' AS slot")


def test_learns_and_ignores_held_out_labels(spark):
    r = np.random.default_rng(1)
    bad, good = ["vile", "wretch", "scumbag"], ["garden", "river", "bread", "window", "stone"]
    data, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [*r.choice(good, 60)]
        if toxic:
            words[20:20] = r.choice(bad, 15).tolist()
        data.append((i, " ".join(words), "en", "s", 0))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        marks.append((i, 0, int(toxic) if not held else int(not toxic)))  # held-out labels are wrong on purpose
    docs = documents(spark, data)
    out = score(docs, learn(docs, labels(spark, [*marks, (5, None, None), (None, 1, 1), (10**6, 0, 1)]))).collect()
    assert len(out) == 400
    for row in out:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert row.predicted == int(row.doc_id % 4 == 0) == int(row.score >= 0.5), row


def test_cases_and_degenerate_labels(spark):
    docs = documents(spark)
    for marks, constant in (([], 0.0), ([(13, 0, 1), (23, 0, 1), (33, 0, 1), (43, 0, 1)], 1.0)):
        out = score(docs, learn(docs, labels(spark, marks))).collect()
        assert len(out) == len(rows()) and {r.score for r in out} == {constant}
    empty = documents(spark, [])
    assert score(empty, learn(empty, labels(spark, []))).count() == 0
    both = labels(spark, [(i, 0, i % 20 // 10) for i in range(3, 300, 10)])
    out = got(score(docs, learn(docs, both)), "doc_id", "score", "predicted")
    assert len(out) == len(rows()) and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in out)


def test_held_out_accuracy_on_the_labelled_table(spark):
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows_ = [(r.score, r.predicted, y[r.doc_id]) for r in op2_toxicity(spark, d).where("held_out").collect() if y.get(r.doc_id) is not None]
    pos = [s for s, _, t in rows_ if t]
    neg = [s for s, _, t in rows_ if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    accuracy = np.mean([p == t for _, p, t in rows_])
    print("held out:", len(rows_), "auc", auc, "accuracy", accuracy)
    assert auc > 0.9 and accuracy > 0.9


def brute_scores(data, marks):
    """The rule of the module's docstring, in plain Python over all rows at once."""
    import math
    import re
    from collections import Counter

    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t, *_ in data}
    y = {i: int(t > 0) for i, _, t in marks if zlib.crc32(str(i).encode()) % 5}
    names = lambda w: [zlib.crc32(f.encode()) % (1 << 20) for f in dict.fromkeys([w + "$", *(w[:n] for n in (4, 5, 6) if len(w) >= n)])]
    count = (Counter(), Counter())
    for i, label in y.items():
        for w in words[i]:
            count[label].update(names(w))
    seen = set(count[0]) | set(count[1])
    total = [sum(c.values()) for c in count]
    prior = {f: 0.5 + 1000 * (count[0][f] + count[1][f]) / sum(total) for f in seen}
    z0 = sum(prior.values())
    sure = {}
    for f in seen:
        a, b = count[1][f] + prior[f], count[0][f] + prior[f]
        d = math.log(a / (total[1] + z0 - a)) - math.log(b / (total[0] + z0 - b))
        sure[f] = (d, d / math.sqrt(1 / a + 1 / b))

    def word(w):
        d, z = max((sure.get(f, (0.0, 0.0)) for f in names(w)), key=lambda x: abs(x[1]))
        return (d if abs(z) >= 3.3 else 0.0) - 0.25

    scores = {i: [word(w) for w in ws] for i, ws in words.items()}
    clean = [s for i, label in y.items() if not label for s in scores[i]]
    lo, hi = 0.0, 64.0
    if any(s > 0 for s in clean):
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.mean(np.exp(np.minimum(mid * np.round(clean, 2), 500))) < 1 else (lo, mid)
    else:
        hi = 1.0
    size = {i: math.log(max(1, len(ws))) for i, ws in words.items()}
    segs = {i: [s for s, _, _ in segments(np.array(x))] if x else [] for i, x in scores.items()}
    log_k = np.mean([hi * max(segs[i], default=0.0) - size[i] for i, label in y.items() if not label]) - 0.5772
    x = {i: math.log1p(sum(max(0.0, hi * s - log_k - size[i]) for s in ss)) for i, ss in segs.items()}
    return x, y


def test_scores_follow_the_evidence_by_brute_force(spark):
    r = np.random.default_rng(3)
    bad, good = ["vile", "wretch", "scumbag", "wretched"], ["garden", "river", "bread", "window", "stone", "vilest"]
    data, marks = [], []
    for i in range(300):
        words = [*r.choice(good, int(r.integers(1, 90)))]
        if i % 3 == 0:
            at = int(r.integers(0, len(words)))
            words[at:at] = r.choice(bad, int(r.integers(1, 9))).tolist()
        data.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 0, int(i % 3 == 0)))
    data.append((1000, None, None, None, None))
    docs = documents(spark, data)
    model = learn(docs, labels(spark, marks))
    x, y = brute_scores(data, marks)
    out = {row.doc_id: row.score for row in score(docs, model).collect()}
    want = {i: 1 / (1 + np.exp(-(model.a + model.b * v))) for i, v in x.items()}
    assert out.keys() == want.keys() and max(abs(out[i] - want[i]) for i in want) < 1e-6
    # the curve is the least of the penalised loss, on Platt's targets
    pos = sum(y.values())
    t = {i: (pos + 1) / (pos + 2) if label else 1 / (len(y) - pos + 2) for i, label in y.items()}

    def loss(a, b):
        p = {i: 1 / (1 + np.exp(-(a + b * x[i]))) for i in y}
        return -sum(t[i] * np.log(p[i]) + (1 - t[i]) * np.log(1 - p[i]) for i in y) + 5e-4 * (a * a + b * b)

    best = loss(model.a, model.b)
    assert all(loss(model.a + da, model.b + db) >= best - 1e-4 for da in (-0.2, 0, 0.2) for db in (-0.2, 0, 0.2))
