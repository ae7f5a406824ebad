"""Toxicity by maximum-scoring segments of token log-odds.

Learning. From at most ``most_labels`` labelled rows (those with the least
hash of doc_id; held-out rows are never among them) the words and their
beginnings of 4, 5 and 6 letters are counted by label. A feature's score is the difference of its log-odds in
toxic and clean texts under a Dirichlet prior, which holds ``PRIOR`` of each feature and as
many words as ``PRIOR_WORDS`` spread as in both classes together; it counts where it is ``SURE`` deviations
from 0. A word takes its surest feature. Every word also costs ``DRIFT``, so that
segments end.

Scoring. One linear scan (Ruzzo and Tompa's) finds all maximal segments. In
clean texts of n words the best segment follows an extreme-value law with the parameters
lambda, the root of E[exp(lambda s)] = 1, and K, fitted to the clean
labelled texts; so lambda * S - ln(K n) tells how far a segment stands out.
Those above ``SIGNIFICANT`` are the passages. Their sum is turned into a probability by a logistic curve
fitted on the same labelled rows.

Null and empty texts hold no segment. Rows without a label, null labels
and labels without a document teach nothing; of several labels of a doc_id the greatest counts. Without both
classes among the labels every score is the share of toxic ones (none: 0).
Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, table, unstore

WORD = re.compile(r"\w+")
SLOTS = 1 << 20
PRIOR, PRIOR_WORDS = 0.5, 1000.0
SURE, DRIFT, SIGNIFICANT = 3.3, 0.25, 0.0


def words_of(text) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % SLOTS for f in dict.fromkeys([word + "$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)])]


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled(docs: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """(toxic, text) of the rows to learn from."""
    y = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text")


def sure_features(counts: DataFrame, features_seen: int, in_toxic: float, in_clean: float) -> DataFrame:
    """(slot, d, z) of the features that count: difference of log-odds of each in toxic and clean texts, and in how many deviations."""
    total = in_toxic + in_clean
    prior = F.lit(PRIOR) + PRIOR_WORDS / max(1.0, total) * (F.col("toxic") + F.col("clean"))
    all_prior = PRIOR * features_seen + PRIOR_WORDS * total / max(1.0, total)
    x, y = F.col("toxic") + prior, F.col("clean") + prior
    d = F.log(x / (in_toxic + all_prior - x)) - F.log(y / (in_clean + all_prior - y))
    return counts.select("slot", d.alias("d"), (d / F.sqrt(1 / x + 1 / y)).alias("z")).where(F.abs("z") >= SURE)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), by Ruzzo and Tompa's linear scan."""
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    for i in np.nonzero(scores > 0)[0].tolist():
        l, r, start = upto[i], upto[i + 1], i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= l:
                j -= 1
            if j < 0 or found[j][1] >= r:
                found.append((l, r, start, i + 1))
                break
            l, start = found[j][0], found[j][2]
            del found[j:]
    return [(r - l, s, e) for l, r, s, e in found]


class WordScores(dict):
    def __init__(self, sure: dict[int, tuple[float, float]]):
        super().__init__()
        self.sure = sure

    def __missing__(self, word):
        found = [self.sure[f] for f in features(word) if f in self.sure]
        s = max(found, key=lambda x: abs(x[1]))[0] - DRIFT if found else -DRIFT
        if len(word) <= 64:
            self[word] = s
        return s

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), float, len(words))


class Model:
    """What scoring needs: the sure features, at most SLOTS, {slot: (log-odds, deviations)}, and five more numbers, whatever the corpus."""

    def __init__(self, sure=None, lam=1.0, log_k=0.0, a=0.0, b=0.0, constant=None):
        self.sure, self.lam, self.log_k, self.a, self.b, self.constant = sure, lam, log_k, a, b, constant

    def plain(self) -> tuple:
        return self.sure, self.lam, self.log_k, self.a, self.b, self.constant

    def passages(self, scores: np.ndarray) -> list[tuple[float, int, int]]:
        """The significant segments: (how far each stands out, start, end)."""
        base = self.log_k + math.log(max(1, len(scores)))
        found = [(self.lam * s - base, i, j) for s, i, j in segments(scores)]
        return [x for x in found if x[0] > SIGNIFICANT]

    def evidence(self, scores: np.ndarray) -> float:
        return math.log1p(sum(x for x, _, _ in self.passages(scores)))

    def probability(self, x: float) -> float:
        return self.constant if self.constant is not None else 1 / (1 + math.exp(-max(-700.0, min(700.0, self.a + self.b * x))))


def _root(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1; the scores' mean is below 0."""
    if not (values > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((weights * np.exp(np.minimum(x * values, 500))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Newton's method with a weak ridge, for n cases of each (x, y); targets are smoothed as Platt's are."""
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w, m = np.zeros(2), np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -500, 500)))
        h = m.T @ (m * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, m.T @ (n * (t - p)) - 1e-3 * w), -5, 5)
    return float(w[0]), float(w[1])


def feature_counts(taught: DataFrame) -> DataFrame:
    """(slot, clean, toxic): how often each feature stands in either class; slot -1 has the rows of each."""

    def count(state, cols):
        for y, t in zip(cols["toxic"], cols["text"]):
            state[y].update(words_of(t))
            state[2][y] += 1

    def counted(state):
        sums = np.zeros((SLOTS, 2))
        for y in (0, 1):
            for w, n in state[y].items():
                sums[features(w), y] += n
        at = np.nonzero(sums.any(axis=1))[0]
        return {"slot": [-1, *at.tolist()], "clean": [state[2][0], *sums[at, 0].tolist()], "toxic": [state[2][1], *sums[at, 1].tolist()]}

    got = arrow_map(taught, count, "slot int, clean double, toxic double", setup=lambda: (Counter(), Counter(), [0, 0]), finish=counted)
    return got.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def segment_sums(taught: DataFrame, shared) -> DataFrame:
    """(toxic, n, s) of every row, its words and its segments' sums; and (v, c), how often each word's score, in hundredths, stands in clean texts."""

    def sums(state, cols):
        scores, hundredths = state
        out = {"toxic": [], "n": [], "s": []}
        for y, t in zip(cols["toxic"], cols["text"]):
            s = scores.of(words_of(t))
            if not y:
                hundredths.update(np.round(s * 100).astype(int).tolist())
            out["toxic"].append(y)
            out["n"].append(len(s))
            out["s"].append([x for x, _, _ in segments(s)])
        return out | {"v": [None] * len(out["n"]), "c": [None] * len(out["n"])}

    def spread(state):
        v = list(state[1])
        none = [None] * len(v)
        return {"toxic": none, "n": none, "s": none, "v": v, "c": [state[1][x] for x in v]}

    return arrow_map(taught, sums, "toxic int, n long, s array<double>, v int, c long", setup=lambda: (WordScores(shared.value), Counter()), finish=spread)


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000) -> Model:
    """The driver gets sums, the sure features and histograms; what grows with texts stays on executors and in the shared folder."""
    spark = docs.sparkSession
    taught = labelled(docs, labels, most_labels)
    counts = stored(feature_counts(taught), "features")
    n = counts.agg(*[F.coalesce(F.sum(F.when(F.col("slot") < 0, F.col(c))), F.lit(0.0)).alias(c) for c in ("clean", "toxic")], *[F.coalesce(F.sum(F.when(F.col("slot") >= 0, F.col(c))), F.lit(0.0)).alias(f"of_{c}") for c in ("clean", "toxic")], F.count_if(F.col("slot") >= 0).alias("seen")).first()
    if not n.clean or not n.toxic:
        unstore(spark, counts)
        return Model(constant=n.toxic / max(1.0, n.clean + n.toxic))
    found = sure_features(counts.where("slot >= 0"), n.seen, n.of_toxic, n.of_clean).toPandas()
    sure = dict(zip(found.slot.tolist(), zip(found.d.tolist(), found.z.tolist())))
    shared = spark.sparkContext.broadcast(sure)
    seen = stored(segment_sums(taught, shared), "segments")
    hist = seen.where("v is not null").groupBy("v").agg(F.sum("c").alias("c")).toPandas()
    lam = _root(hist.v.to_numpy() / 100, hist.c.to_numpy() / hist.c.sum()) if len(hist) else 1.0
    size = F.log(F.greatest(F.lit(1), F.col("n")).cast("double"))
    rows = seen.where("v is null")
    log_k = float(rows.where("toxic = 0").agg(F.avg(lam * F.coalesce(F.array_max("s"), F.lit(0.0)) - size)).first()[0] - 0.5772)
    out = F.aggregate("s", F.lit(0.0), lambda total, v: total + F.greatest(F.lit(0.0), lam * v - log_k - size))
    x = rows.groupBy(F.col("toxic").alias("y"), F.round(F.log1p(out), 4).alias("x")).agg(F.count("*").alias("n")).toPandas()
    a, b = _logistic(x.x.to_numpy(), x.y.to_numpy().astype(float), x.n.to_numpy().astype(float))
    shared.unpersist()
    unstore(spark, counts, seen)
    return Model(sure, lam, log_k, a, b)


def score(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row, and the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    kinds = dict(docs.dtypes)

    def setup():
        m = Model(*shared.value)
        return m, WordScores(m.sure)

    def fn(state, cols):
        (m, words), out, n = state, [], []
        for t in cols.pop("_t"):
            if m.constant is not None:
                x = []
            else:
                x = [p for p, _, _ in m.passages(words.of(words_of(t)))]
            n.append(len(x))
            out.append(m.probability(math.log1p(sum(x))))
        return cols | {"score": out, "predicted": [int(p >= 0.5) for p in out], "n_passages": n}

    rows = docs.select("doc_id", *keep, held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_t"))
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep))
    return arrow_map(rows, fn, f"{fields}, held_out boolean, score double, predicted int, n_passages int", setup=setup)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
