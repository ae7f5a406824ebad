"""TF-IDF of a whole corpus without a row for each posting.

Documents are dealt to blocks by a hash of their key, so that rows of one key meet. A block counts the terms of its
documents and sends each bucket (a range of the terms' 64-bit hashes) one packet: a term once, with the number of the
block's documents that hold it. The bucket answers with the numbers over all blocks, from which the block, which
counts its documents again, has idf, norms and scores. A term of every document is one entry a block, the driver sees
the questions only, and a task holds one block or one bucket.

Terms are told apart by 64-bit hashes (of 10^8 terms some two share one with a probability of 0.03 %); counts that are
results themselves (``term_counts``, ``document_counts``) go by the terms.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sparse

#: Characters for which Python's lower, \w and white space are Java's and no letter is folded. Other texts, and those
#: with a glyph name, are brought to their words or normal form by Spark.
ODD = r"[^\x00-\xff‐-‧‰-⁞€]|uni[0-9A-Fa-f]{3}"
WORD = re.compile(r"\w+")
#: Characters of text that are counted at once, documents of a block, questions that are scored at once.
PORTION, BLOCK_DOCS, QUESTIONS = 1_000_000, {"words": 2_500, "chars": 1_250}, 512
WHOLE = {"int", "bigint"}


def ready(docs: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(_k, _t, _r): texts as they are, or (_r) the words between spaces or the normal form in lower case."""
    norm = T.norm_retrieval(text)
    done = F.concat_ws(" ", T.words(norm)) if kind == "words" else F.lower(norm)
    odd = F.coalesce(F.col(text).rlike(ODD), F.lit(False))
    return docs.select(F.col(key).alias("_k"), F.when(odd, done).otherwise(F.coalesce(text, F.lit(""))).alias("_t"), odd.alias("_r"))


def words_of(text: str, done: bool) -> list[str]:
    return (text.split(" ") if text else []) if done else WORD.findall(text.lower())


def packed(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, 5))


def unpacked(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def planes(x: np.ndarray) -> bytes:
    """Sorted numbers by place of their bytes: the upper bytes repeat and compress."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unplanes(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads over all of them."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens and of each token with the next."""
    h = pd.util.hash_array(np.array(tokens, object), categorize=False) if tokens else np.zeros(0, np.uint64)
    return h, mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def char_hashes(text: str) -> list[np.ndarray]:
    """Hashes of the runs of 2 to 5 characters, by their first place."""
    m = mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    found, h = [], m
    for n in range(2, 6):
        h = h[: max(0, len(m) - n + 1)] * np.uint64(0xD6E8FEB86659FD93) + m[n - 1 :]
        found.append(mixed(h + np.uint64(n)))
    return found


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def portions(docs: list):
    """Some documents (key, [(text, done)]) at a time."""
    some, size = [], 0
    for d in docs:
        some.append(d)
        size += sum(len(t) for t, _ in d[1])
        if size > PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


def features(some: list, kind: str):
    """For each document of a portion the hashes of its terms, with repeats."""
    if kind == "words":
        tokens, ends = [], []
        for _, texts in some:
            for t, done in texts:
                tokens += words_of(t, done)
                ends.append(len(tokens))
        single, double = word_hashes(tokens)
        parts, reach = [single, double], (0, 1)
    else:
        texts = [t if done else " ".join(t.split()).lower() for _, ts in some for t, done in ts]
        ends = np.cumsum([len(t) for t in texts]).tolist()
        parts, reach = char_hashes("".join(texts)), (1, 2, 3, 4)
    nth, a = 0, 0
    for _, texts in some:
        found = []
        for _ in texts:
            b = ends[nth]
            found += [p[a : b - r] for p, r in zip(parts, reach) if b - r > a]
            nth, a = nth + 1, b
        yield np.concatenate(found) if found else np.zeros(0, np.uint64)


def documents(group: pa.Table) -> list:
    """The documents of a block; texts of one key are one document, as they are for null."""
    found: dict = {}
    for data in group.column("data").to_pylist():
        for k, t, r in unpacked(data):
            found.setdefault(k, []).append((t, r))
    # the texts in an order of their own, not of their arrival
    return [(k, sorted(v) if len(v) > 1 else v) for k, v in found.items()]


def vectors_of(docs: list, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(u, c.astype(np.uint32)) for some in portions(docs) for u, c in map(counted, features(some, kind))]


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the number of parts that hold each, some parts at a time."""
    done, step, size = [], [], 0
    for p in [*parts, None]:
        if step and (p is None or size > 4_000_000):
            done.append(counted(np.concatenate(step)))
            step, size = [], 0
        if p is not None:
            step.append(p)
            size += len(p)
    if len(done) <= 1:
        return done[0] if done else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    u, c = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(u)
    u, c = u[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    return u[at], np.add.reduceat(c, at)


def with_zeros(u: np.ndarray, c: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds sorted hashes that count for nothing."""
    new = more[~np.isin(more, u)]
    at = np.searchsorted(u, new)
    return np.insert(u, at, new), np.insert(c, at, 0)


@dataclass
class Dealt:
    """Documents in blocks, and a way to ask in how many of them terms are."""

    blocks: DataFrame
    kind: str
    parts: int
    n: int
    buckets: int


def deal(docs: DataFrame, key: str, text: str, kind: str, flush: int = 16_000_000) -> Dealt:
    parts, n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count()
    blocks = max(min(parts, n), -(-n // BLOCK_DOCS[kind]), 1)
    names = ["_b", "data"]

    def pack(batches):
        state, size = {}, 0
        for b in batches:
            for k, t, r, block in zip(*(b.column(i).to_pylist() for i in range(4))):
                state.setdefault(block, []).append((k, t, r))
                size += len(t) + 16
                if size > flush:
                    yield from emptied(state)
                    state, size = {}, 0
        yield from emptied(state)

    def emptied(state):
        for block, rows in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed(rows)], pa.binary())], names=names)

    rows = ready(docs, key, text, kind).withColumn("_b", F.pmod(F.xxhash64("_k"), F.lit(blocks)).cast("int"))
    return Dealt(rows.mapInArrow(pack, "_b int, data binary").repartition(parts, "_b"), kind, parts, n, max(parts, -(-n // 5_000)))


def cuts_of(u: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted hashes, and their end."""
    return np.append(np.searchsorted(u, np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)), len(u))


def frequencies(d: Dealt, wanted=None, asked=None) -> DataFrame:
    """(_b, bucket, answer): in how many documents the terms of a block's ``wanted`` documents are (all of them, if there
    is no such set) and the ``asked`` hashes, in their order. Both are broadcast."""
    kind, buckets = d.kind, d.buckets

    def send(group: pa.Table) -> pa.Table:
        docs = documents(group)
        found = vectors_of(docs, kind)
        u, c = merged([x for x, _ in found])
        need = None
        if wanted is not None:
            keep = [x for (k, _), (x, _) in zip(docs, found) if k in wanted.value]
            need = with_zeros(*merged(keep), asked.value)[0] if keep else np.zeros(0, np.uint64)
            u, c = with_zeros(u, c, need)
        elif asked is not None:
            u, c = with_zeros(u, c, asked.value)
        at = cuts_of(u, buckets)
        places = [i for i in range(buckets) if at[i + 1] > at[i]]
        packets = [pickle.dumps((planes(u[at[i] : at[i + 1]]), planes(c[at[i] : at[i + 1]].astype(np.uint32))), 5) for i in places]
        needs = [None if need is None else planes(np.isin(u[at[i] : at[i + 1]], need, assume_unique=True)) for i in places]
        block = group.column("_b")[0].as_py()
        return pa.table({"bucket": pa.array(places, pa.int32()), "_b": pa.array([block] * len(places), pa.int32()), "packet": pa.array(packets, pa.binary()), "need": pa.array(needs, pa.binary())})

    def reply(group: pa.Table) -> pa.Table:
        bucket, block, packets, needs = (group.column(x).to_pylist() for x in ("bucket", "_b", "packet", "need"))
        both = [pickle.loads(p) for p in packets]
        us = [unplanes(x, np.uint64) for x, _ in both]
        u, c = np.concatenate(us), np.concatenate([unplanes(x, np.uint32) for _, x in both]).astype(np.int64)
        order = np.argsort(u)
        first = np.concatenate([[True], u[order][1:] != u[order][:-1]])
        df = np.empty(len(u), np.uint32)
        df[order] = np.add.reduceat(c[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        ends = np.cumsum([len(x) for x in us])
        out = []
        for x, end, need in zip(us, ends, needs):
            own = df[end - len(x) : end]
            out.append(planes(own if need is None else own[unplanes(need, np.bool_)]))
        return pa.table({"_b": pa.array(block, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "answer": pa.array(out, pa.binary())})

    sent = d.blocks.groupBy("_b").applyInArrow(send, "bucket int, _b int, packet binary, need binary").repartition(d.parts, "bucket")
    return sent.groupBy("bucket").applyInArrow(reply, "_b int, bucket int, answer binary")


def answered(group: pa.Table) -> np.ndarray:
    got = sorted(zip(group.column("bucket").to_pylist(), group.column("answer").to_pylist()))
    return np.concatenate([unplanes(a, np.uint32) for _, a in got]) if got else np.zeros(0, np.uint32)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + df)) + 1


def rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 1e6) / 1e6


def lengths_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The length of each of the vectors that lie in a row in x."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes))
    if len(x):
        out[sizes > 0] = np.sqrt(np.add.reduceat(x * x, (ends - sizes)[sizes > 0]))
    return out


def word_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(pos, term, w) of words and pairs of words, w rounded to six places; rows without a key have none."""
    d = deal(docs, key, text, "words")
    n, kind = d.n, dict(docs.dtypes)[key]
    schema = pa.schema([("pos", pa.int64()), ("term", pa.string()), ("w", pa.float64())])

    def weigh(group: pa.Table, replies: pa.Table) -> pa.Table:
        found = documents(group) if group.num_rows else []
        table, idf, out = merged([u for u, _ in vectors_of(found, "words")])[0], idf_of(answered(replies), n), []
        for some in portions(found):
            tokens, firsts, counts, ids = [], [], [], []
            for (k, texts), f in zip(some, features(some, "words")):
                places, pairs, sequence = [], [], []
                for t, done in texts:
                    a = len(tokens)
                    tokens += words_of(t, done)
                    b = len(tokens)
                    sequence += [np.arange(a, b), -1 - np.arange(a, b - 1)] if b > a else []
                if not len(f) or k is None:
                    continue
                u, at, c = np.unique(f, return_index=True, return_counts=True)
                x = c * idf[np.searchsorted(table, u)]
                firsts.append(np.concatenate(sequence)[at])
                counts.append(rounded(x / np.sqrt(np.sum(x * x))))
                ids.append(np.full(len(u), k, np.int64))
            if not ids:
                continue
            first, words = np.concatenate(firsts), pa.array(tokens, pa.string())
            one, two = first >= 0, -1 - first[first < 0]
            terms = pa.concat_arrays([words.take(pa.array(first[one])), pa.compute.binary_join_element_wise(words.take(pa.array(two)), words.take(pa.array(two + 1)), " ")])
            order = np.concatenate([np.flatnonzero(one), np.flatnonzero(~one)])
            out.append(pa.table([pa.array(np.concatenate(ids)[order]), terms, pa.array(np.concatenate(counts)[order])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    both = d.blocks.groupBy("_b").cogroup(frequencies(d).groupBy("_b"))
    return both.applyInArrow(weigh, "pos long, term string, w double").select(F.col("pos").cast(kind), "term", "w")


@dataclass
class Asked:
    """Questions as entries (term, question, count), sorted by term; ``terms`` are the distinct hashes."""

    ids: np.ndarray
    terms: np.ndarray
    term: np.ndarray
    question: np.ndarray
    count: np.ndarray


def asked_of(rows: list, kind: str) -> Asked:
    found: dict = {}
    for k, t, r in rows:
        if k is not None:
            found.setdefault(k, []).append((t, r))
    docs = list(found.items())
    vectors = vectors_of(docs, kind)
    u = np.concatenate([u for u, _ in vectors] or [np.zeros(0, np.uint64)])
    terms, term = np.unique(u, return_inverse=True)
    question = np.repeat(np.arange(len(docs)), [len(u) for u, _ in vectors])
    count = np.concatenate([c for _, c in vectors] or [np.zeros(0)]).astype(float)
    order = np.argsort(term, kind="stable")
    return Asked(np.array([k for k, _ in docs], np.int64), terms, term[order], question[order], count[order])


def products(doc: np.ndarray, col: np.ndarray, x: np.ndarray, n_docs: int, term: np.ndarray, question: np.ndarray, w: np.ndarray, n_terms: int, n_questions: int) -> np.ndarray:
    """Scores (document, question) of entries (doc, col, x), sorted by document, with the questions' entries, sorted by term.
    Terms of many questions are multiplied as a matrix, others entry by entry."""
    begins = np.searchsorted(term, np.arange(n_terms + 1))
    holds = np.diff(begins)
    often = np.flatnonzero(holds > max(4, n_questions // 16))
    place = np.full(n_terms, -1)
    place[often] = np.arange(len(often))
    m = np.zeros((len(often), n_questions))
    many = place[term] >= 0
    m[place[term[many]], question[many]] = w[many]
    out = np.zeros((n_docs, n_questions))
    for a in range(0, n_docs, 64):
        lo, hi = np.searchsorted(doc, [a, min(a + 64, n_docs)])
        rows = min(64, n_docs - a)
        d, c, v = doc[lo:hi] - a, col[lo:hi], x[lo:hi]
        big = place[c] >= 0
        if len(often):
            dense = np.zeros((rows, len(often)))
            dense[d[big], place[c[big]]] = v[big]
            out[a : a + rows] = dense @ m
        d, c, v = d[~big], c[~big], v[~big]
        k = holds[c]
        at = np.repeat(begins[c] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        out[a : a + rows] += np.bincount(np.repeat(d, k) * n_questions + question[at], np.repeat(v, k) * w[at], rows * n_questions).reshape(rows, n_questions)
    return out


def best_in(scores: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each column's k best scores above 0; equal ones go to the smaller pos."""
    real = scores > 0
    near = rounded(scores)
    if len(pos) > k:
        limit = np.partition(np.where(real, near, -1), len(pos) - k, axis=0)[len(pos) - k]
        real &= near >= limit
    row, column = np.nonzero(real)
    order = np.lexsort((pos[row], -near[row, column], column))
    row, column = row[order], column[order]
    kept = np.arange(len(column)) - np.searchsorted(column, column) < k
    return row[kept], column[kept]


def cosines(docs: DataFrame, questions: DataFrame, kind: str, k: int | None = None, pairs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(qid, pos, score), rounded to six places, of questions (qid, q): the ``k`` best of each block for each question,
    or the given ``pairs`` (qid, pos) that share a term. Ties within a block go to the smaller pos.

    None where keys are no whole numbers or questions too many to be broadcast.
    """
    from .dense import BROADCAST_QUESTIONS

    kinds = dict(questions.dtypes)["qid"], dict(docs.dtypes)[key]
    if not {*kinds} <= WHOLE:
        return None
    rows = ready(questions, "qid", "q", kind).limit(BROADCAST_QUESTIONS + 1).collect()
    if len(rows) > BROADCAST_QUESTIONS:
        return None
    sc = docs.sparkSession.sparkContext
    ask = asked_of(rows, kind)
    chosen = None
    if pairs is not None:
        nth: dict = {}
        of = {q: i for i, q in enumerate(ask.ids.tolist())}
        for q, p in pairs.select("qid", "pos").distinct().collect():  # a bounded number for each question
            if q in of and p is not None:
                nth.setdefault(p, []).append(of[q])
        chosen = sc.broadcast(nth)
    shared, terms, d = sc.broadcast(ask), sc.broadcast(ask.terms), deal(docs, key, text, kind)
    n = d.n
    schema = pa.schema([("qid", pa.int64()), ("pos", pa.int64()), ("score", pa.float64())])

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        ask = shared.value
        found = documents(group) if group.num_rows else []
        if chosen is not None:
            found = [x for x in found if x[0] in chosen.value]
        if not found or not len(ask.terms):
            return schema.empty_table()
        vectors = vectors_of(found, kind)
        table = with_zeros(*merged([u for u, _ in vectors]), ask.terms)[0]
        df = answered(replies)
        idf = idf_of(df, n)
        own = np.searchsorted(table, ask.terms)
        column = np.full(len(table), -1, np.int32)
        column[own] = np.where(df[own] > 0, np.arange(len(own)), -1)
        w = ask.count * np.where(df[own] > 0, idf[own], 0.0)[ask.term]
        length = np.sqrt(np.bincount(ask.question, w * w, len(ask.ids)))
        w = w / np.maximum(length[ask.question], 1e-300)
        doc, col, val, norms = [], [], [], []
        for i, (u, c) in enumerate(vectors):
            at = np.searchsorted(table, u)
            x = c * idf[at]
            norms.append(np.sqrt(np.sum(x * x)) if len(x) else 1.0)
            of = column[at]
            hit = of >= 0
            col.append(of[hit])
            val.append(x[hit] / norms[-1])
            doc.append(np.full(int(hit.sum()), i))
        doc, col, val = np.concatenate(doc), np.concatenate(col), np.concatenate(val)
        pos = np.array([np.iinfo(np.int64).min if p is None else p for p, _ in found], np.int64)
        null = np.array([p is None for p, _ in found])
        out = []
        for a in range(0, len(ask.ids), QUESTIONS):
            some = (ask.question >= a) & (ask.question < a + QUESTIONS)
            s = products(doc, col, val, len(found), ask.term[some], ask.question[some] - a, w[some], len(ask.terms), min(QUESTIONS, len(ask.ids) - a))
            s[null] = 0  # as the join on pos has it
            if chosen is None:
                row, q = best_in(s, pos, k)
            else:
                both = [(i, j - a) for i, (p, _) in enumerate(found) for j in chosen.value[p] if a <= j < a + s.shape[1] and s[i, j - a] > 0]
                row, q = np.array(both, int).reshape(-1, 2).T
            out.append(pa.table([pa.array(ask.ids[q + a]), pa.array(pos[row]), pa.array(rounded(s[row, q]))], schema=schema))
        return pa.concat_tables(out)

    both = d.blocks.groupBy("_b").cogroup(frequencies(d, chosen, terms).groupBy("_b"))
    scores = both.applyInArrow(score, "qid long, pos long, score double")
    return scores.select(F.col("qid").cast(kinds[0]), F.col("pos").cast(kinds[1]), "score")


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether a key has several rows."""
    return bool(docs.groupBy(key).count().where("count > 1").limit(1).count())


def _tallies(batches, whole: bool):
    """Of the words of each portion: (key, term, tf), or (term, df)."""
    for b in batches:
        rows = list(zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
        for some in portions([(k, [t]) for k, t in rows]):
            lists = [words_of(*t) for _, (t,) in some]
            terms = pa.array([w for ws in lists for w in ws], pa.string()).dictionary_encode()
            size = max(1, len(terms.dictionary))
            at, tf = counted(np.repeat(np.arange(len(some)), [len(ws) for ws in lists]) * size + terms.indices.to_numpy(zero_copy_only=False))
            if whole:
                keys = pa.array([k for k, _ in some], b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at // size)), terms.dictionary.take(pa.array(at % size)), pa.array(tf.astype(np.int64))], names=["_k", "term", "tf"])
            else:
                yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(np.bincount(at % size, minlength=len(terms.dictionary)).astype(np.int64))], names=["term", "df"])


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf) of words, counted where the text is read; where keys repeat, by a shuffle of the words."""
    if repeated(docs, key):
        return sparse.term_counts(docs.select(key, T.norm_retrieval(text).alias("norm")), key, T.words(F.col("norm")))
    found = ready(docs, key, text, "words").mapInArrow(lambda batches: _tallies(batches, True), f"_k {dict(docs.dtypes)[key]}, term string, tf long")
    return found.withColumnRenamed("_k", key)


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df) of words; tasks send their sums."""
    if repeated(docs, key):
        return term_counts(docs, key, text).groupBy("term").agg(F.count("*").alias("df"))
    found = ready(docs, key, text, "words").mapInArrow(lambda batches: _tallies(batches, False), "term string, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))
