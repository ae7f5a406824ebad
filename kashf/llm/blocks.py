"""Documents in blocks, and questions that blocks put to buckets.

A block is a set of documents whose packets (compressed, as they leave the scan) meet
in one task. Blocks ask about keys: each key belongs to a bucket by its hash, and
each block sends a bucket one packet of keys; the bucket, which sees the packets of
all blocks, sends back one answer for each, in the packet's order. Blocks have a
bounded number of documents and buckets a share of all distinct keys of
blocks, so more partitions make both smaller. A key is at most
once in a packet, so a key that a third of all documents hold is one entry a block.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map


def packed(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def unpacked(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def partition_of(label: np.ndarray, parts: int) -> np.ndarray:
    """The partition of ``parts`` to which Spark's hash (Murmur3 of an int, seed 42) sends a label."""
    rotated = lambda x, k: x << np.uint32(k) | x >> np.uint32(32 - k)
    k = rotated(label.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = rotated(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % parts


def even_labels(blocks: int, parts: int) -> np.ndarray:
    """A label for each block, in their order, that deals few blocks evenly over the partitions; many are even as they are."""
    if blocks > 16 * parts:
        return np.arange(blocks, dtype=np.int32)
    found, at = [], 0
    for i in range(blocks):
        while not len(hit := np.nonzero(partition_of(np.arange(at, at + 8 * parts), parts) == i % parts)[0]):
            at += 8 * parts
        at += int(hit[0]) + 1
        found.append(at - 1)
    return np.array(found, np.int32)


def deal(docs: DataFrame, block_docs: int, ordered: bool, key: str = "doc_id", text: str = "text", flush: int = 24_000_000) -> tuple[DataFrame, int]:
    """(_b, data), partitioned by block, and the number of blocks; data are packets of (key, text).

    Blocks are ranges of the key if ``ordered``, the ranges' limits being quantiles of
    the key, within which rows with a null key come first; otherwise they are
    dealt by a hash of key and text. Null texts become empty.
    """
    parts = partitions(docs)
    n = docs.count()
    blocks = max(min(parts, n), -(-n // block_docs), 1)
    cuts = np.zeros(0)
    if ordered and blocks > 1:
        cuts = np.unique(docs.approxQuantile(key, [i / blocks for i in range(1, blocks)], 0.25 / blocks) or [])

    labels = even_labels(blocks, parts)

    def emptied(state):
        rows = [(b, packed(x)) for b, x in state[0].items()]
        state[0], state[1] = {}, 0
        return {"_b": [b for b, _ in rows], "data": [x for _, x in rows]}

    def add(state, cols):
        nth = np.searchsorted(cuts, [-np.inf if k is None else k for k in cols["_k"]], side="right") if ordered else np.array(cols["_h"], np.int64)
        where = labels[nth].tolist()
        for b, k, t in zip(where, cols["_k"], cols["_t"]):
            state[0].setdefault(b, []).append((k, t or ""))
            state[1] += len(t or "") + 16
        return emptied(state) if state[1] > flush else None

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("_h"))
    return arrow_map(rows, add, "_b int, data binary", setup=lambda: [{}, 0], finish=emptied).repartition(parts, "_b"), blocks


def rows_of(group, ordered: bool = False) -> list:
    """The (key, text) of a block; ordered: by key, nulls first, then by text."""
    rows = [x for data in group.column("data").to_pylist() for x in unpacked(data)]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) if ordered else rows


def asked(dealt: DataFrame, answers: list[DataFrame], ask, parts: int) -> DataFrame:
    """``ask(block's table, {earlier answer's place: {bucket: answer}}) -> {bucket: packet}``, dealt by bucket."""

    def send(group, *more):
        b = group.column("_b")[0].as_py()
        got = [{k: unpacked(v) for k, v in zip(m.column("bucket").to_pylist(), m.column("answer").to_pylist())} for m in more]
        found = ask(group, *got)
        return pa.table({"bucket": pa.array(list(found), pa.int32()), "_b": pa.array([b] * len(found), pa.int32()), "packet": pa.array([packed(v) for v in found.values()], pa.binary())})

    schema = "bucket int, _b int, packet binary"
    if answers:
        both = dealt.groupBy("_b").cogroup(answers[0].groupBy("_b")).applyInArrow(lambda a, b: send(a, b) if a.num_rows else pa.table({"bucket": pa.array([], pa.int32()), "_b": pa.array([], pa.int32()), "packet": pa.array([], pa.binary())}), schema)
    else:
        both = dealt.groupBy("_b").applyInArrow(send, schema)
    return both.repartition(parts, "bucket")


def answered(questions: DataFrame, answer) -> DataFrame:
    """``answer([packets in the order of their blocks]) -> [answers]`` for each bucket: (_b, bucket, answer)."""

    def reply(group):
        order = np.argsort(np.array(group.column("_b").to_pylist()), kind="stable")
        b, bucket, packets = (group.column(c).to_pylist() for c in ("_b", "bucket", "packet"))
        got = answer([unpacked(packets[i]) for i in order])
        return pa.table({"_b": pa.array([b[i] for i in order], pa.int32()), "bucket": pa.array([bucket[i] for i in order], pa.int32()), "answer": pa.array([packed(x) for x in got], pa.binary())})

    return questions.groupBy("bucket").applyInArrow(reply, "_b int, bucket int, answer binary")


def answers_of(table) -> dict:
    return {k: unpacked(v) for k, v in zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist())}
