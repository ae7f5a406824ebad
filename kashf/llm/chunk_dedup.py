"""Substring dedup by content-defined chunks.

A gear hash (h = 2 * h + gear[byte], modulo 2**64) rolls over the bytes of a
text; after the byte at which its ``MASK_BITS`` highest bits are 0 a chunk ends. The hash
depends on the last 64 bytes only, so the cuts inside a passage that stands in
two texts agree after its first 64 bytes, whatever stands before it.
No least length is kept, since it would carry a difference on from cut to cut;
chunks of over ``LONGEST`` bytes are cut at multiples of it.

Chunks are told apart by the first 128 bits of their SHA-256. A chunk is a repeat if it stands
earlier (smaller doc_id, or earlier in the same text). A text all of whose chunks are repeats goes
whole. Of other texts those repeats go that stand in a match of ``LEAST`` bytes or more, so that common short phrases
stay: in a run of repeats of that length, or, where the run is shorter, in a string of ``LEAST`` bytes that
stands around an earlier copy of the chunk too, byte for byte. What a match has
outside its whole chunks is counted but stays. All is judged on the input, not on what is left.
This is ``around=True``, the rule of the query; without it only runs of repeats of ``LEAST`` bytes or more go,
and the first question is the only one.

Each block of documents (a range of doc_id) puts three questions to buckets (see blocks.py):

1. Of each of its digests: does an earlier block have it, and any other at all? A chunk that a third of all
   texts hold is one entry a block.
2. A match of ``LEAST`` bytes around a chunk has half of what the chunk lacks on its left or on its
   right. Of each chunk that recurs, by the hash of either side: does it recur, and is it in a short run anywhere?
3. Of what is left, by the hash of the side: the bytes that the strings of ``LEAST`` bytes around chunk and side
   take up, once a block. The bucket compares all these strings, with the chunk's place in them, by 128 bits of two polynomial hashes.

A side with more than ``HOT`` different surroundings, which one bucket could not hold, is asked for string by string instead, by the
string's hash: no bucket grows with a passage that a third of all texts hold.

Nulls are empty texts, without chunks. Rows with a null doc_id come first; repeated rows and rows that
share a doc_id follow each other by text, and a later copy is a repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import answered, answers_of, asked, deal, partitions, rows_of
from .common import table, text_bytes
from .suffix_dedup import SOME, _hasher, mixed

MASK_BITS, LONGEST, LEAST = 5, 256, 120
HOT = 20_000
TOGETHER = 4096  # surroundings that are compared at once, or one side's


def gear_table() -> np.ndarray:
    """256 numbers of 64 bits that never change."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:8], "little") for i in range(256)], np.uint64)


def chunk_ends(data: bytes, gear: np.ndarray) -> np.ndarray:
    """Ends of the chunks, the last one being len(data)."""
    if not data:
        return np.zeros(0, np.int64)
    # h[i] is the sum of gear[b[i - k]] << k for k below 64, by doubling the span
    h = gear[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 64 and span < len(h):
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    ends = np.nonzero(h >> np.uint64(64 - MASK_BITS) == 0)[0] + 1
    ends = np.append(ends[ends < len(data)], len(data))
    gaps = np.diff(ends, prepend=0)
    if (long := gaps > LONGEST).any():
        more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[long], gaps[long])]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunks(data: bytes, gear: np.ndarray) -> tuple[list[int], list[bytes]]:
    ends = chunk_ends(data, gear).tolist()
    return ends, [hashlib.sha256(data[a:b]).digest()[:16] for a, b in zip([0, *ends], ends)]


def cut_out(data: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def pairs(digests) -> np.ndarray:
    """Digests of 16 bytes as rows of two numbers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, the earliest first, and where a new key begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def by_bucket(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """Places by bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.nonzero(np.diff(bucket[order], prepend=-1))[0]
    return {int(bucket[order[c]]): order[c:e] for c, e in zip(cuts, [*cuts[1:], len(order)])}


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int64)


def window_keys(data: list[bytes], place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of LEAST bytes in each of ``data``: its number and two hashes of the string, the chunk's place in it and the chunk's size."""
    parts, at = [], 0
    while at < len(data):
        end, room = at, SOME
        while end < len(data) and (end == at or len(data[end]) <= room):
            room -= len(data[end])
            end += 1
        lens = np.array([len(x) for x in data[at:end]])
        counts = lens - LEAST + 1
        i = np.repeat(np.arange(end - at), counts)
        w = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        p = np.repeat(np.cumsum(lens) - lens, counts) + w
        hasher = _hasher()
        sums = hasher.sums(np.frombuffer(b"".join(data[at:end]), np.uint8))
        where = ((place[at:end][i] - w) * 256 + size[at:end][i]).astype(np.uint64)
        parts.append((i + at, *(mixed(hasher.of(sums, p, p + LEAST, k) + where) for k in (0, 1))))
        at = end
    return tuple(np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.int64, np.uint64, np.uint64), zip(*parts) if parts else [()] * 3))


class Block:
    """The chunks of a block's texts, in their order, and what the answers tell of them."""

    def __init__(self, texts, gear: np.ndarray, buckets: int):
        self.texts, self.buckets = [text_bytes(t) for t in texts], buckets
        found = [chunks(data, gear) for data in self.texts]
        self.n_chunks = np.array([len(ends) for ends, _ in found], np.int64)
        self.text = np.repeat(np.arange(len(found)), self.n_chunks)
        self.end = np.array([e for ends, _ in found for e in ends], np.int64)
        self.start = np.concatenate([np.zeros(1, np.int64), self.end[:-1]])[: len(self.end)]
        self.start[(np.cumsum(self.n_chunks) - self.n_chunks)[self.n_chunks > 0]] = 0
        digests = pairs([d for _, ds in found for d in ds])
        order, new = groups(digests[:, 0], digests[:, 1])
        self.later = np.zeros(len(order), bool)
        self.later[order] = ~new
        self.kind = np.zeros(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.kind)
        self.digests = digests[order[new]]
        self.by_bucket = by_bucket(bucket_of(self.digests[:, 0], buckets))

    def judge(self, answers: dict, whole: bool) -> None:
        """repeat and gone: whether a chunk stands earlier, and goes without a look at what is around it; open_: whether it is a shorter one that recurs; sought: and in a short run."""
        known, recurs = np.zeros(len(self.digests), bool), self.counts > 1
        for bucket, (earlier, shared) in answers.items():
            at = self.by_bucket[bucket]
            known[at] = np.unpackbits(earlier, count=len(at))
            recurs[at] |= np.unpackbits(shared, count=len(at)).astype(bool)
        self.repeat = known[self.kind] | self.later
        size = self.end - self.start
        new = np.ones(len(size), bool)
        new[1:] = (self.repeat[1:] != self.repeat[:-1]) | (self.text[1:] != self.text[:-1])
        run = np.cumsum(new) - 1
        long = np.bincount(run, size)[run] >= LEAST
        self.repeats = np.bincount(self.text[self.repeat], minlength=len(self.texts))
        if whole:
            long |= (self.repeats == self.n_chunks)[self.text]
        self.gone = self.repeat & long
        self.open_ = (size < LEAST) & recurs[self.kind]
        self.sought = self.open_ & self.repeat & ~self.gone

    def surroundings(self) -> None:
        """Of each side of open chunks, in the order of the chunks: the chunk, the side's hash, start and end of all strings of LEAST bytes
        around both, in the text, and two hashes of these bytes with the chunk's place; later: the same stand earlier in the block."""
        parts, sizes, at = [], [len(t) for t in self.texts], 0
        while at < len(sizes):
            end, room = at, SOME
            while end < len(sizes) and (end == at or sizes[end] <= room):
                room -= sizes[end]
                end += 1
            x, y = np.searchsorted(self.text, (at, end))
            if len(c := np.nonzero(self.open_[x:y])[0] + x):
                hasher, lens = _hasher(), np.array(sizes[at:end])
                sums = hasher.sums(np.frombuffer(b"".join(self.texts[at:end]), np.uint8))
                first = (np.cumsum(lens) - lens)[self.text[c] - at]
                last, a, b = first + lens[self.text[c] - at], self.start[c] + first, self.end[c] + first
                half = (LEAST - (b - a) + 1) // 2
                # a string around the left side starts at a - half at the latest, one around the right side alone after that
                for k, (s, e, lo, hi) in enumerate(((a - half, b, b - LEAST, a - half + LEAST), (a, b + half, a - half + 1, a + LEAST))):
                    lo, hi = np.maximum(lo, first), np.minimum(hi, last)
                    some = np.nonzero((s >= first) & (e <= last) & (hi - lo >= LEAST))[0]
                    ci, s, e, lo, hi, at0 = c[some], s[some], e[some], lo[some], hi[some], first[some]
                    long, place = (b - a)[some], a[some] - lo
                    side = mixed(hasher.of(sums, s, e, 0) + (2 * long + k).astype(np.uint64))
                    where = ((hi - lo) * 65536 + place * 256 + long).astype(np.uint64)
                    parts.append((ci, lo - at0, hi - at0, side, *(mixed(hasher.of(sums, lo, hi, w) + where) for w in (0, 1))))
            at = end
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)
        got = [np.concatenate([np.zeros(0, k), *x]) for k, x in zip(kinds, zip(*parts) if parts else [()] * 6)]
        by = np.argsort(got[0], kind="stable")
        self.at, self.lo, self.hi, self.side, one, two = (x[by] for x in got)
        self.order, self.new = groups(self.side, one, two)
        self.known = np.zeros(len(by), bool)
        self.known[self.order] = ~self.new

    def ask_sides(self) -> dict[int, tuple]:
        """Distinct sides by bucket: their hashes, numbers of different surroundings, and whether any is sought."""
        self.surroundings()
        s = self.side[self.order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        kind = np.cumsum(new) - 1
        self.side_kind = np.zeros(len(s), np.int64)
        self.side_kind[self.order] = kind
        sides, n = s[new], np.bincount(kind, self.new).astype(np.int32)
        sought = np.bincount(kind, self.sought[self.at[self.order]]) > 0
        self.sides_by = by_bucket(bucket_of(sides, self.buckets))
        return {k: (sides[i], n[i], np.packbits(sought[i])) for k, i in self.sides_by.items()}

    def ask_windows(self, answers: dict) -> dict[int, tuple]:
        """By bucket: surroundings (side, bytes, chunk's place and size, chunk, is it sought), strings (two hashes, chunk, is it sought), and chunks that go for sure."""
        self.ask_sides()
        state = np.zeros(int(self.side_kind.max(initial=-1)) + 1, np.int8)
        for bucket, got in answers.items():
            state[self.sides_by[bucket]] = got
        state, wanted = state[self.side_kind], self.sought[self.at]
        sure = np.unique(self.at[self.known & wanted])

        def taken(i):
            c = self.at[i]
            return [self.texts[t][x:y] for t, x, y in zip(self.text[c].tolist(), self.lo[i].tolist(), self.hi[i].tolist())], self.start[c] - self.lo[i], self.end[c] - self.start[c]

        few = np.nonzero(~self.known & (state == 1))[0]
        found = {k: [(self.side[few[i]], *taken(few[i]), self.at[few[i]].astype(np.int32), wanted[few[i]]), None, None] for k, i in by_bucket(bucket_of(self.side[few], self.buckets)).items()}
        many = np.nonzero(~self.known & (state == 2))[0]
        of, one, two = window_keys(*taken(many))
        order, new = groups(one, two)
        sure = np.union1d(sure, self.at[many[of[order[~new]]]][wanted[many[of[order[~new]]]]])
        first = np.sort(order[new])
        for k, i in by_bucket(bucket_of(one[first], self.buckets)).items():
            i = first[i]
            found.setdefault(k, [None] * 3)[1] = one[i], two[i], self.at[many[of[i]]].astype(np.int32), wanted[many[of[i]]]
        for k, i in by_bucket(sure % self.buckets).items():
            found.setdefault(k, [None] * 3)[2] = sure[i].astype(np.int32)
        return {k: tuple(x) for k, x in found.items()}

    def settle(self, answers: dict) -> None:
        """Marks as gone the chunks in short runs of which a string of LEAST bytes stands earlier."""
        for got in answers.values():
            self.gone[got] = True

    def spans(self) -> list[list[tuple[int, int]]]:
        """By text, the bytes (start, end) that go."""
        c = np.nonzero(self.gone)[0]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1] + 1) | (self.text[c[1:]] != self.text[c[:-1]])
        out: list[list] = [[] for _ in self.texts]
        for t, a, b in zip(self.text[c[new]].tolist(), self.start[c[new]].tolist(), self.end[c[np.append(new[1:], True)[: len(c)]]].tolist()):
            out[t].append((a, b))
        return out


def answer_chunks(packets: list[np.ndarray]) -> list:
    """Packets are distinct digests: which are in an earlier block, and which in any other?"""
    keys = np.concatenate(packets)
    order, new = groups(keys[:, 0], keys[:, 1])
    kind = np.cumsum(new) - 1
    earlier, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order], shared[order] = ~new, (np.bincount(kind) > 1)[kind]
    cuts = np.cumsum([len(p) for p in packets])[:-1]
    return [(np.packbits(e), np.packbits(s)) for e, s in zip(np.split(earlier, cuts), np.split(shared, cuts))]


def answer_sides(packets: list[tuple], hot: int) -> list[np.ndarray]:
    """0: a side has one surrounding or is not sought; 1: those of its surroundings are compared; 2: they are too many for a bucket."""
    side, n = (np.concatenate([p[c] for p in packets]) for c in (0, 1))
    sought = np.concatenate([np.unpackbits(p[2], count=len(p[0])) for p in packets])
    order, new = groups(side)
    kind = np.cumsum(new) - 1
    total, any_ = np.bincount(kind, n[order]), np.bincount(kind, sought[order]) > 0
    out = np.zeros(len(side), np.int8)
    out[order] = np.where(any_ & (total > 1), np.where(total > hot, 2, 1), 0)[kind]
    return np.split(out, np.cumsum([len(p[0]) for p in packets])[:-1])


def stand_earlier(of: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The numbers in ``of``, which ascend, that share a pair of hashes with a smaller one."""
    order, new = groups(one, two)
    return np.unique(of[order[~new]])


def answer_windows(packets: list[tuple]) -> list[np.ndarray]:
    """The chunks of each packet that go."""
    out = [[] if sure is None else [sure] for _, _, sure in packets]

    def tell(parts, goes):
        for (k, (*_, at, wanted)), g in zip(parts, np.split(goes, np.cumsum([len(x[-1]) for _, x in parts])[:-1])):
            out[k].append(at[g & wanted])

    if few := [(k, p[0]) for k, p in enumerate(packets) if p[0] is not None]:
        side, place, size = (np.concatenate([x[c] for _, x in few]) for c in (0, 2, 3))
        data = [d for _, x in few for d in x[1]]
        order, new = groups(side)
        firsts, goes, at = [*np.nonzero(new)[0].tolist(), len(side)], np.zeros(len(side), bool), 0
        for a, b in zip(firsts, firsts[1:]):  # sides are compared some at a time
            if b - at >= TOGETHER or b == len(side):
                i = np.sort(order[at:b])
                of, one, two = window_keys([data[x] for x in i.tolist()], place[i], size[i])
                goes[i[stand_earlier(of, one, two)]] = True
                at = b
        tell(few, goes)
    if many := [(k, p[1]) for k, p in enumerate(packets) if p[1] is not None]:
        one, two = (np.concatenate([x[c] for _, x in many]) for c in (0, 1))
        goes = np.zeros(len(one), bool)
        goes[stand_earlier(np.arange(len(one)), one, two)] = True
        tell(many, goes)
    return [np.unique(np.concatenate([np.zeros(0, np.int32), *x])) for x in out]


def chunk_dedup(docs: DataFrame, block_docs: int = 2048, with_text: bool = False, around: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeats, n_removed, n_spans, kept_sha256 of every row, and kept_text if asked for."""
    dealt, blocks = deal(docs, block_docs, True)
    parts = partitions(docs)
    gear = gear_table()

    def block_of(group):
        rows = rows_of(group, True)
        return rows, Block((t for _, t in rows), gear, blocks)

    def nth(answers, k):
        """The answers to the kth question: bucket b of it has the number k * blocks + b."""
        return {b - k * blocks: x for b, x in answers.items() if b // blocks == k}

    def ask_chunks(group):
        _, block = block_of(group)
        return {b: block.digests[i] for b, i in block.by_bucket.items()}

    def ask_sides(group, answers):
        _, block = block_of(group)
        block.judge(answers, True)
        return block.ask_sides()

    def ask_windows(group, answers):
        _, block = block_of(group)
        block.judge(nth(answers, 0), True)
        return block.ask_windows(nth(answers, 1))

    key_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def put(left, right):
        rows, block = block_of(left)
        answers = answers_of(right)
        block.judge(nth(answers, 0), around)
        if around:
            block.settle(nth(answers, 1))
        out = []
        for (k, _), data, n, repeats, spans in zip(rows, block.texts, block.n_chunks.tolist(), block.repeats.tolist(), block.spans()):
            kept = cut_out(data, spans)
            out.append((k, len(data), n, repeats, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        cols = list(zip(*out)) or [[]] * 8
        names = ["doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        kinds = [key_type, *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, cols, kinds)} if with_text else {n: pa.array(c, kind) for n, c, kind in list(zip(names, cols, kinds))[:7]})

    def replies_to(questions, answer):
        # dealt by block once, for all who read it
        return answered(questions, answer).repartition(parts, "_b")

    def with_next(first, then):
        return first.unionByName(then.withColumn("bucket", F.col("bucket") + blocks))

    replies = first = replies_to(asked(dealt, [], ask_chunks, parts), answer_chunks)
    if around:
        second = replies_to(asked(dealt, [first], ask_sides, parts), lambda packets: answer_sides(packets, hot))
        replies = with_next(first, replies_to(asked(dealt, [with_next(first, second)], ask_windows, parts), answer_windows))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_chunks long, n_repeats long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("_b").cogroup(replies.groupBy("_b")).applyInArrow(put, schema)


def op5_chunk_dedup(spark, sf_dir):
    return chunk_dedup(table(spark, sf_dir, "documents"), around=True)
