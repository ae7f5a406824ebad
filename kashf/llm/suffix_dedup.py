"""Suffix-array dedup: every byte under a ``WINDOW``-byte string that also starts earlier goes.

A window's anchor is the place, among its strings of ``K`` bytes, whose hash is least; it depends on the
window's bytes only, so equal windows have equal anchors at equal places. Neighbouring windows that
share their anchor form a stretch, of about 140 bytes; there is one for every 39 bytes or so. Texts are cut into stretches, and two
questions (see blocks.py) settle each, with blocks being ranges of doc_id:

1. By the hash of the anchor, with a digest of the stretch. Is the same stretch in an earlier
   place? Then all its windows are repeats. Has any other stretch the same anchor? If none, no window
   of it is a repeat.
2. What is left, the rims of passages, goes as bytes to the bucket of its anchor. There a
   logarithmic family of suffix arrays takes in one batch after another, in the order of the documents: a batch's suffixes are sorted to the
   depth of a window, scanned against the levels by merging, and stored as a level of their own; levels of one size are merged, so
   there are log(n) of them. Matches are compared byte by byte.

Anchors in over ``HOT`` stretches, which one bucket could not hold, are asked for window by window instead, by the window's
digest: no bucket grows with a passage that a third of all texts hold.

The digest of a stretch is 128 bits of two polynomial hashes. Null texts are empty; texts of under ``WINDOW`` bytes keep all. Rows with
a null doc_id come first; rows that share a doc_id follow each other by text, so of repeated rows the first
stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import answered, answers_of, asked, deal, partitions, rows_of
from .common import give_back, table, text_bytes, worker_state

WINDOW, K = 100, 24
HOT = 20_000
SPAN = WINDOW - K + 1
SOME = 1 << 18  # bytes that are hashed at once; their sums and places take some hundred times as much


class SuffixLevels:
    """Sorted arrays of distinct suffixes, cut at ``width`` bytes; their sizes at least double from one to the next."""

    def __init__(self, width: int = WINDOW):
        self.kind, self.levels = np.dtype(f"S{width}"), []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the batch stand in an earlier batch or earlier in this one; then they belong to the family."""
        order = np.argsort(suffixes, kind="stable")
        s = suffixes[order]
        old = np.zeros(len(s), bool)
        old[1:] = s[1:] == s[:-1]
        for level in self.levels:
            at = np.searchsorted(level, s)
            at[at == len(level)] = 0
            old |= level[at] == s
        new = s[~old]
        while self.levels and len(new) and len(self.levels[-1]) < 2 * len(new):
            new = np.sort(np.concatenate([self.levels.pop(), new]), kind="stable")
        if len(new):
            self.levels.append(new)
        out = np.zeros(len(s), bool)
        out[order] = old
        return out


def _constants() -> tuple:
    raw = [np.frombuffer(b"".join(hashlib.sha256(b"%d-%d" % (n, i)).digest()[:8] for i in range(256)), "<u8").astype(np.uint64) for n in (1, 2)]
    base = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
    return [(t, b, pow(b, -1, 1 << 64)) for t, b in zip(raw, base)]


def _powers(b: int, n: int) -> np.ndarray:
    x = np.full(n, b, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


class Hasher:
    """Hashes of any stretch of a buffer from sums over its beginning."""

    def __init__(self):
        self.tables = _constants()
        self.room(SOME + 1)

    def room(self, n: int) -> None:
        self.up = [_powers(b, n) for _, b, _ in self.tables]
        self.down = [_powers(i, n) for _, _, i in self.tables]

    def sums(self, data: np.ndarray) -> list[np.ndarray]:
        if len(data) + 1 > len(self.up[0]):
            self.room(len(data) + 1)
        out = []
        for (t, _, _), up in zip(self.tables, self.up):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(t[data] * up[: len(data)], out=s[1:])
            out.append(s)
        return out

    def of(self, sums: list[np.ndarray], a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
        return (sums[which][b] - sums[which][a]) * self.down[which][a]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of v[p : p + w] for each p, by running minima inside blocks of w."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def stretches(texts: list[bytes], hasher: Hasher):
    """Yields for a few texts at a time: number of the first text, their bytes joined, and by stretch the text's place in
    them, start of the first window, windows, anchor's hash, two digests."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SOME):
            size += len(texts[end])
            end += 1
        some = texts[at:end]
        joined = b"".join(some)
        data = np.frombuffer(joined, np.uint8)
        lens = np.array([len(t) for t in some])
        if (lens >= WINDOW).any():
            sums = hasher.sums(data)
            i = np.arange(len(data) - K + 1)
            grams = mixed(hasher.of(sums, i, i + K, 0))
            places = (grams & np.uint64(0xFFFFFFFF00000000)) | i.astype(np.uint64)
            anchor = (sliding_min(places, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            text = np.repeat(np.arange(len(some)), np.maximum(lens - WINDOW + 1, 0))
            whole = lens >= WINDOW
            p = np.concatenate([np.arange(f, f + n - WINDOW + 1) for f, n in zip(firsts[whole], lens[whole])])
            a = anchor[p]
            new = np.ones(len(p), bool)
            new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
            s = np.nonzero(new)[0]
            windows = np.diff(s, append=len(p))
            start, stop = p[s], p[s] + windows + WINDOW - 1
            d1 = mixed(hasher.of(sums, start, stop, 0) + windows.astype(np.uint64))
            d2 = mixed(hasher.of(sums, start, stop, 1) + (a[s] - start).astype(np.uint64))
            yield at, joined, firsts, text[s], start, windows, grams[a[s]], d1, d2
        at = end


class Block:
    """The distinct stretches of a block, in the order of their first places, by bucket; the same wherever it is worked out."""

    def __init__(self, texts: list[bytes], buckets: int):
        self.texts, parts = texts, []
        for at, _, firsts, text, start, windows, gram, d1, d2 in stretches(texts, _hasher()):
            parts.append((text + at, start - firsts[text], windows, gram, d1, d2))
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)
        self.text, self.start, self.windows, self.gram, self.d1, self.d2 = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip(kinds, zip(*parts) if parts else [()] * 6))
        order = np.lexsort((self.d2, self.d1, self.gram))
        same = np.zeros(len(order), bool)
        same[1:] = (self.gram[order][1:] == self.gram[order][:-1]) & (self.d1[order][1:] == self.d1[order][:-1]) & (self.d2[order][1:] == self.d2[order][:-1])
        self.later = np.zeros(len(order), bool)
        self.later[order] = same  # lexsort is stable: the first of each kind is the earliest
        self.first = np.nonzero(~self.later)[0]
        bucket = (self.gram[self.first] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.nonzero(np.diff(bucket[by], prepend=-1))[0]
        self.by_bucket = {int(bucket[by[c]]): self.first[by[c:e]] for c, e in zip(cuts, [*cuts[1:], len(by)])}

    def bytes_of(self, i: int) -> bytes:
        s = self.start[i]
        return self.texts[self.text[i]][s : s + self.windows[i] + WINDOW - 1]

    def states(self, answers: dict) -> np.ndarray:
        """0: no window is a repeat; 1: all are; 2: by the suffix arrays; 3: window by window."""
        out = self.later.astype(np.int8)
        for bucket, got in answers.items():
            out[self.by_bucket[bucket]] = got
        return out

    def open_(self, answers: dict, buckets: int) -> dict[int, list]:
        """What the second question asks: by bucket the windows' (stretch, first window, windows)."""
        state = self.states(answers)
        found: dict[int, list] = {}
        for i in np.nonzero(state == 2)[0].tolist():
            found.setdefault(int(self.gram[i] % np.uint64(buckets)), []).append((i, 0, int(self.windows[i])))
        for i in np.nonzero(state == 3)[0].tolist():
            data = self.bytes_of(i)
            for w in range(int(self.windows[i])):
                d = hashlib.blake2b(data[w : w + WINDOW], digest_size=8).digest()
                found.setdefault(int.from_bytes(d, "little") % buckets, []).append((i, w, 1))
        return found


def _hasher() -> Hasher:
    state = worker_state()
    if "suffix hasher" not in state:
        state["suffix hasher"] = Hasher()
    return state["suffix hasher"]


def settle(packets: list) -> list[np.ndarray]:
    """The first question's answers."""
    size = [len(p[0]) for p in packets]
    gram, d1, d2, n = (np.concatenate([p[c] for p in packets]) for c in range(4))
    order = np.lexsort((d2, d1, gram))
    g, a, b = gram[order], d1[order], d2[order]
    new_gram = np.ones(len(g), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new = new_gram.copy()
    new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.cumsum(new_gram) - 1
    kinds = np.bincount(which, new)[which]
    state = np.where(~new, 1, np.where(kinds < 2, 0, np.where(kinds > HOT, 3, 2)))
    out = np.zeros(len(g), np.int8)
    out[order] = state
    return np.split(out, np.cumsum(size)[:-1])


def windows_of(packet) -> np.ndarray:
    """All windows of a packet of (joined bytes, windows of each piece)."""
    data, counts = np.frombuffer(packet[0], np.uint8), np.asarray(packet[1], np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts + WINDOW - 1)[:-1]])
    p = np.repeat(firsts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    return np.ascontiguousarray(view[p]).view(f"S{WINDOW}").ravel()


def matched(packets: list) -> list[np.ndarray]:
    """The second question's answers: packets are batches of suffixes, in the order of the documents."""
    family = SuffixLevels()
    return [np.packbits(family.add(windows_of(p))) for p in packets]


def suffix_dedup(docs: DataFrame, block_docs: int = 4096, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text: kept_text and spans as well."""
    dealt, buckets = deal(docs, block_docs, True)
    parts = partitions(docs)

    def block_of(group):
        give_back()
        rows = rows_of(group, True)
        return rows, Block([text_bytes(t) for _, t in rows], buckets)

    def ask_stretches(group):
        _, block = block_of(group)
        return {b: (block.gram[i], block.d1[i], block.d2[i], np.zeros(len(i), np.int8)) for b, i in block.by_bucket.items()}

    def ask_windows(group, answers):
        _, block = block_of(group)
        return {b: (b"".join(block.bytes_of(i)[w : w + n + WINDOW - 1] for i, w, n in xs), [n for _, _, n in xs]) for b, xs in block.open_(answers, buckets).items()}

    first = answered(asked(dealt, [], ask_stretches, parts), settle)
    second = answered(asked(dealt, [first], ask_windows, parts), matched)
    key_type = to_arrow_type(docs.schema["doc_id"].dataType)
    both = first.selectExpr("_b", "bucket", "answer", "1 AS n").unionByName(second.selectExpr("_b", "bucket", "answer", "2 AS n"))

    def put(left, right):
        rows, block = block_of(left)
        n = np.array(right.column("n").to_pylist())
        one, two = (answers_of(right.take(pa.array(np.nonzero(n == k)[0]))) for k in (1, 2))
        state = block.states(one)
        edges: list = [[] for _ in rows]  # (start, end) of runs of repeated windows, with the window's length
        for i in np.nonzero(state == 1)[0].tolist():
            s = int(block.start[i])
            edges[block.text[i]].append((s, s + int(block.windows[i]) + WINDOW - 1))
        for bucket, xs in block.open_(one, buckets).items():
            bits, at = np.unpackbits(two[bucket]), 0
            for i, w, k in xs:
                for x in np.nonzero(bits[at : at + k])[0].tolist():
                    s = int(block.start[i]) + w + x
                    edges[block.text[i]].append((s, s + WINDOW))
                at += k
        out = []
        for (k, t), found in zip(rows, edges):
            data, spans = text_bytes(t), []
            for a, b in sorted(found):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((k, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), [{"start": a, "end": b} for a, b in spans]))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"]
        kinds = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        cols = list(zip(*out)) or [[]] * 7
        return pa.table({n: pa.array(c, kind) for n, c, kind in list(zip(names, cols, kinds))[: 7 if with_text else 5]})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, spans array<struct<start: long, end: long>>" * with_text
    return dealt.groupBy("_b").cogroup(both.groupBy("_b")).applyInArrow(put, schema)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))
