"""Best-fit packing by a configuration linear program over the length histogram.

Documents become ids and a closing id 0; what is longer than a sequence is
cut. The histogram of piece lengths has at most ``capacity`` rows; all that
follows on the driver is bounded by it, whatever the corpus.

1. Pieces of at most 1 / ``SMALL`` of a sequence are set aside. The other lengths are grouped on a grid of ``GRID`` steps, rounded up, so that each group has a demand worth a program.
2. Multiplicative weights solve the program: each round prices the groups, a knapsack by dynamic
   programming finds the pattern of most worth, and its groups become cheaper. The rounds
   end when every group is covered.
3. The solution is rounded along the running sum of its patterns, so that what one loses the next gains, and each pattern
   is filled with real lengths: the largest of each group, and for the last piece the largest that fits.
4. What is left and what was set aside goes, by best fit decreasing, into the room that sequences still have, then into new ones.

Pieces find their places by their rank among the pieces of their length, without any being sorted as a whole.

Null texts are empty: one piece with the id 0. Repeated rows are packed each.
A null doc_id stays. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_table import WHITE, _tokenizer, byte_of_char
from .common import arrow_map, dense_rank_in, stored, table, tokenizer_path, worker_state

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
GRID, SMALL = 128, 16
ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
CUT = re.compile(f"[{WHITE}]+")
#: Letters that stay one letter each when they are composed and lower-cased; the dotted capital I gains a mark, which joins the punctuation after it.
LETTERS = [chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130)]
PLAIN = re.compile(f"([A-Za-z{''.join(LETTERS)}]+)([{re.escape(string.punctuation)}]*)")


class WordIds:
    """Run of characters without white space -> its ids as little-endian unsigned 32-bit integers.

    Words of plain letters, and punctuation after them, are what the tokenizer parts a text into anyway. Their letters
    are encoded together, by its model alone, and told apart by the ids that end a word; all
    other words go through the whole tokenizer. Words of over ``LONGEST`` characters aren't kept, and a full cache
    keeps the words that it met first, the frequent ones.
    """

    LONGEST = 48

    def __init__(self, model: str, most: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.known: dict[str, bytes] = {}
        self.most, self.kept = most, most // 2
        self.tokenizer = _tokenizer(model)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        char = {b: c for c, b in byte_of_char().items()}
        self.bytes_of = {ord(c): "".join(char[b] for b in c.encode()) for c in LETTERS}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> set[str]:
        """Encodes together what the cache lacks; returns what is too long to be kept."""
        cores, parts, whole = set(), {}, set()
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                cores.add(w)
            elif m := PLAIN.fullmatch(w):
                core, tail = m[1].lower(), m[2]
                parts[w] = core, tail
                if core not in self.known:
                    cores.add(core)
                if tail and tail not in self.known:
                    whole.add(tail)
            else:
                whole.add(w)
        cores, whole = list(cores), list(whole)
        for at in range(0, len(cores), 8192):
            some = cores[at : at + 8192]
            ids = np.array(self.letters.encode(" ".join(some).translate(self.bytes_of), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            flat = ids.tobytes()
            self.known.update((w, flat[a:b]) for w, a, b in zip(some, [0, *stops[:-1]], stops, strict=True))
        for at in range(0, len(whole), 4096):
            some = whole[at : at + 4096]
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))
        self.known.update((w, self.known[core] + self.known[tail] if tail else self.known[core]) for w, (core, tail) in parts.items())
        return {w for some in (cores, whole, parts) for w in some if len(w) > self.LONGEST}

    def ids(self, texts: list[str]) -> list[bytes]:
        words = [[w for w in CUT.split(t) if w] if ODD.search(t) else t.split() for t in texts]
        lacking = set().union(*words).difference(self.known)
        brief = self.learn(lacking)
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in words]
        for w in brief:
            del self.known[w]
        if len(self.known) > self.most:
            self.known = dict(islice(self.known.items(), self.kept))
        return out


def parcels(texts: list[str], most: int = 2_000_000):
    """Slices of the list with about ``most`` characters at most, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield texts[at:]


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, most_words: int = 800_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; a worker keeps at most ``most_words`` words, which changes its speed only."""

    def setup():
        state = worker_state()
        key = ("word ids", model, most_words)
        if key not in state:
            state[key] = WordIds(model, most_words)
        return state[key]

    def fn(words, cols):
        rows = []
        encoded = (ids for some in parcels([t or "" for t in cols["text"]]) for ids in words.ids(some))
        for i, ids in zip(cols["doc_id"], encoded):
            ids += b"\0\0\0\0"
            for p in range(0, len(ids), 4 * capacity):
                part = ids[p : p + 4 * capacity]
                rows.append((i, p // (4 * capacity), p // 4, len(part) // 4, zlib.crc32(part)))
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows)))) if rows else None

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), fn, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", setup=setup)


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths within the capacity that is worth most: {place in lengths: copies}."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -1
        if k := upto[c]:
            v = worth[:k] + best[c - lengths[:k]]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], took[c] = v[i], i
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if (i := int(took[c])) < 0:
            c -= 1
        else:
            found[i] = found.get(i, 0) + 1
            c -= int(lengths[i])
    return found


def best_fit(counts: dict[int, int], capacity: int, begun=()) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing on a histogram, bins alike being handled together, ``begun`` ones first: [(bins, {length: copies})]."""
    open_: dict[int, list] = {}
    left: list[int] = []
    done = []

    def put(rem, n, pattern):
        if not rem:
            done.append((n, pattern))
        else:
            if rem not in open_:
                insort(left, rem)
                open_[rem] = []
            open_[rem].append((n, pattern))

    for n, pattern in begun:
        put(capacity - sum(l * k for l, k in pattern.items()), n, pattern)
    for l in sorted(counts, reverse=True):
        n = counts[l]
        while n > 0:
            at = bisect_left(left, l)
            if at < len(left):
                rem = left[at]
                bins, pattern = open_[rem].pop()
                if not open_[rem]:
                    del open_[rem], left[at]
            else:
                rem, bins, pattern = capacity, n, {}
            each = rem // l
            use = min(bins, n // each)
            if use:
                put(rem - each * l, use, pattern | {l: pattern.get(l, 0) + each})
                n -= use * each
            elif n:
                use = 1
                put(rem - n * l, 1, pattern | {l: pattern.get(l, 0) + n})
                n = 0
            if bins > use and pattern:
                put(rem, bins - use, pattern)
    return done + [x for v in open_.values() for x in v]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, step: float = 0.1) -> dict[tuple, float]:
    """Patterns ((place in sizes, copies), ...) and how often each is taken, fractions of it too, for the demand to be covered."""
    cover, taken, price = np.zeros(len(sizes)), {}, math.log(len(sizes) + 1)
    while cover.min() < 1:
        worth = np.exp(-(cover - cover.min()) * price / (2 * step)) / demand
        pattern = best_pattern(sizes, worth / worth.max(), capacity)
        i, a = np.array(list(pattern)), np.array(list(pattern.values()), float)
        x = step * float((demand[i] / a).min())
        cover[i] += x * a / demand[i]
        key = tuple(sorted(pattern.items()))
        taken[key] = taken.get(key, 0.0) + x
    # what covers a group more than once is taken back: all patterns alike, by the mean cover of the tokens
    scale = float((demand * sizes).sum() / (cover * demand * sizes).sum())
    return {key: x * scale for key, x in taken.items()}


class Stock:
    """The pieces that are left, by length."""

    def __init__(self, counts: dict[int, int], group):
        self.counts, self.group = dict(counts), group
        self.lengths = sorted(counts)
        self.groups: dict[int, list[int]] = {}
        for l in self.lengths:
            self.groups.setdefault(group(l), []).append(l)

    def largest(self, room: int, used: dict[int, int]) -> int:
        """The largest length that fits and of which a piece is left; 0 if there is none."""
        i = bisect_right(self.lengths, room) - 1
        while i >= 0 and self.counts[self.lengths[i]] <= used.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def take(self, bins: int, pattern: dict[int, int]) -> None:
        for l, k in pattern.items():
            self.counts[l] -= bins * k
            if not self.counts[l]:
                del self.counts[l], self.lengths[bisect_left(self.lengths, l)]
                self.groups[self.group(l)].remove(l)


def chosen(stock: Stock, wanted: list[int], capacity: int) -> dict[int, int]:
    """A length from each wanted group (largest first) that together fit: {length: copies}; empty if the stock has none.

    The largest go first; the last but one and the last are chosen together, to fill the sequence as far as two can.
    """
    used: dict[int, int] = {}
    room = capacity
    for g in wanted[:-2]:
        l = next((l for l in reversed(stock.groups.get(g, ())) if l <= room and stock.counts[l] > used.get(l, 0)), 0)
        if not l:
            return {}
        used[l] = used.get(l, 0) + 1
        room -= l
    best = 0, 0
    if len(wanted) > 1:
        for l in reversed(stock.groups.get(wanted[-2], ())):
            if l < room and stock.counts[l] > used.get(l, 0):
                r = stock.largest(room - l, used | {l: used.get(l, 0) + 1})
                if r and l + r > sum(best):
                    best = l, r
                    if l + r == room:
                        break
    else:
        best = 0, stock.largest(room, used)
    if not best[1]:
        return {}
    for l in best:
        if l:
            used[l] = used.get(l, 0) + 1
            room -= l
    if stock.counts.get(room, 0) > used.get(room, 0):  # one that fits exactly
        used[room] = used.get(room, 0) + 1
    return used


def filled(stock: Stock, wanted: list[int], bins: int, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``bins`` sequences of a pattern, as far as the stock goes: [(sequences, {length: copies})]."""
    out = []
    while bins > 0 and (used := chosen(stock, wanted, capacity)):
        n = min(bins, *(stock.counts[l] // k for l, k in used.items()))
        stock.take(n, used)
        out.append((n, used))
        bins -= n
    return out


def by_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """The sequences that the rounded program makes of ``counts``, and the histogram of what it leaves."""
    unit = -(-capacity // GRID)
    group = lambda l: -(-l // unit)
    grouped: dict[int, int] = {}
    for l, n in counts.items():
        grouped[group(l)] = grouped.get(group(l), 0) + n
    # the last step of the grid may stand out of the capacity: a piece of it has a sequence of its own
    room = max(capacity // unit, max(grouped, default=0))
    sizes = np.array(sorted(grouped))
    taken = solve(sizes, np.array([grouped[g] for g in sizes.tolist()], float), room) if len(sizes) else {}
    stock, found, total, used = Stock(counts, group), [], 0.0, 0
    for key, x in sorted(taken.items(), key=lambda kv: (-int(sizes[kv[0][-1][0]]), -kv[1])):
        total += x
        bins = int(total + 0.5) - used
        used += bins
        found += filled(stock, [int(sizes[i]) for i, k in reversed(key) for _ in range(k)], bins, capacity)
    return found, stock.counts


def configuration_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(sequences, {length: pieces in each})] for the histogram ``counts``."""
    small = {l: n for l, n in counts.items() if l * SMALL <= capacity}
    found, rest = by_patterns({l: n for l, n in counts.items() if l not in small}, capacity)
    return best_fit(rest | small, capacity, found)


def places(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, copies in each, and offset of the first copy, of each run of ranks."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, pattern in plan:
        offset = 0
        for l in sorted(pattern, reverse=True):
            k = pattern[l]
            runs.setdefault(l, []).append((used.get(l, 0), sequence, k, offset))
            used[l] = used.get(l, 0) + bins * k
            offset += l * k
        sequence += bins
    return {l: tuple(np.array(x, np.int64) for x in zip(*r)) for l, r in runs.items()}


def pack(docs: DataFrame, model: str, capacity: int = CAPACITY, most_words: int = 800_000) -> DataFrame:
    cut = stored(pieces(docs, model, capacity, most_words), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(configuration_plan(counts, capacity)))
    ranked = dense_rank_in(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")

    def fn(_, cols):
        rank, length = np.array(cols.pop("rank")), np.array(cols["length"])
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for l in np.unique(length):
            at = np.nonzero(length == l)[0]
            first, base, copies, offset = shared.value[int(l)]
            j = np.searchsorted(first, rank[at], side="right") - 1
            within = rank[at] - first[j]
            seq[at] = base[j] + within // copies[j]
            off[at] = offset[j] + within % copies[j] * l
        return cols | {"sequence_id": seq, "offset": off}

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(ranked, fn, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows=65_536)


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(MODEL))
