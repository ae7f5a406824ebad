"""Sharding by a k-d tree over document metadata.

The tree is grown level by level. A node that owes k shards is cut, along
the dimension in which it is widest, where k // 2 of every k of its bytes
lie below; the cut is the weighted median for k = 2. All nodes of a level
are served by the same jobs: a histogram of bytes in at most ``BINS`` bins a
node narrows each cut to one bin, again and again, so that what reaches the
driver is bounded by shards * BINS sums, and no row is ever sorted.

Dimensions: language, source and length, and, where those tie, a hash of
the text. Language and source of equal texts are the least of the group, so
equal texts lie at one point; a cut passes beside such a point, unless it
weighs over ``GROUP_SHARE`` of a shard: then it goes through the group, by a
hash of doc_id, since sizes could not be near equal otherwise.

Null texts weigh nothing but the overhead, null metadata sort first,
repeated rows are placed each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dense_rank_in, stored, table

BINS = 2048
MOST_VARIED = 200_000
GROUP_SHARE = 0.02
TOLERANCE = 0.0005
TOP = 1 << 62


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates k0, k1, k2 (longs below 2**62) and r, which parts equal texts."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), "lang", "source")
    varied = base.groupBy("g", "size").agg(F.min("lang").alias("l0"), F.min("source").alias("s0"), F.max("lang").alias("l1"), F.max("source").alias("s1"))
    varied = varied.where((F.col("l0") != F.col("l1")) | (F.col("s0") != F.col("s1"))).select("g", F.col("size").alias("z"), "l0", "s0")
    varied = stored(varied, "varied")
    # a large group of equal texts is one row here; with many such groups no single one is large, and Spark splits the skewed
    varied = F.broadcast(varied) if varied.count() <= MOST_VARIED else varied
    b = base.alias("b").join(varied.alias("v"), (F.col("b.g") == F.col("v.g")) & (F.col("size") == F.col("z")), "left")
    b = b.select("doc_id", "size", "text_crc32", F.col("b.g").alias("g"), F.coalesce("l0", "lang").alias("lang"), F.coalesce("s0", "source").alias("source"))
    tie = F.shiftrightunsigned("g", 22)  # 42 bits

    def place(x):  # 20 bits before the tie
        return F.shiftleft(x.cast("long"), 42).bitwiseOR(tie)

    name = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit((1 << 20) - 1)) + 1)
    return b.select("doc_id", "size", "text_crc32", place(name("lang")).alias("k0"), place(name("source")).alias("k1"), place(F.least(F.lit((1 << 20) - 1), (F.log2(F.col("size").cast("double")) * 16384).cast("long"))).alias("k2"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("r"))


class Node:
    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.dim = self.cut = self.left = self.right = None

    def plain(self):
        """The tree as tuples, which any worker can read: (first shard,) or (dim, cut, row cut, left, right)."""
        return (self.first,) if self.cut is None else (self.dim, *self.cut, self.left.plain(), self.right.plain())


def place_rows(tree, k: list[np.ndarray], r: np.ndarray) -> np.ndarray:
    """The first shard of each row's leaf."""
    out, todo = np.zeros(len(r), np.int64), [(tree, np.arange(len(r)))]
    while todo:
        node, at = todo.pop()
        if len(node) == 1:
            out[at] = node[0]
        elif len(at):
            dim, cut, row_cut, left, right = node
            x = k[dim][at]
            low = (x < cut) | ((x == cut) & (r[at] < row_cut))
            todo += [(left, at[low]), (right, at[~low])]
    return out


def _columns(cols) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    return [np.array(cols[f"k{d}"], np.int64) for d in range(3)], np.array(cols["r"], np.int64), np.array(cols["size"], np.int64)


def _statistics(meta: DataFrame, tree) -> dict:
    """For each leaf: bytes, and least and greatest coordinate of each dimension."""

    def add(state, cols):
        k, r, w = _columns(cols)
        node = place_rows(tree, k, r)
        for n in np.unique(node):
            at = node == n
            now = [int(w[at].sum()), *[int(f(x[at])) for x in k for f in (np.min, np.max)]]
            was = state.get(int(n))
            state[int(n)] = now if was is None else [was[0] + now[0], *[(min, max)[i % 2](a, b) for i, (a, b) in enumerate(zip(was[1:], now[1:]))]]

    names = ["w", *[f"{f}{d}" for d in range(3) for f in ("min", "max")]]
    found = arrow_map(meta, add, "n long, " + ", ".join(f"{x} long" for x in names), rows=50_000, setup=dict, finish=lambda st: {"n": list(st)} | {x: [v[i] for v in st.values()] for i, x in enumerate(names)})
    aggs = [(F.sum if x == "w" else F.min if x[:3] == "min" else F.max)(x).alias(x) for x in names]
    return {row["n"]: row for row in found.groupBy("n").agg(*aggs).collect()}


def _narrow(meta: DataFrame, tree, jobs: dict, by_row: int) -> None:
    """Moves each job's [lo, hi) to the one bin in which its target lies: a bin of coordinates or, inside one coordinate, of r."""
    for j in jobs.values():
        j["step"] = max(1, -(-(j["hi"] - j["lo"]) // BINS))
    asked = {f: (j["dim"], j["lo"], j["hi"], j["step"], j.get("at", 0)) for f, j in jobs.items()}

    def add(state, cols):
        k, r, w = _columns(cols)
        node = place_rows(tree, k, r)
        for n, (dim, lo, hi, step, point) in asked.items():
            x = r if by_row else k[dim]
            at = (node == n) & (x >= lo) & (x < hi)
            if by_row:
                at &= k[dim] == point
            b, s = np.unique((x[at] - lo) // step, return_inverse=True)
            for i, v in zip(b.tolist(), np.bincount(s, w[at], len(b)).tolist()):
                state[n, i] = state.get((n, i), 0) + int(v)

    found = arrow_map(meta, add, "n long, bin long, w long", rows=50_000, setup=dict, finish=lambda st: {"n": [a for a, _ in st], "bin": [b for _, b in st], "w": list(st.values())})
    bins: dict = {}
    for row in found.groupBy("n", "bin").agg(F.sum("w").alias("w")).collect():
        bins.setdefault(row["n"], []).append((row["bin"], row["w"]))
    for n, j in jobs.items():
        below = j["below"]
        for b, w in sorted(bins.get(n, [])):
            if below + w > j["target"]:
                j["lo"], j["hi"], j["below"], j["weight"] = j["lo"] + b * j["step"], min(j["hi"], j["lo"] + (b + 1) * j["step"]), below, w
                break
            below += w
        else:
            j["lo"], j["below"], j["weight"] = j["hi"], below, 0


def grow(meta: DataFrame, shards: int) -> Node:
    root = Node(0, shards)
    level, spread, share = [root], None, 1.0
    while level := [n for n in level if n.shards > 1]:
        tree = root.plain()
        stats = _statistics(meta, tree)
        if spread is None and stats:
            spread = [max(1, stats[0][f"max{d}"] - stats[0][f"min{d}"]) for d in range(3)]
            share = stats[0]["w"] / shards
        jobs = {}
        for n in level:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
            if s := stats.get(n.first):
                n.dim = max(range(3), key=lambda d: ((s[f"max{d}"] - s[f"min{d}"]) / spread[d], -d))
                jobs[n.first] = {"node": n, "dim": n.dim, "lo": s[f"min{n.dim}"], "hi": s[f"max{n.dim}"] + 1, "below": 0, "weight": s["w"], "target": s["w"] * half / n.shards}
            else:
                n.dim = 0
        for by_row in (0, 1):
            while now := {f: j for f, j in jobs.items() if j["weight"] > TOLERANCE * share and j["hi"] - j["lo"] > 1}:
                _narrow(meta, tree, now, by_row)
            for j in jobs.values():  # to the nearer side of what is left
                edge = j["lo"] if j["target"] - j["below"] <= j["weight"] / 2 else j["hi"]
                j["edge"] = (j["at"], edge) if by_row else (edge, 0)
            if by_row:
                break
            whole = dict(jobs)
            # a heavy group of equal texts is cut by row
            jobs = {f: j | {"at": j["lo"], "lo": 0, "hi": TOP} for f, j in jobs.items() if j["hi"] - j["lo"] == 1 and j["weight"] > GROUP_SHARE * share}
        for n in level:
            n.cut = (jobs.get(n.first) or whole[n.first])["edge"] if n.first in whole else (TOP, 0)
        level = [c for n in level for c in (n.left, n.right)]
    return root


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    meta = stored(metadata(docs), "kd")
    root = grow(meta, shards)
    tree = root.plain()

    def place(_, cols):
        k, r, _w = _columns(cols)
        return {c: cols[c] for c in ("doc_id", "size", "text_crc32")} | {"shard": place_rows(tree, k, r)}

    kind = dict(docs.dtypes)["doc_id"]
    placed = arrow_map(meta, place, f"doc_id {kind}, size long, text_crc32 long, shard int", rows=50_000)
    ranked = dense_rank_in(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_kd_shards(spark, sf_dir):
    return kd_shards(table(spark, sf_dir, "documents"))
