"""MinHash near-dedup with odd sketches.

A document's set holds its distinct shingles, as 64-bit hashes. Equal sets are one class, which its least
doc_id stands for. Each class has ``bands * rows`` MinHash samples. Classes
that share a band's ``rows`` samples meet in a bucket; two sets of similarity s miss
each other with probability (1 - s**rows) ** bands: 3e-7 at 0.85 by 32 bands of 6. Odd
sketches, the parities of the samples' hashes in a number of bits, tell by the
population count of their XOR which of these pairs can be as similar; a link is confirmed on the full sets. There are two:
one of the bands' samples, and a finer one of the set's bottom sample, which is the shingles whose hash begins with as many zeros as leave
about ``SAMPLE`` of them, so all of a set of up to ``SAMPLE``. The XOR of two parities never has more bits than
the samples have differences, and two sets of x and y shingles that are as similar differ in at most (x + y) * (1 - s) / (1 + s): for
whole sets the finer sketch rules out no link at all.

No bucket's pairs are all emitted. First every member is held against one of its
bucket, the one that shares most with others (the original, among edited copies). Links give
components. In buckets that still hold several components, the members outside the largest are held against four of its
members, which links most of those that resemble no centre. Those left outside are held against all members of other components, as
a join under the sketch's condition, so that a link between components of any bucket is found and the last pass of components is exact.

Null and blank texts have an empty set and no links. Rows with a null doc_id have
none either (component_id null, kept). Repeated rows are members each, with one component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, stored, table, text_bytes, unstore

SKETCH, FINE, SAMPLE = 1024, 2048, 1024


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def seeds(n: int, what: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(what))


class Words(dict):
    def __missing__(self, w):
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64 and len(self) < 200_000:
            self[w] = h
        return h


def shingle_set(text, n: int, words: Words) -> np.ndarray:
    """Sorted hashes of the distinct runs of n words (fewer words: of all), A-Z lower-cased."""
    ws = text_bytes(text).lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    m = min(n, len(h))
    out = np.zeros(len(h) - m + 1, np.uint64)
    for i in range(m):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - m + 1 + i])
    return np.unique(out + np.uint64(m))


class Sampler:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a, self.b = seeds(k, 1) | np.uint64(1), seeds(k, 2)
        self.salt, self.fold, self.band = seeds(k, 3), seeds(rows, 4) | np.uint64(1), seeds(bands, 5)

    def samples(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 1024):
            least = np.minimum(least, (s[at : at + 1024, None] * self.a + self.b).min(axis=0))
        return least

    def keys(self, m: np.ndarray) -> np.ndarray:
        return mix((mix(m.reshape(self.bands, self.rows)) * self.fold).sum(axis=1) + self.band)

    def sketch(self, m: np.ndarray) -> np.ndarray:
        return parities(mix(m ^ self.salt), SKETCH)

    def fine(self, s: np.ndarray) -> np.ndarray:
        """The odd sketch of the set's bottom sample."""
        h, level = mix(s ^ self.salt[0]), level_of(len(s))
        return parities(mix(h + self.salt[0]) if not level else mix(h[h >> np.uint64(64 - level) == 0] + self.salt[0]), FINE)


def level_of(n: int) -> int:
    """How many zeros the hashes of a bottom sample of n shingles begin with."""
    return max(0, (n - 1) // SAMPLE).bit_length()


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    at = (h % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_bits(k: int, similar: float, sigmas: float = 5.5) -> int:
    """The most bits in which the sketches of two sets so similar differ, but for ``sigmas`` deviations of the samples and of the fold."""
    differ = k * (1 - similar) + sigmas * math.sqrt(k * similar * (1 - similar))
    bits = SKETCH / 2 * (1 - math.exp(-4 * differ / SKETCH))
    return math.ceil(bits + 3 * math.sqrt(bits / 4))


def signatures(docs: DataFrame, n: int, sampler: Sampler) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (which tell sets apart), keys, sketch and fine sketch of every row."""

    def fn(words, cols):
        out = {c: [] for c in ("n_shingles", "s1", "s2", "keys", "sketch", "fine")}
        for t in cols["text"]:
            s = shingle_set(t, n, words)
            m = sampler.samples(s)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            out["n_shingles"].append(len(s))
            out["s1"].append((d & (1 << 64) - 1) - (1 << 63))
            out["s2"].append((d >> 64) - (1 << 63))
            out["keys"].append(sampler.keys(m).view(np.int64) if len(s) else [])
            out["sketch"].append(sampler.sketch(m) if len(s) else [])
            out["fine"].append(sampler.fine(s) if len(s) else [])
        return {"doc_id": cols["doc_id"]} | out

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), fn, f"doc_id {kind}, n_shingles long, s1 long, s2 long, keys array<long>, sketch array<long>, fine array<long>", setup=Words)


def compressed_texts(docs: DataFrame) -> DataFrame:
    """(rep, text), compressed before they are shuffled."""
    pack = lambda z, cols: {"rep": cols["doc_id"], "text": [z.compress(text_bytes(t)) for t in cols["text"]]}
    return arrow_map(docs.select("doc_id", "text"), pack, f"rep {dict(docs.dtypes)['doc_id']}, text binary", setup=lambda: zstandard.ZstdCompressor(level=3))


def differing(a: str, b: str, bits: int):
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(bits // 64)))


def can_link(percent: int, bits: int):
    """Whether the sets of a and b, by their sizes (na, nb) and sketches (ka, kb and fa, fb), can be as similar."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    level = lambda n: F.length(F.bin(F.floor((F.col(n) - 1) / SAMPLE))) * (F.col(n) > SAMPLE).cast("int")
    differ = (F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent)
    sampled = differ / F.pow(F.lit(2.0), level("na"))
    most = F.when(F.col("na") > SAMPLE, sampled + 5.5 * F.sqrt(sampled)).otherwise(differ)
    fine = (level("na") != level("nb")) | (differing("fa", "fb", FINE) <= most)
    return (100 * small >= percent * large) & fine & (differing("ka", "kb", SKETCH) <= bits)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int, block_pairs: int = 512) -> DataFrame:
    """The (a, b), of stored pairs, whose full sets are similar enough.

    Pairs are dealt over blocks by a hash of a; each block gets the texts that its pairs name, each once, so that neither
    a document that a third of all others resemble nor its text gathers in one task.
    """
    blocks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // block_pairs))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    needs = stored(dealt.select("block", F.col("a").alias("rep")).unionByName(dealt.select("block", F.col("b").alias("rep"))).distinct(), "needs")
    kind = dict(pairs.dtypes)["a"]
    arrow = to_arrow_type(pairs.schema["a"].dataType)

    def verify(left, right):
        words, sets, z, out = Words(), {}, zstandard.ZstdDecompressor(), []
        for r, t in zip(right.column("rep").to_pylist(), right.column("text")):
            sets.setdefault(r, []).append(shingle_set(z.decompress(t.as_py()).decode("utf-8", "surrogatepass"), n, words))
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            for x in sets.get(a, ()):
                for y in sets.get(b, ()):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * 100 >= percent * (len(x) + len(y) - both) and (not out or out[-1] != (a, b)):
                        out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], arrow), "b": pa.array([b for _, b in out], arrow)})

    found = dealt.groupBy("block").cogroup(needs.join(texts, "rep").groupBy("block")).applyInArrow(verify, f"a {kind}, b {kind}")
    found = stored(found, "links")
    unstore(pairs.sparkSession, needs)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(rep, label): the least node that each node of an edge reaches, by hooking to least neighbours and jumping."""
    two_way = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(two_way.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rep"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = two_way.join(labels.select(F.col("rep").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        hooked = labels.join(near.withColumnRenamed("a", "rep"), "rep").select("rep", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("rep").alias("label"), F.col("label").alias("up"))
        step = stored(hooked.join(up, "label", "left").select("rep", "was", F.coalesce(F.least("label", "up"), "label").alias("label")), "labels")
        changed = not step.where("label != was").isEmpty()
        unstore(edges.sparkSession, labels)
        labels = step.select("rep", "label")
        if not changed:
            unstore(edges.sparkSession, two_way)
            return labels


def near_components(docs: DataFrame, n: int = 3, percent: int = 85, bands: int = 32, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sampler = Sampler(bands, rows)
    bits = most_bits(bands * rows, percent / 100)
    sig = stored(signatures(docs, n, sampler), "signatures")
    linked = sig.where("n_shingles > 0 and doc_id is not null")
    # texts that differ under one doc_id are classes of one name, and so linked
    classes = linked.groupBy("s1", "s2").agg(F.min_by(F.struct("doc_id", "n_shingles", "keys", "sketch", "fine"), "doc_id").alias("m"))
    classes = stored(classes.select("s1", "s2", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), "m.keys", "m.sketch", "m.fine"), "classes")
    # keys and sketches are most of the disk, and the result needs none of them
    sizes, names = stored(sig.select("doc_id", "n_shingles", "s1", "s2"), "sizes"), stored(classes.select("s1", "s2", "rep"), "names")
    unstore(docs.sparkSession, sig)
    banded = classes.select("rep", F.explode("keys").alias("key"))
    shared = stored(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    seen = stored(banded.join(shared, "key"), "seen")
    score = stored(seen.groupBy("rep").agg(F.sum("c").alias("score")), "score")
    member = stored(seen.select("rep", "key").join(score, "rep"), "members")
    centre = stored(member.groupBy("key").agg(F.max(F.struct("score", F.bitwise_not("rep").alias("least"))).alias("m")).select("key", F.bitwise_not("m.least").alias("c")), "centres")
    sketches = stored(classes.select("rep", "n", "sketch", "fine").join(score, "rep", "left_semi"), "sketches")
    unstore(docs.sparkSession, classes, shared, seen)

    def alike(pairs):
        """(a, b) of the (a, b) whose sketches don't rule them out."""
        x = pairs.join(side("a"), "a").join(side("b"), "b")
        return x.where(can_link(percent, bits)).select("a", "b")

    def side(x):
        return sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("fine").alias(f"f{x}"))

    texts = stored(compressed_texts(docs).join(score.select("rep"), "rep", "left_semi"), "texts")
    pairs = member.join(centre, "key").where("rep != c").groupBy(F.least("rep", "c").alias("lo"), F.greatest("rep", "c").alias("hi")).agg(F.max("c").alias("b"))
    pairs = stored(alike(pairs.select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b")), "pairs")
    links = confirmed(pairs, texts, n, percent)
    labels, known = components(links), pairs
    done = [score, centre, pairs, links]

    def buckets(labels):
        """(key, rep, label), and of the buckets with several components (key, main, some): the largest one and some members of it."""
        named = stored(member.select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label")), "named")
        some = [F.max_by("rep", F.xxhash64("rep", F.lit(i))).alias(f"r{i}") for i in range(4)]
        by_label = named.groupBy("key", "label").agg(F.count("*").alias("c"), *some).select("key", "c", "label", F.array(*[f"r{i}" for i in range(4)]).alias("some"))
        mixed = by_label.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("c", "label", "some")).alias("m")).where("k > 1")
        return named, stored(mixed.select("key", F.col("m.label").alias("main"), "m.some"), "mixed")

    def unknown(pairs, known):
        return stored(pairs.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "more")

    # members outside against a few of the largest component: most links that the centres missed
    named, mixed = buckets(labels)
    few = named.join(mixed, "key").where("label != main").select("rep", F.explode(F.array_distinct("some")).alias("b")).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    few = unknown(alike(few), known)
    more_links = confirmed(few, texts, n, percent)
    done += [named, mixed, few, more_links]
    if not more_links.isEmpty():
        links, known = links.unionByName(more_links), known.unionByName(few)
        labels = components(links)
        named, mixed = buckets(labels)
        done += [named, mixed]
    # what is left, against all of other components
    rest = stored(named.join(mixed.select("key", "main"), "key").join(sketches, "rep"), "rest")
    member_of = lambda x: [F.col("rep").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("fine").alias(f"f{x}")]
    x, y = rest.where("label != main").select("key", *member_of("a")), rest.select("key", *member_of("b"))
    more = x.join(y, "key").where((F.col("la") != F.col("lb")) & can_link(percent, bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = unknown(more, known)
    late = confirmed(more, texts, n, percent)
    if not late.isEmpty():
        labels = components(links.unionByName(late))
    unstore(docs.sparkSession, *done, member, sketches, texts, rest, more, late)
    named_sets = names.join(labels, "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("label"))
    out = sizes.join(named_sets, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.doc_id),
least_reached AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_reached l USING (doc_id)
"""
