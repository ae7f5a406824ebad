"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are runs of three words (fewer words: all of them), lower-cased,
weighted 1 to 3 by their length, as long terms tell more; a term votes as often as it stands in the text. Each of
``BITS`` bits is set where the votes for it outweigh those against. Votes are
packed: (hash >> i) & (1 + 2**21 + 2**42) holds the bits i, i + 21 and i + 42 as counters
of 21 bits, so 21 sums count 63 bits; texts of over 2**19 terms are
summed in pieces, before the counters could overflow.

The likeness of two fingerprints that differ in d bits is cos(pi * d / BITS), at
least 0: what SimHash estimates of the cosine of the terms' weights.

Nulls are empty texts; a text without words has the fingerprint 0. Rows
with a null doc_id have no place in the order. Rows that repeat
doc_id and text count once; different texts of one doc_id follow each
other by text. A single document is its own successor. The query returns a row for every row: what
repeats as often as it stands in the table, and rows without a place with nulls for what
an edit or a successor would tell (``every_row``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

HALVES, FIELD = 2, 21
BITS = HALVES * 3 * FIELD
MASK = 1 | 1 << FIELD | 1 << 2 * FIELD


def terms(text):
    """Runs of three words as an array Column; one null for a text without words."""
    words = F.filter(F.split(F.lower(text), r"[\s]+"), lambda w: w != "")
    # a variable bound once: the word array is not split again for each run
    runs = F.transform(F.array(words), lambda w: F.when(F.size(w) < 1, F.array(F.lit(None).cast("string"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    return runs[0]


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fingerprint array of HALVES longs): one row a key; rows that share a key add up their votes."""
    t = texts.select(*keys, F.posexplode(terms(F.coalesce(F.col(text), F.lit("")))).alias("_at", "_term"))
    hashes = [F.xxhash64("_term", F.lit(i)).alias(f"_h{i}") for i in range(HALVES)]
    weight = F.when(F.col("_term").isNull(), 0).when(F.length("_term") < 9, 1).when(F.length("_term") < 17, 2).otherwise(3).cast("long")
    voted = t.select(*keys, F.shiftright("_at", 19).alias("_piece"), *hashes, weight.alias("_w"))
    sums = [F.sum(F.shiftrightunsigned(f"_h{i}", b).bitwiseAND(F.lit(MASK)) * F.col("_w")).alias(f"_s{i * FIELD + b}") for i in range(HALVES) for b in range(FIELD)]
    packed = voted.groupBy(*keys, "_piece").agg(F.sum("_w").alias("_all"), *sums)
    rows = packed.groupBy(*keys).agg(F.sum("_all").alias("_all"), F.collect_list(F.array(*[F.col(f"_s{i}") for i in range(HALVES * FIELD)])).alias("_s"))

    def counter(place, shift):
        return F.aggregate("_s", F.lit(0).cast("long"), lambda a, s: a + F.shiftrightunsigned(s[place], shift).bitwiseAND(F.lit((1 << FIELD) - 1)))

    def half(i):
        word = F.lit(0).cast("long")
        for b in range(3 * FIELD):
            word = word.bitwiseOR(F.when(counter(i * FIELD + b % FIELD, FIELD * (b // FIELD)) * 2 > F.col("_all"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
        return word

    return rows.select(*keys, F.array(*[half(i) for i in range(HALVES)]).alias("fingerprint"))


def text_of(fp):
    return F.lower(F.concat(*[F.lpad(F.hex(fp[i]), 16, "0") for i in range(HALVES)]))


def distance(a, b):
    d = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, HALVES):
        d = d + F.bit_count(a[i].bitwiseXOR(b[i]))
    return d


def likeness(a, b):
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * distance(a, b) / BITS))


def near_fingerprints(fps: DataFrame, radius: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints within ``radius`` bits: (a, b, distance) of classes, and the members (key, class).

    The bits fall into radius + 1 blocks; fingerprints within the radius agree in one block at
    least, so each block's table, in which that block stands first, is joined
    on it. A class is one fingerprint, whatever its number of
    documents, so copies are never paired.
    """
    members = fps.select(key, text_of(F.col("fingerprint")).alias("class"))
    classes = fps.select(text_of(F.col("fingerprint")).alias("class"), "fingerprint").dropDuplicates(["class"])
    bits = F.array_join(F.transform("fingerprint", lambda x: F.lpad(F.substring(F.bin(x), -63, 63), 63, "0")), "")
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    blocks = F.array(*[F.substring(bits, a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    t = classes.select("class", "fingerprint", F.posexplode(blocks).alias("n", "block"))
    a, b = t.alias("a"), t.alias("b")
    d = distance(F.col("a.fingerprint"), F.col("b.fingerprint"))
    pairs = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.class") < F.col("b.class")) & (d <= radius))
    return pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b"), d.alias("distance")).distinct(), members


def with_next(docs: DataFrame, per_bucket: int = 64, most_buckets: int = 16_384) -> DataFrame:
    """Adds next_id and next_text, of the next row by (doc_id, text); after the last comes the first.

    Rows are dealt over ranges of doc_id of equal width; the first row of each range goes to the
    range before it as well, so a window inside ranges sees every successor. The ranges' first
    ids, at most ``most_buckets``, are all that is ordered as a whole.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, lo, hi = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    buckets = min(most_buckets, max(1, n // per_bucket))
    lo, width = lo or 0, max(1, -(-((hi or 0) - (lo or 0) + 1) // buckets))
    rows = rows.withColumn("_r", F.floor((F.col("doc_id") - lo) / width).cast("long"))
    firsts = rows.groupBy("_r").agg(F.min("doc_id").alias("first"))
    everywhere = W.orderBy("first")
    last = firsts.agg(F.max("_r").alias("_last"))
    before = firsts.withColumn("_p", F.lag("_r").over(everywhere)).crossJoin(F.broadcast(last)).select("first", F.coalesce("_p", "_last").alias("_to"))
    ghosts = rows.join(F.broadcast(before), F.col("doc_id") == F.col("first")).select("doc_id", "text", F.col("_to").alias("_r"), F.lit(1).alias("_ghost"))
    both = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    w = W.partitionBy("_r").orderBy("_ghost", "doc_id", "text")
    again = F.coalesce((F.lag("doc_id").over(w) == F.col("doc_id")) & (F.lag("text").over(w) == F.col("text")) & (F.col("_ghost") == 0), F.lit(False))
    once = both.withColumn("_again", again).where(~F.col("_again"))
    seen = once.withColumn("next_id", F.lead("doc_id").over(w)).withColumn("next_text", F.lead("text").over(w))
    return seen.where("_ghost = 0").select("doc_id", "text", "next_id", "next_text")


def placed(docs: DataFrame) -> DataFrame:
    """A row for each doc_id and text that has a place in the order; _x is the text's hash."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).select("doc_id", "text", F.xxhash64("text").alias("_x"), n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"), "next_id", F.xxhash64("next_text").alias("_nx"))
    versions = rows.select("doc_id", "_x", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("text")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("text")))).alias("e")).select("doc_id", "_x", "e.v", "e.text")
    fp = fingerprints(versions, ["doc_id", "_x", "v"])
    by_doc = fp.groupBy("doc_id", "_x").agg(F.max(F.when(F.col("v") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fingerprint"))).alias("ep"))
    facts = rows.select("doc_id", "_x", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_id", "_nx")
    kept = stored(facts.join(by_doc, ["doc_id", "_x"]), "simhash")
    after = kept.select(F.col("doc_id").alias("next_id"), F.col("_x").alias("_nx"), F.col("fp").alias("np"))
    return kept.join(after, ["next_id", "_nx"]).select("doc_id", "_x", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("ep")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("ep")).alias("near_edited"), likeness(F.col("fp"), F.col("np")).alias("near_next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    return placed(docs).drop("_x")


def every_row(docs: DataFrame) -> DataFrame:
    """edited_fingerprints with a row for every row of ``docs``."""
    found = placed(docs)
    names = [c for c in found.columns if c != "_x"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = rows.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("_x")).agg(F.count("*").alias("_n")).where("_n > 1")
    ordered = found.join(again, ["doc_id", "_x"], "left").select(*names, "_n")
    alone = rows.where("doc_id is null").groupBy("text").agg(F.count("*").alias("_n")).withColumn("_key", F.sha2(F.col("text").cast("binary"), 256))
    fps = fingerprints(alone, ["_key"]).select("_key", text_of(F.col("fingerprint")).alias("fingerprint"))
    known = {"n_chars": F.char_length("text").cast("long"), "fingerprint": F.col("fingerprint")}
    unordered = alone.join(fps, "_key").select(*[known.get(c, F.lit(None)).cast(found.schema[c].dataType).alias(c) for c in names], "_n")
    return ordered.unionByName(unordered).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))).alias("_copy")).drop("_copy")


def op3_simhash(spark, sf_dir):
    return every_row(table(spark, sf_dir, "documents"))
