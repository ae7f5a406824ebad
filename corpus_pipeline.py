"""From documents to packed training sequences, in four stages.

1. toxicity: documents whose score reaches 0.5 go.
2. near_dedup: one document of each group of near copies (five words a shingle, similarity 0.8 or more) stays.
3. suffix_dedup: bytes under 100-byte strings that stand earlier go from the texts; a character that
   loses a part goes whole, so that texts stay valid. Documents stay, even if nothing is left of their text.
4. packing: what is kept, as pieces of sequences of at most 2048 tokens.

Every stage but the last returns the columns of documents, whatever their names. n_chars, where there is one, follows the text. Nulls and repeated rows are
handled as the operators' modules say; a document repeated whole stays once after stage 2. Different texts that share
a doc_id count as one document in stage 2: the least text stays. Rows without a doc_id pass stages 2 and 3 as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kashf.llm import minhash_dedup, packing, suffix_dedup, toxicity
from kashf.llm.common import stored, table, tokenizer_path, unstore


def plain_names(docs: DataFrame) -> DataFrame:
    """The same rows, columns but doc_id, text and n_chars under numbers, so that none clashes with what an operator adds."""
    return docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"_c{i}" for i, c in enumerate(docs.columns)])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = plain_names(docs)
    scored = toxicity.score(rows, model, [c for c in rows.columns if c != "doc_id"])
    return scored.where("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def place(salt: int, bits: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(bits))


def bitmap(ids: DataFrame, salt: int, most_bits: int = 1 << 26) -> tuple[DataFrame, int]:
    """The bits that a hash gives the doc_ids, 64 to 128 for each of them, at most ``most_bits`` (8 MB), as (_part, _bits) of 4 KB each; the number of bits."""
    bits = min(most_bits, max(1 << 15, 1 << (64 * ids.count()).bit_length()))
    placed = ids.select(place(salt, bits).alias("_at"))
    parts = placed.groupBy(F.bitmap_bucket_number("_at").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    return stored(parts, "bitmap"), bits


def in_bitmap(rows: DataFrame, held: tuple[DataFrame, int], salt: int, set_: bool = True) -> DataFrame:
    """The rows whose doc_id's bit is set; if not ``set_``, the others, of which none has an id of the bitmap."""
    parts, bits = held
    at = F.bitmap_bit_position(place(salt, bits))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, 1)), 16, 10)
    is_set = F.coalesce(F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(parts), F.bitmap_bucket_number(place(salt, bits)) == F.col("_part"), "left")
    return joined.where(is_set if set_ else ~is_set).select(*rows.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_components(docs, n=5, percent=80, bands=38, rows=5)
    kept = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("_n")), "kept")
    unstore(spark, found)
    rows = plain_names(docs)
    # texts are not shuffled to meet the ids that stay: a bit that no other id has settles a row, and the few ids whose bits clash are joined
    others = bitmap(kept.where("_n != 1"), 1)
    clash = stored(in_bitmap(kept.where("_n = 1").select("doc_id"), others, 1), "clash")
    exact = in_bitmap(in_bitmap(rows, others, 1), bitmap(clash, 2), 2).join(clash, "doc_id", "left_semi")
    out = in_bitmap(rows, others, 1, False).where("doc_id is not null").select(*rows.columns).unionByName(exact.select(*rows.columns))
    again = kept.where("_n > 1")
    if not again.isEmpty():
        # rows that share a doc_id are of one group: the one with the least text stays
        shared = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.coalesce("text", F.lit(""))).alias("_row"))
        out = out.unionByName(shared.select("_row.*"))
    return out.unionByName(rows.where("doc_id is null")).select(*rows.columns).toDF(*docs.columns)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers serve all stages: blocks of half the documents
    cut = suffix_dedup.suffix_dedup(docs, block_docs=2048, with_text=True).where("doc_id is not null").select(F.col("doc_id").alias("_cut_id"), F.col("kept_text").alias("_cut_text"))
    # a doc_id is unique after stage 2; only what is left of a text meets its row again. Rows without a doc_id keep their texts
    rows = plain_names(docs)
    own = rows.where("doc_id is not null").withColumn("_no_text", F.col("text").isNull()).drop("text")
    joined = own.join(cut, F.col("doc_id") == F.col("_cut_id")).withColumn("text", F.when(~F.col("_no_text"), F.col("_cut_text")))
    if "n_chars" in rows.columns:
        joined = joined.withColumn("n_chars", F.char_length("text").cast(rows.schema["n_chars"].dataType))
    return joined.select(*rows.columns).unionByName(rows.where("doc_id is null")).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers serve all stages, so none of them keeps much
    return packing.pack(docs, tokenizer_path(packing.MODEL), most_words=100_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Learning, iteration and tokenizing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        unstore(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
