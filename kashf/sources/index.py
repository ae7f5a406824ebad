"""The index as Parquet tables beside one row of metadata, by which a stored index proves to fit its corpus and model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import text as X
from ..operators import sparse as S
from ..operators.dense import unit

TABLES = ("chunks", "dense", "words", "word_idf", "chars", "char_idf")


@dataclass
class Index:
    chunks: DataFrame
    dense: DataFrame
    words: DataFrame
    word_idf: DataFrame
    chars: DataFrame
    char_idf: DataFrame
    fingerprint: str = ""
    model: str = ""


def hashed_encoder(dim: int = 256):
    """An encoder that needs no model: signed counts of character trigrams, in Column functions, at length 1."""

    def counts(slots):
        hits = lambda k: F.size(F.filter(slots, lambda s: s == k))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (hits(i) - hits(i + dim)).cast("double"))

    def encode(norm):
        slots = F.transform(X.char_ngrams(F.lower(norm), 3, 3), lambda g: F.pmod(F.xxhash64(g), F.lit(2 * dim)))
        return X.bound(X.bound(slots, counts), lambda raw: F.transform(unit(raw), lambda x: x.cast("float")))

    return encode


def build(chunks: DataFrame, encoder=None, fingerprint: str = "", model: str = "hashed-trigrams-256") -> Index:
    encoder = encoder or hashed_encoder()
    n = chunks.agg(F.count("*").alias("n"))
    parts = {}
    for name, terms in (("word", X.word_ngrams(X.words(F.col("norm")))), ("char", X.char_ngrams(F.lower("norm")))):
        counts = S.term_counts(chunks, "pos", terms)
        weights = S.idf(counts, n)
        parts |= {f"{name}s": S.tfidf(counts, weights, "pos"), f"{name}_idf": weights}
    return Index(chunks, chunks.select("pos", encoder(F.col("norm")).alias("v")), fingerprint=fingerprint, model=model, **parts)


def save(index: Index, path: str) -> None:
    for t in TABLES:
        getattr(index, t).write.mode("overwrite").parquet(f"{path}/{t}")
    index.chunks.agg(F.count("*").alias("n_chunks")).select(F.lit(index.model).alias("model_name"), F.lit(index.fingerprint).alias("chunks_hash"), "n_chunks").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


META = T.StructType().add("model_name", "string").add("chunks_hash", "string").add("n_chunks", "long")


def load(spark: SparkSession, path: str, fingerprint: str, model: str, n_chunks: int | None = None) -> Index | None:
    """The stored index, or None if it is missing or was made of another corpus or model."""
    try:
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        if not meta or meta.chunks_hash != fingerprint or meta.model_name != model or (n_chunks is not None and meta.n_chunks != n_chunks):
            return None
        return Index(**{t: spark.read.parquet(f"{path}/{t}") for t in TABLES}, fingerprint=fingerprint, model=model)
    except AnalysisException:
        return None
