"""Headings from JSON files: postings and aliases for the gate, the tree, the leaf nodes, page spans of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_retrieval
from ..operators.gate import parse_postings


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, in whatever store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def lists_of(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord, value) of one JSON object of lists; values that are no lists are skipped, empty lists give no row."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, variant>").alias("m"))
    entries = whole.select(F.explode("m").alias("name", "v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    return entries.select("name", F.posexplode(F.try_variant_get("v", "$", "array<string>")).alias("ord", "value"))


def load_hierarchy(spark: SparkSession, index_path: str | None, alias_path: str | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """(postings, aliases) for the gate; None without a path, a file there or any posting, whatever the aliases hold.

    Names are normalised and folded. Of entries whose names fold alike all count; ``compat`` keeps the last one, and
    the names' ``section:`` prefix.
    """
    if not index_path or not exists(spark, index_path):
        return None
    raw = lists_of(spark, index_path).select(F.col("name").alias("heading"), F.col("value").alias("posting"))
    postings = parse_postings(raw, compat).where("pos is not null")
    if postings.isEmpty():
        return None
    fold = lambda c: F.lower(norm_retrieval(c))
    if alias_path and exists(spark, alias_path):
        aliases = lists_of(spark, alias_path).select(fold("name").alias("canon"), fold("value").alias("alias"))
    else:
        aliases = spark.createDataFrame([], "canon string, alias string")
    return postings, aliases


def heading_tree(spark: SparkSession, path: str) -> DataFrame:
    """(heading, children), one row a heading, a leaf with no children."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("heading", "children"))


def leaf_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(path, title)"""
    return spark.read.schema("path array<string>, title string").option("multiLine", True).json(path)


def section_pages(postings: DataFrame) -> DataFrame:
    """(hid, title, heading, page_start, page_end): the span of each section's postings, as headings for priors."""
    spans = postings.where("page is not null").groupBy("heading").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return spans.select(F.xxhash64("heading").alias("hid"), F.col("heading").alias("title"), "heading", "page_start", "page_end")
