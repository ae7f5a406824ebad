"""Candidates from headings: postings, aliases, and the fallback for questions that the gate leaves empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import gate_tokens, norm_retrieval

DAMPING = 0.85


def parse_postings(postings: DataFrame, compat: bool = False) -> DataFrame:
    """(heading, posting) -> (heading, file, page, ordinal, pos). ``<file>_<page>_<ordinal>`` in full; with
    ``compat`` only what is an integer, or the digits at its end, as pos."""
    p = F.col("posting")
    tail = F.coalesce(p.try_cast("int"), F.nullif(F.regexp_extract(p, r"(\d+)$", 1), F.lit("")).try_cast("int"))
    parts = r"^(.*)_(\d+)_(\d+)$"
    grab = lambda i: F.nullif(F.regexp_extract(p, parts, i), F.lit(""))
    key = F.lower(norm_retrieval("heading"))
    key = key if compat else F.regexp_replace(key, r"^section:\s*", "")
    return postings.select(key.alias("heading"), grab(1).alias("file"), grab(2).try_cast("int").alias("page"), grab(3).try_cast("int").alias("ordinal"), tail.alias("pos"))


def locate(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(heading, pos): a posting with a page means the chunk of that ordinal on the page, a plain number a position."""
    places = chunks.where("page >= 0").select("page", "pos", (F.row_number().over(W.partitionBy("page").orderBy("pos")) - 1).alias("ordinal"))
    on_page = postings.where("page is not null").select("heading", "page", "ordinal").join(places, ["page", "ordinal"]).select("heading", "pos")
    return on_page.unionByName(postings.where("page is null and pos is not null").select("heading", F.col("pos").cast(chunks.schema["pos"].dataType).alias("pos")))


def candidate_keys(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, key): tokens of the question, and the canonical headings of which a name or alias stands in it.

    ``aliases`` is (canon, alias), both normalised: a dimension of the headings, counted before it is broadcast.
    """
    q = questions.select("qid", F.lower(norm_retrieval("q")).alias("qn"))
    tokens = q.select("qid", F.explode(gate_tokens(F.col("qn"))).alias("key"))
    names = aliases.select("canon", F.col("alias").alias("name")).unionByName(aliases.select("canon", F.col("canon").alias("name"))).where("name != ''").distinct()
    names = F.broadcast(names) if names.limit(50_001).count() <= 50_000 else names
    named = q.join(names, F.contains("qn", "name")).select("qid", F.col("canon").alias("key"))
    return tokens.unionByName(named).distinct()


def candidates(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, pos) whose heading is among the question's keys."""
    return keys.join(postings.select(F.col("heading").alias("key"), "pos"), "key").select("qid", "pos").distinct()


def gated(scores: DataFrame, allowed: DataFrame, rank, k: int, compat: bool = False) -> DataFrame:
    """The k best allowed rows; compat ranks all rows first and filters the k best."""
    if compat:
        return rank(scores, k).join(allowed, ["qid", "pos"], "left_semi")
    return rank(scores.join(allowed, ["qid", "pos"], "left_semi"), k)


def with_fallback(inside: DataFrame, everywhere: DataFrame, asked: DataFrame) -> DataFrame:
    """Gated rows, and for gated questions without any the ungated ones, damped; questions that weren't gated stay whole.

    ``asked`` holds the qid of the questions that had candidates.
    """
    empty = asked.select("qid").distinct().join(inside.select("qid").distinct(), "qid", "left_anti")
    free = everywhere.join(asked.select("qid").distinct(), "qid", "left_anti")
    back = everywhere.join(empty, "qid", "left_semi").withColumn("score", F.col("score") * DAMPING)
    tag = lambda d, t: d.withColumn("gate", F.lit(t))
    return tag(inside, "inside").unionByName(tag(back, "fallback")).unionByName(tag(free, "open"))
