"""Page priors of an intent from headings: 2 for a pattern that occurs, and the Jaccard overlap with its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sparse import top

KEEP = 5


def headings(rows: DataFrame) -> DataFrame:
    """(hid, title, title_norm, page_start, page_end) with -1 for missing pages."""
    title = F.coalesce("title", "heading", F.lit(""))
    return rows.select("hid", title.alias("title"), T.norm_heading(title).alias("title_norm"), F.coalesce("page_start", F.lit(-1)).alias("page_start"), F.coalesce("page_end", F.lit(-1)).alias("page_end"))


def heading_scores(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """(intent, hid, score): rows of headings() against (intent, patterns, words); both are dimensions of headings and intents."""
    hit = F.exists("patterns", lambda p: F.regexp_like("title", F.concat(F.lit("(?iu)"), p)) | F.regexp_like("title_norm", F.concat(F.lit("(?iu)"), p)))
    own = F.array_distinct(F.filter(F.split("title_norm", " "), lambda x: x != ""))
    bag = F.array_distinct(F.filter(F.flatten(F.transform("words", lambda w: F.split(T.norm_heading(w), " "))), lambda x: x != ""))
    score = F.when(hit, 2.0).otherwise(0.0) + T.jaccard(own, bag)
    return rows.join(intents, F.lit(True)).select("intent", "hid", "title", "page_start", "page_end", F.round(score, 6).alias("score")).where("score > 0")


def section_priors(rows: DataFrame, intents: DataFrame, keep: int = KEEP) -> DataFrame:
    """(intent, headings, pages) of the best headings; a lone start is one page, a range that runs backwards only its start."""
    best = top(heading_scores(headings(rows), intents), keep, "intent", tie="hid")
    s, e = F.col("page_start"), F.col("page_end")
    span = F.when((s >= 0) & (e >= s), F.sequence(s, F.greatest(s, e))).when(s >= 0, F.array(s)).otherwise(F.array().cast("array<int>"))
    return best.groupBy("intent").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "title"))), lambda x: x["title"]).alias("headings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(span)))).alias("pages"))
