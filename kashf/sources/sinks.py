"""Results, summaries and documents out. Only reports of a few rows pass through the driver."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_folder(base: str) -> str:
    return f"{base.rstrip('/')}/run_{datetime.datetime.now():%Y%m%d_%H%M%S}"


def write_results(rows: DataFrame, path: str) -> None:
    """JSON lines in the order of qid."""
    rows.repartitionByRange("qid").sortWithinPartitions("qid").write.mode("overwrite").json(path)


def summary_text(totals: DataFrame, rows: DataFrame) -> str:
    """The Markdown report of an evaluation run of interactive size."""
    t = totals.first()
    head = f"# Evaluation\n\n- questions: {t.total}\n- loose: {t.loose or 0}/{t.total}\n- strict: {t.strict or 0}/{t.total}\n- repaired: {t.repaired or 0}\n"
    parts = [f"\n## {r.qid}. {r.q}\n\nintent: {r.intent}; loose: {r.pass_loose}; strict: {r.pass_strict}; pages: {', '.join(map(str, r.pages)) or '-'}\n\n{r.body}\n" for r in rows.orderBy("qid").toLocalIterator()]
    return head + "".join(parts)


def write_summary(text: str, spark, path: str) -> None:
    """One text file, through Spark, so that any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def document_json(docs: DataFrame) -> DataFrame:
    """(name, body): each document as indented JSON under the stem of its file name."""
    stem = F.regexp_replace("source_filename", r"\.[^.]*$", "")
    return docs.select(F.concat(stem, F.lit(".json")).alias("name"), F.to_json(F.struct(*docs.columns), {"pretty": "true"}).alias("body"))


def upsert(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """New rows, and old ones whose key isn't new."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def payload(docs: DataFrame, message: str = "extract") -> DataFrame:
    """(name, body) -> (name, content, message) as an interface takes files: the content in base64, without line breaks."""
    return docs.select("name", F.translate(F.base64(F.encode("body", "utf-8")), "\r\n", "").alias("content"), F.concat(F.lit(f"{message} "), "name").alias("message"))


def upsert_versioned(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, body, version) after the writes of (name, body, replaces), and the names whose writes are refused.

    A write states the version that it replaces, null for a new name; it is refused if the stored one is another by now.
    """
    met = new.join(old.select("name", F.col("version").alias("_is"), F.lit(True).alias("_there")), "name", "left")
    fits = F.col("_is").eqNullSafe(F.col("replaces"))
    written = met.where(fits).select("name", "body", F.sha2(F.encode("body", "utf-8"), 256).alias("version"))
    return upsert(old.select("name", "body", "version"), written), met.where(~fits).select("name")
