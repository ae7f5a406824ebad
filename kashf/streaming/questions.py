"""Questions as a stream: each micro-batch is answered against the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import engine
from ..sources.index import Index

SCHEMA = "qid long, q string"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of JSON files that come to a folder; blank ones and the words that end a dialogue are skipped."""
    return spark.readStream.schema(SCHEMA).json(folder).where("trim(coalesce(q, '')) NOT IN ('', 'exit', 'quit', 'q')")


def answer_stream(questions: DataFrame, index: Index, out: str, checkpoint: str, **options):
    def batch(df: DataFrame, n: int) -> None:
        if not df.isEmpty():
            engine.answer(index, df, **options).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
