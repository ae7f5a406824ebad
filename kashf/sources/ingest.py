"""Raw files to structured documents, with the recogniser and the extractor passed in, each working a partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "txt")
DOCUMENT = "source_filename string, doc_title string, sections array<struct<id: string, level: int, title: string, path: array<string>, page_range: array<int>, content: string>>"
LEAST_CHARS, MOST_CHARS = 20, 20_000


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))


def plain_text(contents: list[bytes]) -> list[str]:
    """A recogniser for files that are text already."""
    return [c.decode("utf-8", "replace") for c in contents]


def ingest(files: DataFrame, recognise, extract) -> DataFrame:
    """Documents of (path, content): ``recognise(contents) -> texts``, ``extract(texts, names) -> JSON texts``.

    Texts of under LEAST_CHARS characters go, as do answers that aren't JSON of the document's form. The extractor gets at
    most MOST_CHARS characters of each, as its interface asks. Missing names, titles and sections get defaults.
    """

    def texts(batches):
        for pdf in batches:
            yield pdf.assign(text=recognise(pdf["content"].tolist()))[["name", "text"]]

    def structures(batches):
        for pdf in batches:
            yield pdf.assign(doc=extract(pdf["text"].tolist(), pdf["name"].tolist()))[["name", "doc"]]

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    read = named.mapInPandas(texts, "name string, text string").where(F.char_length(F.trim("text")) >= LEAST_CHARS)
    docs = read.withColumn("text", F.substring("text", 1, MOST_CHARS)).mapInPandas(structures, "name string, doc string")
    parsed = docs.select("name", F.from_json("doc", DOCUMENT).alias("d")).where("d is not null")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return parsed.select(F.coalesce("d.source_filename", "name").alias("source_filename"), F.coalesce("d.doc_title", stem).alias("doc_title"), F.coalesce("d.sections", F.array().cast(files.sparkSession.createDataFrame([], DOCUMENT).schema["sections"].dataType)).alias("sections"))
