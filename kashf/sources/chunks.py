"""Tolerant loading of chunks: JSON lines, one JSON array, or bare strings, with many names for the same field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_retrieval

# The names that a field may have, in the order in which they are tried.
TEXT = ["text", "text_display", "content", "body", "raw", "paragraph", "para", "line", "value", "data", "clean_text", "norm"]
LISTS = ["lines", "paragraphs", "paras", "sentences", "chunks", "blocks", "spans", "tokens"]
PAGE = ["page", "page_no", "page_num", "pageNumber", "page_index", "Page", "PageNo"]
ID = ["id", "chunk_id", "cid", "idx", "index", "Id", "ID"]
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """Adds 0, 1, 2 ... in the order of the partitions: a count of each partition, not a global sort."""
    df = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = df.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select("_p", (F.sum("n").over(W.orderBy("_p")) - F.col("n")).alias("_o"))
    return df.join(F.broadcast(before), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_o")


def records(lines: DataFrame) -> DataFrame:
    """(raw) -> (v variant) of the lines that hold JSON; a quoted line that doesn't parse stays as a string, others go."""
    t = F.regexp_replace(F.regexp_replace("raw", EDGE, ""), r",+$", "")
    closes = ((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]")) | t.rlike(r'^"(?:[^"\\]|\\.)*"$') | t.rlike(r"^[-\d.eE+]+$|^(true|false|null)$"))
    parsed = F.when(closes, F.try_parse_json(t))
    kept = F.when(t.startswith('"') & t.endswith('"'), F.try_parse_json(F.to_json(F.array(t)))).otherwise(F.lit(None))
    quoted = F.try_variant_get(kept, "$[0]", "variant")
    return lines.select("*", F.coalesce(parsed, quoted).alias("v")).where("v is not null").drop("raw")


def _kind(v):
    return F.schema_of_variant(v)


def as_text(v):
    """A string, stripped; a list's strings and numbers, stripped, one a line; otherwise null."""
    one = F.nullif(F.regexp_replace(F.try_variant_get(v, "$", "string"), EDGE, ""), F.lit(""))
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: ~_kind(x).rlike("^(OBJECT|ARRAY|VOID)")), lambda x: F.regexp_replace(F.try_variant_get(x, "$", "string"), EDGE, ""))
    many = F.nullif(F.array_join(F.filter(texts, lambda x: x != ""), "\n"), F.lit(""))
    return F.when(_kind(v) == "STRING", one).when(_kind(v).startswith("ARRAY"), many)


def pick(fields, names: list[str]):
    """The value of the first name that is present and neither null nor empty: as written, then in any case (the last such key)."""
    def usable(v):
        return v.isNotNull() & ~((_kind(v) == "VOID") | ((_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == "")))

    tries = []
    for name in names:
        tries.append(_try_at(fields, usable, name, False))
    for name in names:
        tries.append(_try_at(fields, usable, name.lower(), True))
    return F.coalesce(*tries)


def _try_at(fields, usable, name: str, fold: bool):
    found = F.filter(fields, lambda e: ((F.lower(e["key"]) if fold else e["key"]) == name) & usable(e["value"]))
    return F.when(F.size(found) > 0, F.get(found, F.size(found) - 1)["value"])


def chunks(recs: DataFrame) -> DataFrame:
    """(pos, v) -> (pos, chunk_id, page, text, norm); rows without text go, and keep their numbers free."""
    fields = F.map_entries(F.when(_kind("v").startswith("OBJECT"), F.expr("try_cast(v AS map<string, variant>)")))
    bare = _kind("v") == "STRING"
    r = recs.select("pos", "v", fields.alias("f"), bare.alias("bare"))
    integer = lambda names: F.try_variant_get(pick(F.col("f"), names), "$", "string").try_cast("int")
    text = F.when(F.col("bare"), as_text(F.col("v"))).otherwise(F.coalesce(as_text(pick(F.col("f"), TEXT)), as_text(pick(F.col("f"), LISTS))))
    out = r.select("pos", F.coalesce(F.when(~F.col("bare"), integer(ID).cast("long")), F.col("pos")).alias("chunk_id"), F.coalesce(F.when(~F.col("bare"), integer(PAGE)), F.lit(-1)).alias("page"), text.alias("text"))
    return out.where("text is not null").withColumn("norm", norm_retrieval("text"))


def load_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The chunks of a file and its fingerprint; raises ValueError if there are none."""
    content = spark.read.format("binaryFile").load(path)
    marks = content.select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head and head.value.lstrip().startswith("["):
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("all"))
        recs = whole.select(F.posexplode(F.try_variant_get("all", "$", "array<variant>")).alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))
    else:
        recs = numbered(records(spark.read.text(path).select(F.col("value").alias("raw"))))
    out = chunks(recs)
    if out.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return out, marks[0].h if len(marks) == 1 else "-".join(m.h for m in marks)


def sections_to_chunks(docs: DataFrame) -> DataFrame:
    """(source_filename, doc_title, sections) -> one row a section: ordinal, id, level, title, path, page, content."""
    s = docs.select("source_filename", "doc_title", F.posexplode("sections").alias("ord", "s"))
    page = F.coalesce(F.get("s.page_range", F.lit(0)), F.lit(-1))
    return s.select("source_filename", "doc_title", "ord", "s.id", "s.level", "s.title", F.array_join("s.path", " / ").alias("path"), page.alias("page"), "s.content")
