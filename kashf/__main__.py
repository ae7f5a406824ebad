"""python -m kashf --chunks FILE [--sanity]: answers questions from the terminal or runs the sanity questions."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .functions import text as T
from .functions.prompts import SANITY_PROMPTS
from .operators import compose, evaluate
from .plans import engine
from .sources import index as I
from .sources import sinks
from .sources.chunks import load_chunks
from .sources.hierarchy import load_hierarchy

log = logging.getLogger("kashf")
MODEL = "hashed-trigrams-256"


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kashf")
    p.add_argument("--chunks", required=True, help="chunks as a JSON array or JSON lines")
    p.add_argument("--hier-index", help="headings with their postings")
    p.add_argument("--aliases", help="other names of the headings")
    p.add_argument("--sanity", action="store_true", help="run the sanity questions, write a report and leave")
    p.add_argument("--out-dir", default="runs")
    p.add_argument("--save-index")
    p.add_argument("--load-index")
    p.add_argument("--model", default=MODEL, help="name under which the index is stored")
    p.add_argument("--rtl", choices=("auto", "off", "force"), default="auto")
    p.add_argument("--digits", choices=("ascii", "arabic"), default="ascii")
    p.add_argument("--compat", action="store_true")
    return p.parse_args(argv)


def ready_index(spark: SparkSession, args: argparse.Namespace) -> I.Index:
    chunks, mark = load_chunks(spark, args.chunks)
    found = I.load(spark, args.load_index, mark, args.model, chunks.count()) if args.load_index else None
    if found is None:
        found = I.build(chunks, fingerprint=mark, model=args.model)
        if args.save_index:
            I.save(found, args.save_index)
            found = I.load(spark, args.save_index, mark, args.model)
    return found


def sanity(spark: SparkSession, index: I.Index, hierarchy, args: argparse.Namespace) -> str:
    asked = spark.createDataFrame(list(enumerate(SANITY_PROMPTS, 1)), "qid int, q string")
    rows = engine.run(index, asked, hierarchy=hierarchy, compat=args.compat)
    rows = rows.withColumn("body", T.display("body", args.rtl, args.digits)).cache()
    out = sinks.run_folder(args.out_dir)
    sinks.write_results(rows, f"{out}/results")
    text = sinks.summary_text(evaluate.summary(rows), rows)
    sinks.write_summary(text, spark, f"{out}/summary")
    return text


def ask(spark: SparkSession, index: I.Index, hierarchy, args: argparse.Namespace, lines) -> None:
    for line in lines:
        q = line.strip()
        if q in ("exit", "quit", "q"):
            return
        if not q:
            continue
        a = engine.answer(index, spark.createDataFrame([(1, q)], "qid int, q string"), hierarchy=hierarchy, compat=args.compat)
        shown = compose.rendered(T.display("body", args.rtl, args.digits), a["pages"], a["found"], wrap=False)
        print(a.select(shown.alias("t")).first().t, flush=True)


def main(argv: list[str] | None = None) -> None:
    args = options(argv)
    spark = SparkSession.builder.appName("kashf").getOrCreate()
    index = ready_index(spark, args)
    hierarchy = load_hierarchy(spark, args.hier_index, args.aliases, args.compat)
    if args.sanity:
        print(sanity(spark, index, hierarchy, args))
    else:
        ask(spark, index, hierarchy, args, sys.stdin)


if __name__ == "__main__":
    main()
