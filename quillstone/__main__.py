"""python -m quillstone build|ingest|search|ask|eval|answers|summary|facets: the stages from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstone.engine import Config, Engine, summary
from quillstone.functions import embed as em
from quillstone.functions.romanise import romanise
from quillstone.operators import catalog, chunking, keyword
from quillstone.sources import readers, sinks
from quillstone.streaming import maintain


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    orders = catalog.upsert_orders(readers.metadata(spark, args.metadata, args.base_url))
    words = readers.words(spark, args.words)
    made = chunking.passages(words)
    passages = chunking.number(made.drop("word_ids", "mean_conf").unionByName(chunking.subject_passages(orders)))
    sinks.relation(passages, f"{args.folder}/passages")
    passages = spark.read.parquet(f"{args.folder}/passages")
    keyword.build(passages, folder=f"{args.folder}/words")
    keyword.phonetic_index(passages, romanise, f"{args.folder}/phonetic")
    pages = chunking.pages(words, made)
    sinks.relation(pages, f"{args.folder}/pages")
    refs = catalog.references(spark.read.parquet(f"{args.folder}/pages"), orders).withColumn("target_goid", F.lit(None).cast("long"))
    sinks.relation(catalog.resolve(refs, orders), f"{args.folder}/references")
    sinks.relation(catalog.mark_indexed(orders, passages), f"{args.folder}/orders")
    sinks.vectors(passages.withColumn("embedding", em.embed(F.col("text"), em.hashing())), f"{args.folder}/vectors")


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Takes in the pages of orders that are new, leaving everything else as it is."""
    orders = catalog.upsert_orders(readers.metadata(spark, args.metadata, args.base_url))
    maintain.start(maintain.page_files(spark, args.incoming, args.files), args.folder, f"{args.folder}/stream", orders, em.hashing()).awaitTermination()
    sinks.relation(catalog.mark_indexed(orders, spark.read.parquet(f"{args.folder}/passages")), f"{args.folder}/orders")


def main() -> None:
    p = argparse.ArgumentParser(prog="quillstone")
    p.add_argument("command", choices=["build", "ingest", "search", "ask", "eval", "answers", "summary", "facets"])
    p.add_argument("text", nargs="*")
    p.add_argument("--folder", default="data")
    p.add_argument("--metadata", default="data/meta/dept-*.json")
    p.add_argument("--words", default="data/ocr/*/page-*.tsv")
    p.add_argument("--incoming", default="data/ocr", help="folder of page files to ingest")
    p.add_argument("--files", type=int, default=None, help="page files a micro-batch")
    p.add_argument("--replies", default=None, help="folder in which replies of the model are kept")
    p.add_argument("--tries", type=int, default=3, help="calls of the model for a prompt that fails")
    p.add_argument("--base-url", default="https://example.org")
    p.add_argument("--gold", default="eval/gold.json")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--questions", type=int, default=0, help="gold questions to ask, by id (0: all)")
    for f in ("category", "department", "date_from", "date_to", "go_no"):
        p.add_argument(f"--{f.replace('_', '-')}")
    p.add_argument("--goid", type=int)
    args = p.parse_args()
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    if args.command == "build":
        return build(spark, args)
    if args.command == "ingest":
        return ingest(spark, args)
    config = Config(tries=args.tries)
    config.replies = args.replies or config.replies
    engine = Engine.load(spark, args.folder, config=config)
    filters = {f: getattr(args, f) for f in ("category", "department", "goid", "date_from", "date_to", "go_no")}
    if args.command == "search":
        engine.search(args.text, args.limit, **filters).orderBy("qid", "position").show(truncate=80)
    elif args.command == "ask":
        engine.ask(args.text, **filters).show(truncate=120)
    elif args.command in ("eval", "answers"):
        gold = readers.gold(spark, args.gold, args.questions)
        sinks.results(engine.evaluate(gold) if args.command == "eval" else engine.evaluate_answers(gold), f"{args.folder}/{args.command}.json")
        spark.read.json(f"{args.folder}/{args.command}.json").show()
    elif args.command == "summary":  # of the last evaluations, as they were stored
        summary(spark, args.folder).show(truncate=False)
    else:
        engine.facets().orderBy("facet", F.desc("n"), "value").show(100)


if __name__ == "__main__":
    main()
