"""Recognition page by page, resumable: each page of each file once, whatever breaks off in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.pdf import page_count
from quillstone.operators.once import once


def page_counts(files: DataFrame) -> DataFrame:
    """(goid, path, pages_total) of PDF files (goid, path, content); files that cannot be read have 0 pages."""
    return files.select("goid", "path", F.udf(page_count, "int")("content").alias("pages_total"))


def recognised(counted: DataFrame, engine: Callable[[str, int], str], folder: str, tries: int = 1) -> DataFrame:
    """(goid, page, value, error): TSV words of every page of (goid, path, pages_total), or why there are none.

    `engine` makes the TSV of one page of the file at a path, on an executor.  Tasks get pages, not files, so a long file is
    shared out; pages that an earlier run has finished are not made again.
    """
    pages = counted.where("pages_total > 0").select("goid", "path", F.explode(F.sequence(F.lit(1), F.col("pages_total"))).alias("page"))
    work = pages.withColumn("key", F.concat_ws(":", F.col("goid").cast("string"), F.col("page").cast("string")))
    made = once(work, lambda row: engine(row["path"], int(row["page"])), folder, tries)
    return work.select("key", "goid", "page").join(made.select("key", "value", "error"), "key").drop("key")


def progress(counted: DataFrame, made: DataFrame) -> DataFrame:
    """(goid, pages_total, pages_done, failed) of every file."""
    done = made.groupBy("goid").agg(F.count_if(F.col("error").isNull()).alias("pages_done"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    none = F.lit(0).cast("long")
    return counted.select("goid", "pages_total").join(done, "goid", "left").select("goid", "pages_total", F.coalesce("pages_done", none).alias("pages_done"), F.coalesce("failed", none).alias("failed"))
