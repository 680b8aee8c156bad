"""Counts over orders that are kept by differences: what a change takes off and adds, not the orders that stay as they are.

Every count is a row (slot, kind, value, n) of a keyed relation.  Dates are counted one by one, so that the first and the last are
known also after orders have gone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.keyed import Keyed

SCHEMA = "slot string, kind string, value string, n long"


def open_(spark: SparkSession, folder: str, buckets: int = 8) -> Keyed:
    return Keyed(spark, folder, "slot", SCHEMA, buckets)


def counted(orders: DataFrame) -> DataFrame:
    """(kind, value, n) of orders (category, department, go_date_iso, ocr_ok)."""
    indexed = F.coalesce(F.col("ocr_ok") == 1, F.lit(False))
    row = lambda kind, value, keep: F.when(keep, F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))
    year = F.substring("go_date_iso", 1, 4)
    rows = orders.select(F.explode(F.array_compact(F.array(
        row("category", F.col("category"), indexed), row("department", F.col("department"), indexed), row("year", year, indexed & year.isNotNull()),
        row("date", F.col("go_date_iso"), F.col("go_date_iso").isNotNull()), row("orders", F.lit(None), F.lit(True)), row("indexed", F.col("ocr_ok"), F.col("ocr_ok").isNotNull()),
    ))).alias("r"))
    return rows.groupBy("r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))


def change(kept: Keyed, before: DataFrame | None, after: DataFrame | None, batch: int | None = None) -> int:
    """Takes off the orders as they were before a change and adds them as they are after it; None for no orders."""
    sides = [counted(df).withColumn("n", F.col("n") * sign) for df, sign in ((before, -1), (after, 1)) if df is not None]
    less_more = reduce(DataFrame.unionByName, sides).groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    slot = F.concat(F.col("kind"), F.coalesce(F.concat(F.lit(":"), F.col("value")), F.lit("")))
    add = lambda old, new: old.unionByName(new).groupBy("slot", "kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    return kept.change(less_more.select(slot.alias("slot"), "kind", "value", "n"), add, batch=batch)


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value, n) as catalog.facets counts them."""
    return rows.where(F.col("kind").isin("category", "department", "year")).select(F.col("kind").alias("facet"), "value", "n")


def totals(rows: DataFrame) -> DataFrame:
    """One row as catalog.totals gives it."""
    of = lambda kind: F.col("kind") == kind
    return rows.agg(
        F.coalesce(F.sum(F.when(of("orders"), F.col("n"))), F.lit(0)).alias("orders"), F.coalesce(F.sum(F.when(of("indexed"), F.col("n") * F.col("value").cast("long"))), F.lit(0)).alias("indexed"),
        F.min(F.when(of("date"), F.col("value"))).alias("first_date"), F.max(F.when(of("date"), F.col("value"))).alias("last_date"),
    )
