"""Contiguous shards of near-equal bytes from global prefix sums.

Method: rows are ordered by doc_id and cut into `ranges` contiguous ranges by quantiles of it; rows whose doc_id is a
quantile itself, perhaps a third of all, are ordered by a part of their checksum and a number dealt to each row, and
cut by these.  The per-range totals are summed over the ranges before (a table of at most `ranges` rows), running sums inside a range
give each row its place in the whole, and rows are cut at equal byte targets: a row belongs to the shard that holds its
middle byte.  Only numbers move; the texts stay where they are read.  DataFrame functions only.

Defined cases: a null text has no bytes and no checksum of its own (that of the empty text); null doc_ids come first;
repeated rows are separate rows, and which of them comes first depends on the input's partitions; ids that are no
numbers are ordered by a hash; a row larger than a target leaves a shard beside it empty; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quillstone.llm.common import durable, table, text_of

OVERHEAD = 16


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    whole = text_of(f"`{text}`")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(whole).cast("long") + OVERHEAD).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))


def shards(docs: DataFrame, count: int = 40, ranges: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to count - 1), slot (gapless from 0 in a shard)."""
    made = sized(docs, key, text)
    number = isinstance(made.schema["doc_id"].dataType, NumericType)
    rows = durable(made.withColumns({"key": F.col("doc_id") if number else F.xxhash64("doc_id"), "nth_read": F.monotonically_increasing_id()}))
    cuts = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # the number of cuts below the key: at most `ranges` of them, so found by counting a constant array
    known = F.array(*map(F.lit, cuts))
    at = F.coalesce(F.size(F.filter(known, lambda c: c < F.col("key"))) if cuts else F.lit(0), F.lit(0))
    hot = F.coalesce(F.array_contains(known, F.col("key")) if cuts else F.lit(False), F.col("key").isNull())
    deal = F.shiftright("text_crc32", 26) * 16 + F.pmod(F.xxhash64("nth_read"), F.lit(16))
    rows = rows.withColumn("range", F.when(F.col("key").isNull(), F.lit(0)).otherwise(at * 2 + 1 + hot.cast("int")) * 1024 + F.when(hot, deal).otherwise(F.lit(0)))
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # a row a range, and for a doc_id that is a quantile one for each part of its rows, at most 1024: bounded whatever the input
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    order = Window.partitionBy("range").orderBy("key", "text_crc32", "size", "nth_read")
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(order)})
    placed = placed.join(F.broadcast(totals), "range").select(
        "doc_id", "size", "text_crc32", "total", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    # middle byte m = start + size / 2 of total bytes: shard = floor(m * count / total), in whole numbers
    placed = placed.withColumn("shard", F.least(F.lit(count - 1), F.expr(f"((2 * start + size) * {count}) div (2 * total)").cast("int")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most `count` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 40).withColumn("grown_shard", F.lit(None).cast("int"))


# DuckDB has no crc32: the bitwise form over the bytes of a whole text is too slow in SQL, so a test compares with zlib.
