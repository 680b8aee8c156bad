"""Incremental ingest: pages of recognised words arrive as files, passages and references are appended once an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators import chunking

WORDS = "goid long, page int, block int, par int, line int, word int, x int, y int, w int, h int, conf double, text string"


def start(spark: SparkSession, incoming: str, passages: str, checkpoint: str) -> StreamingQuery:
    """Chunks every new batch of word files; orders that already have passages are skipped whole.

    A batch that is repeated after a failure finds its orders present and adds nothing; its own partition folder is
    overwritten, so a half-written batch leaves no trace.
    """

    def batch(words: DataFrame, number: int) -> None:
        own = words.sparkSession
        made = chunking.passages(words)
        target = f"{passages}/batch={number}"
        hadoop = own._jvm.org.apache.hadoop.fs.Path(passages)
        if hadoop.getFileSystem(own._jsc.hadoopConfiguration()).exists(hadoop):
            known = own.read.schema(made.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(passages).where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
            made = made.join(known.select("goid").distinct(), "goid", "left_anti")
        made.write.mode("overwrite").parquet(target)

    return spark.readStream.schema(WORDS).parquet(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling windows; rows later than the watermark are left out of closed windows."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
