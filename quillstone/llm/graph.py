"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node reachable.  Least labels travel along edges and then jump to their label's label.

    Each round writes its labels to the checkpoint folder and removes those before; the number of rounds grows with the
    logarithm of the longest path for paths, and is two or three for stars.  The last one only sees that no label is to move.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both, all_edges = stored(edges.union(edges.select("b", "a")).distinct(), "both")
    labels, old = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        offers = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("offer")), "b").select("a", F.lit(None), "offer")
        own = labels.select("node", "root", F.col("root").alias("offer"))
        nearer, near = stored(own.union(offers).groupBy("node").agg(F.max("root").alias("root"), F.min("offer").alias("next")), "nearer")
        if nearer.where("next <> root").isEmpty():
            discard(spark, all_edges)
            discard(spark, near)
            return labels
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        labels, new = stored(nearer.join(jump, "next").select("node", F.least("next", "far").alias("root")), "labels")
        discard(spark, near)
        discard(spark, old)
        old = new
