"""Small documents with every odd case, and frames of them with clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHES = ("row", "blk", "rest", "cls", "sig", "keys", "stage", "bucket", "n", "size", "rank", "__row")


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta épsilon zeta eta Theta iota kappa lambda mü nu xi omicron pi rho".split()) + str(r.randrange(40)) for _ in range(n))


def odd_texts() -> list[str | None]:
    long = prose(400, 1)
    words = long.split(" ")
    near = " ".join([*words[:200], "changed", *words[201:]])
    passage = prose(90, 2)
    return [
        None, "", "   \n\t ", "one", "One", "two words", "a b c d", "a b c d", "a b c d e", "A B C D E", long, long, long.upper(), near, long + " tail", None,
        prose(60, 3) + " " + passage + " " + prose(50, 4), prose(30, 5) + "\n" + passage + "\t" + prose(70, 6), "ab" * 700, "x" * 900, "same same " * 60, prose(3000, 7), prose(3000, 7) + " z",
        "日本語" * 200, "日本語" * 200 + "末", passage, "é" * 450, "w " * 36, "w " * 35, prose(34, 8), prose(34, 8),
    ]


def frame(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return made.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def empty(spark: SparkSession) -> DataFrame:
    return frame(spark, []).limit(0)
