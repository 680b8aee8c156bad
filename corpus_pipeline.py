"""A training corpus from table `documents`: five stages, each an operator of quillstone.llm.

Each stage takes what its predecessor kept, as reread from Parquet, and returns the columns of `documents`; the last
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from quillstone.llm.common import table, written


#: Passages of 51 words have 155 bytes and more in the languages of `documents`; shorter repeats stay.
MIN_REPEAT = 150


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeated strings are cut out of the texts; n_chars follows the text, and no document goes."""
    return suffix_dedup.drop_repeats(docs, MIN_REPEAT).withColumn("n_chars", F.char_length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: No stage can be expressed in SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
