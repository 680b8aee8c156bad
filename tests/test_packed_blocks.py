"""Blocks hold few bytes a posting, tokens are cut out in one pass, lines are split once, and joins send no texts they don't need."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import index, keyword
from quillstone.plans import fixtures as fx
from quillstone.plans import registry
from quillstone.sources import readers
from tests.sessions import SMALL


def test_numbers_come_back_from_bytes():
    r = np.random.default_rng(1)
    v = np.concatenate([r.integers(0, 200, 900), r.integers(0, 1 << 40, 90), [0, 127, 128, 16383, 16384, (1 << 31) - 1]])
    rows = index.narrow(v, np.array([0, 5, 5, 700, len(v)]))
    assert (index.widened(rows) == v).all() and (index.widened(rows.slice(1, 2)) == v[5:700]).all()
    assert (index.widened(pa.chunked_array([rows.slice(0, 2), rows.slice(2)])) == v).all()
    assert not len(index.widened(index.narrow(v[:0], np.array([0])))) and not len(index.widened(index.narrow(v[:0], np.array([0, 0]))))


def test_a_search_finds_negative_and_far_ids(spark, tmp_path):
    ids = [-5000, -1025, -1024, -1023, -1, 0, 1, 1023, 1024, 1 << 40]
    made = keyword.build(spark.createDataFrame([(i, f"stone x{n}") for n, i in enumerate(ids)], "chunk_id long, text string"), folder=str(tmp_path / "i"))
    asked = spark.createDataFrame([(n, f"x{n}") for n in range(len(ids))], "qid long, question string")
    assert [r["chunk_id"] for r in keyword.keyword_search(made, asked, 2).orderBy("qid").collect()] == ids
    assert dict(made.blocks.dtypes)["ids"] == "binary" and made.blocks.where("term = 'stone'").count() < len(ids)


def test_tokens_in_one_string_are_the_tokens(spark):
    odd = ["", None, "a", " a ", "́abc éx ́́ y̱z", "́", "foo_bar समिति ½ x² q İstanbul", "a\nb\r\nc", "...", "x\U0001f600y \U00020000́", "1,2;;3"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", F.array_join(tx.index_tokens(F.col("t")), "\n").alias("a"), tx.tokens_between(F.col("t"), "\n").alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())


def test_a_recognised_line_is_split_once(spark):
    pages = spark.createDataFrame([(1, 1, "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t80\tone\nshort\tline\n5\t1\t1\t1\tx\t1\t0\t0\t9\t9\t80\tno\n5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t80\t ")], "goid long, page int, value string")
    words = readers.page_words(pages)
    assert [r["text"] for r in words.collect()] == ["one"]
    assert words._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # the page to lines, the line to cells


def test_the_join_of_orders_sends_subjects_and_no_texts(spark):
    plan = fx.orders(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") > plan.index("Join")  # below the join


def test_results_are_sent_to_the_texts_and_not_the_texts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")  # the results of 40 questions, not the texts
    try:
        join = registry.lexical_coverage(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in join and "SortMergeJoin" not in join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
