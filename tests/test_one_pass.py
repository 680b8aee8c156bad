"""Tokens are cut out in tasks as Spark cuts them, a search of many words reads the index once, and of orders only those of results are joined."""

from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import index, keyword
from quillstone.plans import fixtures as fx
from quillstone.plans import registry
from tests.sessions import SMALL


def test_tokens_found_in_tasks_are_the_tokens(spark):
    odd = ["", None, "a", " a ", "́abc éx ́́ y̱z", "́", "Foo_bar समिति ½ x² q İstanbul ΣΑΣ", "a\nb\r\nc", "...", "x\U0001f600y \U00020000́Z\U000e0101", "1,2;;3", "\x00\U00100000 ퟿￿"]
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd += ["".join(chr(c) + end for c in every[i : i + 9973]) for i in range(0, len(every), 9973) for end in ("", ".")]
    rows = spark.createDataFrame(list(enumerate(odd)), "chunk_id long, text string")
    made = index._tokenised(rows, None).join(rows, "chunk_id").select("dl", "ts", tx.index_tokens(F.col("text")).alias("tokens")).collect()
    assert len(made) == len(odd)
    for r in made:
        assert (r["ts"] or "") == index.BETWEEN.join(r["tokens"] or []) and r["dl"] == len(r["tokens"] or []), r


def test_a_search_of_many_words_reads_the_index_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "NAMED", 2)
    made = keyword.build(spark.createDataFrame([(i, f"a{i % 7}x b{i % 5}x c{i} d-{i % 3}x") for i in range(60)], "chunk_id long, text string"), folder=str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a1x b2x c12 d-1x"), (2, "a3x b3x"), (3, "none")], "qid long, question string")
    lists = keyword.Lists(made, keyword.phrases(asked))
    assert not any(str(tmp_path) in f for f in lists.blocks.inputFiles())  # the few blocks were written
    assert {r["term"] for r in lists.blocks.collect()} <= {t for r in keyword.phrases(asked).collect() for t in r["terms"]}
    few = keyword.keyword_search(made, asked, 5).collect()
    monkeypatch.setattr(keyword, "NAMED", 200)
    assert sorted(few) == sorted(keyword.keyword_search(made, asked, 5).collect())


def test_orders_of_few_results_are_picked_before_the_join(spark):
    few = spark.createDataFrame([(g,) for g in (1, 2, 7, 150)], "goid long")
    got = fx.orders(spark, SMALL, few)
    assert sorted(got.collect()) == sorted(fx.orders(spark, SMALL).where("goid in (1, 2, 7, 150)").collect()) and got.count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2  # documents and orders
    asked = []
    before = fx.orders
    try:
        fx.orders = lambda s, d, only=None: asked.append(only) or before(s, d, only)
        registry._results(spark, SMALL)
    finally:
        fx.orders = before
    assert asked and all(o is not None for o in asked)
