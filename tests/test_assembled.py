"""Pages are assembled in one pass over their words, as from words and passages apart."""

from quillstone.operators import chunking
from quillstone.plans import registry
from tests.sessions import SMALL, plain


def test_assembled_pages_are_those_of_words_and_passages(spark):
    made = []
    for goid in range(1, 6):
        for line in range(40):
            for word in range(goid * 3 % 11 + 1):
                text = ["stone", "", None, "１२/3456", "...", "नदी", "a\tb"][(line * 7 + word * goid) % 7]
                made.append((goid, line // 20 + 1, line // 6, 1, line, word, word * 10, line * 20, 30, 15, None if (line + word) % 5 == 0 else float(line % 9) / 4, text))
    made += [(6, 1, 0, 1, n, 0, 0, 0, 1, 1, None, "...") for n in range(3)]  # nothing but furniture
    words = spark.createDataFrame(made, "goid long, page int, block int, par int, line int, word int, x int, y int, w int, h int, conf double, text string")
    apart = chunking.pages(words, chunking.passages(words))
    once = chunking.assembled(words)
    assert once.columns == apart.columns and once.dtypes == apart.dtypes
    key = lambda df: sorted(tuple(plain(v) for v in r) for r in df.drop("mean_conf").collect())
    assert key(once) == key(apart) and any(r["goid"] == 6 and r["text"] == "" for r in once.collect())
    conf = lambda df: {(r["goid"], r["page"]): r["mean_conf"] for r in df.collect()}
    assert conf(once) == conf(apart) and conf(once)[(6, 1)] is None


def test_page_assembly_deals_its_texts_once(spark):
    plan = registry.page_assembly(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan  # not in as few tasks as their bytes would fill
