"""Where results once parted from their SQL: capitals of several letters, and tenths of sums of doubles."""

import datetime
import itertools
import math
import random

from quillstone.operators import evals, fusion, grounding


def test_a_quote_in_capitals_is_found_where_capitals_spell_a_letter_with_two(spark):
    results = spark.createDataFrame([(1, 1, 7, 7, 1, "n", "d", "Die große Straße, ﬁne ẖere")], "qid long, position int, chunk_id long, goid long, page int, go_no string, go_date string, text string")
    said = ["DIE GROSSE STRASSE", "die große Straße", "Die GROẞE straße, FINE H̱ERE", "die grosse strasze", "GROSSE"]
    quotes = spark.createDataFrame([(1, i, "1", t) for i, t in enumerate(said)], "qid long, i int, n string, text string")
    got = {r["i"]: r["reason"] for r in grounding.verify(quotes, results).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "not found verbatim in the cited excerpt", 4: "quote too short to verify"}


def test_tenths_of_a_page_are_those_of_the_double_sum(spark):
    pages = [(1, 1, "a", 100, 52.2, 0.03), (1, 2, "b", 100, 53.5, 15.87), (2, 1, "c", 1, None, 0.5)]
    rows = spark.createDataFrame(pages, "goid long, page int, text string, words int, mean_conf double, seconds double")
    orders = spark.createDataFrame([], "goid long, go_date string, category string, subject string")
    got = {r["goid"]: (r["mean_conf"], r["secs_per_page"]) for r in evals.gate_rows(rows, orders).collect()}
    assert (0.03 + 15.87) / 2 == 7.949999999999999 and got == {1: (52.9, 8.0), 2: (None, 0.5)}


def test_tenths_do_not_hang_on_the_order_of_the_pages(spark):
    conf, seconds = (48.9, 48.9, 48.9, 51.1), (10.73, 11.89, 15.37, 0.21)
    deals = sorted(set(itertools.permutations(zip(conf, seconds, strict=True))))
    pages = [(g, p + 1, "a", 100, c, s) for g, deal in enumerate(deals) for p, (c, s) in enumerate(deal)]
    rows = spark.createDataFrame(pages, "goid long, page int, text string, words int, mean_conf double, seconds double")
    orders = spark.createDataFrame([], "goid long, go_date string, category string, subject string")
    got = {r["goid"]: (r["mean_conf"], r["secs_per_page"]) for r in evals.gate_rows(rows, orders).collect()}
    # added one after the other, three pages of 48.9 and one of 51.1 make 49.4 or 49.5
    assert len(got) == 24 and set(got.values()) == {(49.5, 9.6)} and math.fsum(conf) / 4 * 10 == 494.5


def related_plainly(orders, of, limit=5):
    """(goid, related_goid, gap, place) over all pairs; orders are (goid, go_no, day, category, section)."""
    out = []
    for q in of:
        met = [(abs(c[2] - q[2]), c[0], c[1]) for c in orders if c[0] != q[0] and c[1] != q[1] and (c[3] == q[3] or c[4] == q[4])]
        seen = []
        for gap, goid, no in sorted(met)[: 4 * limit]:
            if no not in [s[2] for s in seen]:
                seen.append((gap, goid, no))
        out += [(q[0], goid, gap, i + 1) for i, (gap, goid, _) in enumerate(seen[:limit])]
    return sorted(out)


def test_related_orders_equal_all_pairs_and_keep_few_of_a_day(spark):
    r = random.Random(5)
    day = lambda i: str(datetime.date(2001, 1, 1) + datetime.timedelta(days=i))
    # crowded days, one number that fills the front of one of them, and days far apart
    rows = [(i, "same" if i < 200 else f"n{r.randrange(40)}", 0 if i < 300 else r.choice([1, 1, 2, 700, 3000]), r.choice("ab"), r.choice("xyz")) for i in range(600)]
    rows += [(1000 + i, f"m{i}", r.randrange(4000), "rare", f"s{i}") for i in range(12)]
    orders = spark.createDataFrame([(g, n, day(d), c, s, 1) for g, n, d, c, s in rows], "goid long, go_no string, go_date_iso string, category string, section string, ocr_ok int")
    of = [x for x in rows if x[0] % 10 == 0 or x[0] >= 1000]
    got = fusion.related(orders, orders.where("goid % 10 = 0 or goid >= 1000"))
    assert sorted(map(tuple, got.collect())) == related_plainly(rows, of)
    c = orders.select("goid", fusion.F.col("go_no").alias("no"), fusion.F.lit(0).alias("day"))
    assert fusion._firsts(c, ["day"], 20, 4).count() == 43  # whatever the number of orders
