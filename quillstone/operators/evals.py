"""Retrieval, answer and recognition metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx


def retrieval_details(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, language, hit_at_1, hit_at_5, page_hit_at_5) of the answerable questions; gold has accept_goids or expect_goid."""
    accept = F.coalesce("accept_goids", F.array("expect_goid"))
    good = F.array_contains("accept", F.col("goid"))
    rows = gold.where("not unanswerable").select("qid", "language", "expect_page", accept.alias("accept")).join(results.where("position <= 5").select("qid", "position", "goid", "page"), "qid", "left")
    flag = lambda c: F.coalesce(F.max((c).cast("int")), F.lit(0)) == 1
    return rows.groupBy("qid", "language").agg(flag(good & (F.col("position") == 1)).alias("hit_at_1"), flag(good).alias("hit_at_5"), flag(good & (F.col("page") == F.col("expect_page"))).alias("page_hit_at_5"))


def retrieval_metrics(details: DataFrame, declined: DataFrame) -> DataFrame:
    """One row; `declined` is (qid, declined) of the unanswerable questions, averaged apart."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 3).alias(c)
    a = details.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("language") == "hi").alias("n_hindi"), F.count_if(F.col("language") == "en").alias("n_english"), *map(share, ("hit_at_1", "hit_at_5", "page_hit_at_5")))
    b = declined.agg(F.count(F.lit(1)).alias("n_unanswerable"), F.round(F.avg(F.col("declined").cast("int")), 3).alias("declined_correctly"))
    return a.crossJoin(b)  # one row each


def misses(details: DataFrame, most: int = 8) -> DataFrame:
    return details.where("not hit_at_5").orderBy("qid").limit(most)


def answer_metrics(rows: DataFrame) -> DataFrame:
    """One row from (unanswerable, error, found, n_quotes, n_dropped, cited_expected_order, seconds) rows.

    The median is the upper one of an even number of rows, taken by rank and not by collecting the seconds.
    """
    ok, able = F.col("error").isNull(), F.col("error").isNull() & ~F.col("unanswerable")
    share = lambda cond, of: F.round(F.count_if(of & cond) / F.count_if(of), 3)
    quotes, dropped = F.sum(F.when(able, F.col("n_quotes")).otherwise(0)), F.sum(F.when(able, F.col("n_dropped")).otherwise(0))
    # percentile_disc takes the first value whose share reaches the fraction: just over one half is the upper median
    upper = F.expr("percentile_disc(0.5000000001) within group (order by seconds) filter (where error is null)")
    return rows.agg(
        F.count_if(able).alias("n"), F.count_if(ok & F.col("unanswerable")).alias("n_unanswerable"), F.count_if(~ok).alias("errors"),
        share(F.col("found"), able).alias("answered"), share(F.col("cited_expected_order"), able).alias("cited_expected_order"), share(~F.col("found"), ok & F.col("unanswerable")).alias("declined_unanswerable"),
        quotes.alias("quotes_total"), dropped.alias("quotes_dropped"), F.round(quotes / F.greatest(quotes + dropped, F.lit(1)), 3).alias("quote_verification_rate"), upper.alias("median_seconds"),
    )


#: What counts as a cited number and as a date on a page.
GATE_REF = r"(?:संख्या|सं0|सं\.|No\.?|Number)\s*[-:–]?\s*([0-9०-९][0-9०-९/A-Za-z\x{0900}-\x{097F}()\-.]{4,60})"
GATE_DATE = r"(\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{2,4})|दिनांक"


def _total(values: Column) -> Column:
    """The double nearest to the sum of an array's v: what each addition rounds off is carried along, so that the order of the rows has no part in it."""

    def add(t: Column, p: Column) -> Column:
        s = t["s"] + p["v"]
        return F.struct(s.alias("s"), (t["off"] + F.when(F.abs(t["s"]) >= F.abs(p["v"]), (t["s"] - s) + p["v"]).otherwise((p["v"] - s) + t["s"])).alias("off"))

    none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("off"))
    return F.aggregate(F.sort_array(values), none, add, lambda t: F.nanvl(t["s"] + t["off"], t["s"]))


def gate_rows(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Per order: pages, characters, words, mean confidence of its pages, Devanagari share, cited orders, date flag, seconds a page.

    `pages` has (goid, page, text, words, mean_conf, seconds); orders without metadata keep their row.
    """
    letters = lambda p: F.regexp_count("text", F.lit(p))
    each = pages.select("goid", "page", "words", "mean_conf", "seconds", F.char_length("text").alias("chars"), letters(tx.DEVANAGARI).alias("dev"), letters("[A-Za-z]").alias("latin"), F.regexp_extract_all("text", F.lit(GATE_REF), F.lit(1)).alias("refs"), F.col("text").rlike(GATE_DATE).alias("dated"))
    # a tenth is that of ten times the mean, which makes a half of 7.9499999999999993
    total = lambda c: _total(F.collect_list(F.struct("page", F.coalesce(c, F.lit(0.0)).cast("double").alias("v"))))
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    per = each.groupBy("goid").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), tenth(total("mean_conf") / F.nullif(F.count("mean_conf"), F.lit(0))).alias("mean_conf"), F.count_if(F.col("mean_conf") < 70).alias("low_pages"),
        F.sum("mean_conf").alias("conf_sum"), F.count("mean_conf").alias("conf_pages"), F.coalesce(F.round(100 * F.sum("dev") / F.nullif(F.sum("dev") + F.sum("latin"), F.lit(0))), F.lit(0.0)).cast("int").alias("devanagari_pct"),
        F.bool_or("dated").alias("has_date_token"), tenth(total("seconds") / F.count(F.lit(1))).alias("secs_per_page"),
    )
    cited = each.select("goid", F.explode("refs").alias("ref")).distinct().groupBy("goid").agg(F.count(F.lit(1)).alias("go_refs_found"))
    return per.join(cited, "goid", "left").join(orders.select("goid", "go_date", "category", F.substring("subject", 1, 70).alias("subject")), "goid", "left").withColumn("go_refs_found", F.coalesce("go_refs_found", F.lit(0)))


def gate_totals(rows: DataFrame) -> DataFrame:
    """One row; the mean confidence is that of all pages."""
    return rows.agg(
        F.count(F.lit(1)).alias("orders"), F.sum("pages").alias("pages"), F.round(F.sum("conf_sum") / F.nullif(F.sum("conf_pages"), F.lit(0)), 1).alias("mean_conf"), F.sum("low_pages").alias("low_pages"),
        F.count_if(F.col("words") < 20).alias("empty"), F.count_if(F.col("devanagari_pct") >= 50).alias("devanagari"), F.count_if(F.col("go_refs_found") > 0).alias("with_refs"),
    )


def page_stats(words: DataFrame) -> DataFrame:
    """(goid, page, chars, words, devanagari_ratio, mean_conf, low_conf_words) from recognised words."""
    letters = r"\p{L}"
    counted = words.select("goid", "page", "conf", F.char_length("text").alias("len"), F.regexp_count("text", F.lit(tx.DEVANAGARI)).alias("dev"), F.regexp_count("text", F.lit(letters)).alias("alpha"))
    return counted.groupBy("goid", "page").agg(
        F.sum("len").alias("chars"), F.count(F.lit(1)).alias("words"), F.coalesce(F.round(F.sum("dev") / F.nullif(F.sum("alpha"), F.lit(0)), 3), F.lit(0.0)).alias("devanagari_ratio"),
        F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 1).alias("mean_conf"), F.count_if((F.col("conf") >= 0) & (F.col("conf") < 60)).alias("low_conf_words"),
    )


def batch_summary(pages: DataFrame) -> DataFrame:
    """Pages done, seconds, seconds a page."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.round(F.sum("seconds"), 1).alias("seconds"), F.round(F.sum("seconds") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("secs_per_page"))
