"""Rank fusion, duplicate collapse, per-order caps and presentation of search results."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.sources.stored import written

K = 60


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of (qid, chunk_id, rank, ...) tables, cut to 10 * limit rows a question.

    Gives score, place, and for every channel its rank and what else it has, such as bm25 or cosine; equal scores keep
    the order of the channels and their ranks.
    """
    weights = weights or {}
    names = list(channels)
    own = {n: [c for c in df.columns if c in ("bm25", "cosine") and n != "phonetic"] for n, df in channels.items()}
    kept = [c for cs in own.values() for c in cs]
    parts = [df.select("qid", "chunk_id", *own[name], *[(F.col("rank") if n == name else F.lit(None).cast("int")).alias(f"rank_{n}") for n in names]) for name, df in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    ranks = union.groupBy("qid", "chunk_id").agg(*[F.min(f"rank_{n}").alias(f"rank_{n}") for n in names], *[F.first(c, ignorenulls=True).alias(c) for c in kept])
    score = sum((F.coalesce(weights.get(n, 1.0) / (K + F.col(f"rank_{n}")), F.lit(0.0)) for n in names), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), *[F.col(f"rank_{n}").asc_nulls_last() for n in names])
    return ranks.withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= 10 * limit)


def hydrate(fused: DataFrame, passages: DataFrame, orders: DataFrame) -> DataFrame:
    """Passage and order columns for ranked ids; ids without an order are dropped."""
    return fused.join(passages, "chunk_id").join(orders, "goid")


def diversify(rows: DataFrame, limit: int = 10, per_order: int | None = 2) -> DataFrame:
    """In order of place: one row per (order number, page), at most `per_order` per order, `limit` in all.

    Rows without an order number share the empty number for pages, but are capped by their own goid; a capped row does
    not claim its page.  At most 10 * limit rows a question meet in one group, so the fold is bounded.
    """
    keys = rows.select("qid", "chunk_id", "place", "page", tx.number_key(F.col("go_no")).alias("number"), F.col("goid").cast("string").alias("own"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        pages, counts, kept = set(), {}, []
        for r in part.sort_values("place").itertuples(index=False):
            order = r.number or r.own
            if (r.number, r.page) in pages or (per_order and counts.get(order, 0) >= per_order):
                continue
            pages.add((r.number, r.page))
            counts[order] = counts.get(order, 0) + 1
            kept.append((r.qid, r.chunk_id, len(kept) + 1))
            if len(kept) == limit:
                break
        return pd.DataFrame(kept, columns=["qid", "chunk_id", "position"])

    return rows.join(keys.groupBy("qid").applyInPandas(fold, "qid long, chunk_id long, position int"), ["qid", "chunk_id"])


def decorate(rows: DataFrame, channels: list[str]) -> DataFrame:
    """score, bm25 and cosine rounded, lexical_coverage, and matched_by."""
    by = F.concat_ws("+", *[F.when(F.col(f"rank_{n}").isNotNull(), n) for n in channels])
    return rows.withColumns({
        "score": F.round("score", 5), "bm25": F.round("bm25", 3), "cosine": F.round("cosine", 4),
        "lexical_coverage": tx.coverage(F.col("question"), F.col("text")), "matched_by": F.when(by == "", "none").otherwise(by),
    })


def expand_subjects(results: DataFrame, passages: DataFrame, limit: int = 6, per_subject: int = 2) -> DataFrame:
    """Subject hits give way to the first body passages of their order; results have qid, chunk_id, goid, kind, score, position."""
    first = Window.partitionBy("goid").orderBy("page", "ord")
    bodies = passages.where("kind = 'ocr'").withColumn("i", F.row_number().over(first) - 1).where(F.col("i") < per_subject)
    bodies = bodies.select("goid", F.col("chunk_id").alias("body_id"), "i")
    swapped = results.join(bodies, (results["goid"] == bodies["goid"]) & (results["kind"] == "subject"), "left").select(
        results["qid"], F.coalesce("body_id", results["chunk_id"]).alias("chunk_id"), results["goid"],
        (results["score"] - F.coalesce("i", F.lit(0)) * 1e-6).alias("score"), results["position"], F.coalesce("i", F.lit(0)).alias("i"),
        F.when(F.col("body_id").isNotNull(), "via subject").otherwise(results["matched_by"]).alias("matched_by"),
    )
    seen = Window.partitionBy("qid", "chunk_id").orderBy("position", "i")
    best = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "position", "i")
    once = swapped.withColumn("nth", F.row_number().over(seen)).where("nth = 1")
    return once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("qid", "place", "chunk_id", "goid", "score", "matched_by")


def _dated(df: DataFrame) -> DataFrame:
    """With `day`, the date as a number of days; null if it is none."""
    d = F.coalesce("go_date_iso", F.lit("2000-01-01"))
    part = lambda a, n: d.substr(a, n).try_cast("int")
    first = F.make_date(part(1, 4), part(6, 2), F.lit(1))
    return df.withColumn("day", F.when(part(9, 2).between(1, 31) & part(6, 2).between(1, 12), F.unix_date(F.date_add(first, part(9, 2) - 1))))


def related(orders: DataFrame, of: DataFrame, limit: int = 5, salts: int = 16) -> DataFrame:
    """(goid, related_goid, gap, place): orders of the same category or section, nearest in time first.

    Only indexed orders are candidates; order numbers equal to the queried one's are left out, and of equal numbers the
    nearest of 4 * limit stays.  Of a day's orders of one category or section no query needs more than its own 4 * limit first
    ones, whatever number it leaves out; so `_firsts` of every day are kept, and a query meets those of the days around its
    own.  Queries that find too few there look four times as far, until the days end.  `salts` spread the orders of one day.
    """
    enough = 4 * limit
    shared = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("category", "section")])).alias("s")
    each = lambda df, *own: _dated(df).select(*own, F.coalesce("go_no", F.lit("")).alias("no"), "day", shared).select("*", "s.by", "s.value").drop("s").where("value is not null")
    c = written(each(orders.where("ocr_ok = 1"), "goid"))
    q = written(each(of, F.col("goid").alias("q_goid")).withColumnRenamed("no", "q_no").withColumnRenamed("day", "q_day"))
    days = written(_firsts(c, ["by", "value", "day"], enough, salts))
    undated = days.where("day is null").drop("day")
    ends = days.agg(F.min("day"), F.max("day")).first()
    around = q.where("q_day is not null").agg(F.min("q_day"), F.max("q_day")).first()

    def met(pairs: DataFrame, day) -> DataFrame:
        gap = F.abs(F.datediff(F.date_from_unix_date(day), F.date_from_unix_date(F.col("q_day"))))
        return pairs.where("goid <> q_goid and no <> q_no").select("q_goid", "goid", "no", gap.alias("gap")).distinct()

    near = Window.partitionBy("q_goid").orderBy(F.col("gap").asc_nulls_first(), "goid")
    first = lambda df: df.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= enough)
    none = F.lit(None).cast("int")
    # a query without a date has no gaps, and an order without one none to any query
    lost = q.where("q_day is null")
    found = [written(first(met(lost.join(_firsts(c, ["by", "value"], enough, salts), ["by", "value"]), none)))]
    dated, reach = q.where("q_day is not null"), 1
    farthest = max(abs(a - b) for a in ends for b in around) if ends[0] is not None and around[0] is not None else 0
    while True:
        spread = dated.select("*", F.explode(F.sequence(F.expr(f"q_day div {reach} - 1"), F.expr(f"q_day div {reach} + 1"))).alias("around"))
        pairs = met(spread.join(days.where("day is not null").withColumn("around", F.expr(f"day div {reach}")), ["by", "value", "around"]).where(F.abs(F.col("day") - F.col("q_day")) <= reach), F.col("day").cast("int"))
        some = written(first(pairs.union(met(dated.join(undated, ["by", "value"]), none))))
        if reach >= farthest:
            found.append(some)
            break
        full = written(some.groupBy("q_goid").count().where(F.col("count") == enough).select("q_goid"))
        found.append(some.join(full, "q_goid", "left_semi"))
        dated, reach = written(dated.join(full, "q_goid", "left_anti")), reach * 4
        if dated.isEmpty():
            break
    numbered = reduce(DataFrame.union, found).withColumn("number", tx.number_key(F.col("no")))
    once = numbered.withColumn("copy", F.row_number().over(Window.partitionBy("q_goid", "number").orderBy("nth"))).where("copy = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("q_goid").orderBy("nth"))).where(F.col("place") <= limit).select(F.col("q_goid").alias("goid"), F.col("goid").alias("related_goid"), "gap", "place")


def _firsts(rows: DataFrame, group: list[str], enough: int, salts: int) -> DataFrame:
    """The rows of each group that can be among a query's `enough` first ones by goid, if it leaves out itself and one number.

    A number's rows behind its first enough + 1 are not: a query that allows them allows those, but for itself.  Of what is left
    a query leaves out enough + 2 at most.
    """
    salt = F.pmod(F.xxhash64("goid"), F.lit(salts))

    def cut(df: DataFrame, by: list, most: int) -> DataFrame:
        for keys in ([*by, "salt"], by):  # what is behind the most of a part is behind the most of the whole
            df = df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("goid"))).where(F.col("r") <= most)
        return df.drop("r")

    return cut(cut(rows.withColumn("salt", salt), [*group, "no"], enough + 1), group, 2 * enough + 3).drop("salt")
