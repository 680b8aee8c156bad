"""BM25 keyword search for batches of questions, by block-max pruning over the stored index.

From the greatest impact of every block of a question's words follows what each span of passages can score at most.
The spans of highest bound are scored first; of the others only those whose bound reaches the k-th score found
there.  Bounds are never below a true score, so what is left out could not have come among the k best.  The sum of many
words' bounds rules little out, so questions of more than LONG words are scored in one pass.  Places are read only for words of
several index tokens, whose phrases are counted first and then bounded and scored like other words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators.index import K1, PER_TASK, SPAN, TOGETHER, B, Index, build, gone, group_of, ids_of, impact, load, one, tasks_for, whole, widened  # noqa: F401
from quillstone.sources.stored import written

FLOOR = 1e-6
#: Spans that are scored before others are ruled out, terms that are named to the scan, and words of a question that is bounded.
FIRST, NAMED, LONG = 4, 200, 12
#: Question-posting pairs, and scores, that a task holds at once.
AT_ONCE = 1 << 21
#: What a bound may fall short of a score that adds the same numbers in another order, and of one that is rounded to nine digits.
SLACK = 1e-8


def phrases(questions: DataFrame, words: Column | None = None) -> DataFrame:
    """(qid, phrase, terms): each word of a question is a phrase of its index tokens; tokenless words vanish."""
    words = tx.query_words(F.col("question")) if words is None else words
    each = questions.select("qid", F.posexplode(words).alias("phrase", "word")).withColumn("terms", tx.index_tokens(F.col("word")))
    return each.where(F.size("terms") > 0).select("qid", "phrase", "terms")


class Lists:
    """What the words of a batch of questions find in an index: (qid, times, df) of each term, and counted phrases."""

    def __init__(self, index: Index, wanted: DataFrame):
        self.index = index
        few_spans = index.docs <= FIRST * SPAN  # nothing could be ruled out
        size = wanted.groupBy("qid").agg(((F.count(F.lit(1)) > LONG) | F.lit(few_spans)).alias("long"))
        wanted = written(wanted.join(size, "qid"))
        terms = wanted.select(F.explode("terms").alias("term")).distinct()
        few = [r[0] for r in terms.limit(NAMED + 1).collect()]
        # more words than that are in every folder, so their blocks are picked out in one pass and written for the passes that follow
        self.held = index.holding(few) if len(few) <= NAMED else index.blocks.join(written(terms), "term", "left_semi")
        self.blocks = self.held if len(few) <= NAMED else written(self.held.select("term", "span", "n", "most", "ids", "tfs", "dls", "segment"))
        kinds = wanted.agg(F.bool_or("long"), F.bool_or(~F.col("long")), F.bool_or(F.size("terms") > 1)).first()
        self.some_long, self.some_short, several = (bool(x) for x in kinds)
        df = index.frequencies(self.blocks.select("term", "n"))
        # written, so that the planner knows what they take and broadcasts them only while they are small
        self.single = written(wanted.where(F.size("terms") == 1).groupBy("qid", "long", F.col("terms")[0].alias("term")).agg(F.count(F.lit(1)).alias("times")).join(df, "term"))
        self.phrases = None
        if several:
            tf = written(self._phrases(wanted))
            self.phrases = tf.join(tf.groupBy("qid", "phrase").agg(F.count(F.lit(1)).alias("df")), ["qid", "phrase"])

    def _phrases(self, wanted: DataFrame) -> DataFrame:
        """(qid, long, phrase, chunk_id, dl, tf): starts at which all tokens of a phrase stand in a row."""
        several = written(wanted.where(F.size("terms") > 1).select("qid", "long", "phrase", F.size("terms").alias("m"), F.posexplode("terms").alias("off", "term")))
        posts = self.held.join(several.select("term").distinct(), "term", "left_semi").select("term", "segment", "span", "n", "ids", "tfs", "dls", "places")
        posts = self.index.live(posts.mapInArrow(_placed(SPAN), "term string, segment string, chunk_id long, dl int, pos int"))
        met = posts.join(several, "term").select("qid", "long", "phrase", "chunk_id", "m", "dl", "off", "pos")
        starts = met.groupBy("qid", "long", "phrase", "chunk_id", "dl", "m", (F.col("pos") - F.col("off")).alias("start")).agg(F.count(F.lit(1)).alias("hits")).where("hits = m")
        return starts.groupBy("qid", "long", "phrase", "chunk_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))

    def _weight(self) -> Column:
        idf = F.log((self.index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)

    def _part(self, times: Column | int) -> Column:
        """What tf occurrences in a passage of dl tokens add."""
        return times * self._weight() * impact(F.col("tf"), F.col("dl"), self.index.mean)

    def bounds(self) -> DataFrame:
        """(qid, span, bound) of short questions: no passage of the span scores higher."""
        # blocks of several segments may share a span; a passage lies in one of them, so the greatest bound holds
        blocks = self.blocks.groupBy("term", "span").agg(F.max(self.index.bound(F.col("most"), F.col("segment"))).alias("most"))
        found = blocks.join(self.single.where(~F.col("long")), "term").select("qid", "span", (F.col("times") * self._weight() * F.col("most")).alias("part"))
        if self.phrases is not None:
            each = self.phrases.where(~F.col("long")).select("qid", "phrase", F.expr(f"chunk_id div {SPAN}").alias("span"), self._part(F.lit(1)).alias("part"))
            found = found.union(each.groupBy("qid", "phrase", "span").agg(F.max("part").alias("part")).select("qid", "span", "part"))
        return found.groupBy("qid", "span").agg(F.sum("part").alias("bound"))

    def scores(self, spans: DataFrame | None, k: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, bm25), lower is better: of short questions in all spans that some question wants (qid, span), or of long ones everywhere.

        With `k` what cannot be among the k best of a question, of those in `only` if given, is left out.  Blocks are dealt by
        their spans, each once for all questions, and scored where they lie.
        """
        asked = self.single.where("long" if spans is None else ~F.col("long"))
        asked = asked.select("term", "qid", (F.col("times") * self._weight()).alias("w")).groupBy("term").agg(F.collect_list(F.struct("qid", "w")).alias("asked"))
        within = lambda df: df if spans is None else df.join(spans.select("span").distinct(), "span", "left_semi")
        tasks = tasks_for(self.index.spark, self.index.docs * self.index.mean, PER_TASK)
        blocks = within(self.blocks.select("term", "span", "segment", "n", "ids", "tfs", "dls")).withColumn("g", group_of("span", TOGETHER))
        # first dealt, then joined: the questions of a term are not sent with each of its blocks
        rows = blocks.repartition(tasks, "g").join(asked, "term").select("g", "segment", "span", "n", "ids", "tfs", "dls", F.col("asked.qid").alias("qids"), F.col("asked.w").alias("ws")).groupBy("g")
        none = lambda kind: F.lit(None).cast(kind)
        sides = []
        if self.index.state["removed"]:
            sides.append(self.index.removed.select("chunk_id", "segment", none("long").alias("qid"), none("double").alias("part")))
        if only is not None:
            sides.append(only.select("chunk_id", none("string").alias("segment"), none("long").alias("qid"), none("double").alias("part")))
        if self.phrases is not None:
            held = within(self.phrases.where("long" if spans is None else ~F.col("long")).withColumn("span", F.expr(f"chunk_id div {SPAN}")))
            sides.append(held.select("chunk_id", none("string").alias("segment"), "qid", self._part(F.lit(1)).alias("part")))
        score = _scored(self.index.mean, k, only is not None, SPAN)
        if not sides:
            return rows.applyInArrow(lambda rows: score(rows), SCORES)
        side = reduce(DataFrame.union, sides).withColumn("g", group_of(spans=TOGETHER)).repartition(tasks, "g").groupBy("g")
        return rows.cogroup(side).applyInArrow(lambda rows, side: score(rows, side), SCORES)

    def best(self, k: int, only: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, bm25, rank): the k best of every question, of those in `only` (chunk_id) if given."""
        kept = lambda spans: top(self.scores(spans, k, only), "bm25", k)
        self.spans = self.rest = None
        if not self.some_short:
            return kept(None)
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "span"))
        self.spans = written(self.bounds().withColumn("nth", nth))
        chosen = written(self.spans.where(F.col("nth") <= FIRST).select("qid", "span"))
        first = written(kept(chosen))
        reached = first.groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.max("bm25").alias("worst")).where(F.col("found") == k)
        rest = self.spans.join(chosen.select("span").distinct(), "span", "left_anti").join(reached, "qid", "left").where(F.col("worst").isNull() | (F.col("bound") >= -F.col("worst") - SLACK))
        self.rest = written(rest.select("qid", "span"))
        found = top(first.drop("rank").union(kept(self.rest).drop("rank")), "bm25", k)
        return found.union(kept(None)) if self.some_long else found


def _placed(span: int):
    """(term, segment, chunk_id, dl, pos) of blocks."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = whole(b["n"])
            ids, tfs, dls, places = ids_of(b, n, span), *(widened(b[c]) for c in ("tfs", "dls", "places"))
            block = pa.array(np.repeat(np.repeat(np.arange(len(n)), n), tfs))
            yield pa.RecordBatch.from_arrays([b["term"].take(block), b["segment"].take(block), pa.array(np.repeat(ids, tfs)), pa.array(np.repeat(dls, tfs).astype(np.int32)), pa.array(places.astype(np.int32))], ["term", "segment", "chunk_id", "dl", "pos"])

    return placed


SCORES = "qid long, chunk_id long, bm25 double"


def _scored(mean: float, k: int | None, restricted: bool, span: int):
    """Scores of the questions (qids, ws) of blocks' terms in one group of spans; `side` has removed and allowed passages and counted phrases."""

    def score(rows: pa.Table, side: pa.Table | None = None) -> pa.Table:
        n = whole(rows["n"])
        ids, tfs, dls = ids_of(rows, n, span), widened(rows["tfs"]), widened(rows["dls"])
        part = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * dls / (mean or 1.0)))
        begin = np.cumsum(n) - n
        m = pc.list_value_length(one(rows["qids"])).to_numpy(zero_copy_only=False).astype(np.int64)
        # an entry is a question and a block, or a question and a phrase's passage
        qids, ws, row = pc.list_flatten(one(rows["qids"])).to_numpy(), pc.list_flatten(one(rows["ws"])).to_numpy(), np.repeat(np.arange(len(n)), m)
        first, count = begin[row], n[row]
        allowed = None
        if side is not None:
            named, counted = one(side["segment"]).is_valid().to_numpy(zero_copy_only=False), one(side["qid"]).is_valid().to_numpy(zero_copy_only=False)
            part[gone(rows, n, ids, side.filter(pa.array(named)))] = 0.0
            allowed = side["chunk_id"].to_numpy()[~named & ~counted] if restricted else None
            held = side.filter(pa.array(counted))
            qids, ws = np.append(qids, held["qid"].to_numpy()), np.append(ws, np.ones(len(held)))
            first, count = np.append(first, len(ids) + np.arange(len(held))), np.append(count, np.ones(len(held), np.int64))
            ids, part = np.append(ids, held["chunk_id"].to_numpy()), np.append(part, held["part"].to_numpy())
        found = []
        if len(qids) and len(ids):
            low = ids.min()
            wide, at = int(ids.max() - low) + 1, ids - low
            barred = np.zeros(wide, bool)
            if allowed is not None:
                barred[:] = True
                barred[allowed[(allowed >= low) & (allowed < low + wide)] - low] = False
            order = np.argsort(qids, kind="stable")
            qids, ws, first, count = qids[order], ws[order], first[order], count[order]
            known, code = np.unique(qids, return_inverse=True)
            size = np.cumsum(count)
            lo = 0
            while lo < len(qids):  # some questions at a time, whole
                hi = max(int(np.searchsorted(size, size[lo] - count[lo] + AT_ONCE)), lo + 1)
                hi = min(hi, int(np.searchsorted(code, code[lo] + max(1, AT_ONCE // wide))))
                hi = int(np.searchsorted(code, code[hi - 1], "right")) if code[hi - 1] == code[lo] else int(np.searchsorted(code, code[hi])) if hi < len(code) else hi
                c = count[lo:hi]
                post = np.repeat(first[lo:hi] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                q0, nq = code[lo], code[hi - 1] - code[lo] + 1
                s = np.bincount(np.repeat(code[lo:hi] - q0, c) * wide + at[post], np.repeat(ws[lo:hi], c) * part[post], nq * wide).reshape(nq, wide)
                s[:, barred] = 0.0
                qi, ci = np.nonzero(s if k is None else _kept(s, k))
                found.append((known[q0 + qi], low + ci, -s[qi, ci]))
                lo = hi
        q, c, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"qid": pa.array(q, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "bm25": pa.array(b, pa.float64())})

    return score


def _kept(s: np.ndarray, k: int) -> np.ndarray:
    """Which scores of each row can be among the k best by nine digits and then by column; zeros are none."""
    r = np.round(s, 9)
    kept = np.zeros(s.shape, bool)
    best = np.argsort(-r, axis=1, kind="stable")[:, :k]
    np.put_along_axis(kept, best, True, axis=1)
    # a half in the tenth digit may be rounded either way elsewhere: then all near the k-th stay
    worst = np.take_along_axis(r, best[:, -1:], axis=1)
    near = np.abs(r - worst) < 1.5e-9
    halves = (near & (np.abs(s * 1e9 % 1 - 0.5) < 1e-3)).any(axis=1, keepdims=True)
    return (kept | (near & halves)) & (s > 0)


def top(scores: DataFrame, value: str, k: int, rank: str = "rank", descending: bool = False) -> DataFrame:
    """The k best rows a question; nine digits decide, then the passage id."""
    by = F.round(value, 9)
    order = Window.partitionBy("qid").orderBy(by.desc() if descending else by, "chunk_id")
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def allowed(passages: DataFrame, orders: DataFrame, predicate: Column) -> DataFrame:
    """chunk_id of the passages whose order passes the filters."""
    return passages.select("chunk_id", "goid").join(orders.where(predicate).select("goid"), "goid", "left_semi").select("chunk_id")


def keyword_search(index: Index, questions: DataFrame, k: int = 50, only: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, bm25, rank)."""
    return Lists(index, phrases(questions)).best(k, only)


def phonetic_index(passages: DataFrame, roman=lambda c: c, folder: str | None = None) -> Index:
    """An index of phonetic keys; `roman` turns other scripts into Latin letters."""
    return build(passages, tx.phonetic_tokens(roman(F.col("text"))), folder)


def phonetic_search(index: Index, questions: DataFrame, k: int = 50, roman=lambda c: c, only: DataFrame | None = None) -> DataFrame:
    """Keyword search over phonetic keys."""
    return Lists(index, phrases(questions, tx.phonetic_tokens(roman(F.col("question"))))).best(k, only)
