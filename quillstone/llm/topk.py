"""Exact top-k inner products by No-Random-Access aggregation over sorted component lists.

Method: every block of vectors has one list per component, sorted by value.  A query reads each list in sequence from its
good end (largest values for a positive weight, smallest for a negative one), to the depths STOPS or LATER.  What has been read adds to
a candidate's bounds: below, every unread component counts as its list's worst value, above, as the list's frontier;
a candidate not seen at all is bounded by the frontiers alone.  Reading stops for a query once at most a few candidates'
upper bounds reach the k-th best lower bound or the k-th best score of earlier blocks, and only these are resolved.  Queries of
a block read together, so an entry that is read serves all of them in one vector operation, and unread ones are not touched.

Large blocks of queries meet large blocks of vectors (`query_block`, `block`), so that neither side is repeated often; each
such pair keeps k rows a query, and a query's rows merge by rank.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different
length never meet; equal scores go to the smaller id; a query never meets rows with its own id; fewer than k
candidates give fewer rows; repeated rows of another id count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import table

#: Shares of the lists after which the bounds are compared, for queries without and with k scores from earlier blocks; vectors
#: that have lists of their own; queries that read together.
STOPS, LATER, LISTED, TOGETHER = (0.1, 0.6, 0.9, 1.0), (0.6, 0.75, 0.9, 1.0), 1024, 128


def integers(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long, for vectors whose components are all finite."""
    v = F.col(f"`{embedding}`")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(fit).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")).where("vec_id is not null")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


class SortedLists:
    """The component lists of one block of vectors; sums are exact in the number type chosen."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, most_query: int):
        bound = 4 * v.shape[1] * max(1, int(np.abs(v).max(initial=0))) * max(1, most_query)
        self.kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        self.whole, self.v, self.ids = v, v.astype(self.kind), ids
        self.order = np.argsort(v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, self.order, axis=0)
        #: Entries read so far, and entries that there were to read.
        self.read, self.there = 0, 0

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int, known: list) -> None:
        """Merges into `known`, of every query, its k best (-score, id)."""
        n, least = len(self.v), -float("inf") if self.kind is not object else -(2**200)
        up, down = np.maximum(queries, 0).astype(self.kind), np.minimum(queries, 0).astype(self.kind)
        low, high = self.sorted[0], self.sorted[-1]
        # lower bounds serve to find a k-th best; where earlier blocks have one, only upper bounds are read
        full = n < k or all(len(x) == k for x in known)
        open_, done = np.arange(len(queries)), 0
        lower = np.tile(up @ low + down @ high, (1 if full else n, 1))
        for depth in sorted({int(np.ceil(x * n)) for x in (LATER if full else STOPS)}):
            up_, down_ = up[open_], down[open_]
            front, back = self.sorted[n - depth], self.sorted[depth - 1]
            upper = np.tile(up_ @ front + down_ @ back, (n, 1))
            for j in range(queries.shape[1]):
                for w, read, fresh, frontier, worst in ((up_[:, j], slice(n - depth, n), slice(n - depth, n - done), front[j], low[j]), (down_[:, j], slice(0, depth), slice(done, depth), back[j], high[j])):
                    some = np.flatnonzero(w)
                    if not len(some):
                        continue
                    at, value, new = self.order[read, j], self.sorted[read, j], self.order[fresh, j]
                    upper[at] += (value - frontier)[:, None] * w
                    if not full:
                        lower[new] += (self.sorted[fresh, j] - worst)[:, None] * w
                    self.read += len(new) * len(some)
            own = self.ids[:, None] == query_ids[open_][None, :]
            upper[own] = least
            if full:
                reach = np.full(len(open_), least)
            else:
                lower[own] = least
                reach = np.partition(lower, n - k, axis=0)[n - k] if self.kind is not object else np.sort(lower, axis=0)[n - k]
            reach = np.array([max(r, -known[i][-1][0]) if len(known[i]) == k else r for i, r in zip(open_, reach, strict=True)])
            able = (upper >= reach) & ~own
            stop = (able.sum(axis=0) <= 4 * k) | (depth == n)
            for c in np.flatnonzero(stop):
                i, rows = open_[c], np.flatnonzero(able[:, c])
                score = self.v[rows] @ queries[i].astype(self.kind)
                known[i] = sorted([*known[i], *((-int(x), int(y)) for x, y in zip(score, self.ids[rows], strict=True))])[:k]
            self.there += int(stop.sum()) * n * queries.shape[1]
            open_, lower, done = open_[~stop], lower[:, ~stop], depth
            if not len(open_):
                break


def best(queries: np.ndarray, query_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[list], float]:
    """The k best (-score, id) of each query, ties to the smaller id, and the share of list entries read."""
    known: list[list] = [[] for _ in queries]
    most, read, there = int(np.abs(queries).max(initial=0)), 0, 0
    for a in range(0, len(v), LISTED):
        lists = SortedLists(v[a : a + LISTED], ids[a : a + LISTED], most)
        for b in range(0, len(queries), TOGETHER):
            part = known[b : b + TOGETHER]
            lists.best(queries[b : b + TOGETHER], query_ids[b : b + TOGETHER], k, part)
            known[b : b + TOGETHER] = part
        read, there = read + lists.read, there + lists.there
    return known, read / max(1, there)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score, from (vec_id, v) tables; `block` and `query_block` bound a task's memory."""
    n, m = vectors.count() // block + 1, queries.count() // query_block + 1
    deal = lambda df, own, other, parts, others: df.select("*", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))
    left, right = deal(queries, "qb", "vb", m, n), deal(vectors, "vb", "qb", n, m)

    def meet(key: tuple, qs: pa.Table, vs: pa.Table) -> pa.Table:
        qid, vid, rows = qs["vec_id"].to_numpy(), vs["vec_id"].to_numpy(), []
        if len(qid) and len(vid):
            dim = key[0].as_py()
            known, _ = best(matrix(qs["v"], dim), qid, matrix(vs["v"], dim), vid, k)
            rows = [(int(q), i, -s) for q, own in zip(qid, known, strict=True) for s, i in own]
        at = np.array(rows, dtype=np.int64).reshape(-1, 3)
        return pa.table({"query_id": pa.array(at[:, 0]), "vec_id": pa.array(at[:, 1]), "score": pa.array(at[:, 2])})

    met = left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
