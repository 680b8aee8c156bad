"""Exact inner-product search for batches of query vectors, with cells that cannot matter left out.

Vectors lie in cells, each with its nearest of a bounded number of pivots, and a cell knows its radius: no vector of it is
farther from the pivot.  For a query q, no vector of the cell scores more than q.pivot + |q| * radius, whatever the lengths
of vectors.  The cells of highest bound, until they hold enough vectors, give every query a k-th score; of the rest only cells
whose bound reaches it are met.  Under filters, cells are counted, bounded and met by the vectors that pass, so the answer stays
exact.  Queries and cells meet by join; a cell of many vectors, or one that many queries need, is dealt to several blocks.

How much is left out depends on the vectors: much where they lie in families, next to nothing where all directions are alike.
A table that has not been dealt to cells is scanned instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.keyword import top
from quillstone.sources.stored import written

#: Vectors of a block, queries of a block or of a scan that they are sent to, and pivots of a length at most.
BLOCK, ASKED, PIVOTS = 4096, 2048, 256
#: What rounding may take from a bound or give to a score, for each unit of the lengths' product.
SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class Cells:
    """(chunk_id, embedding, dim, cell, blk, far) of all vectors; by length the pivots, PIVOTS rows at most; and the blocks of each cell."""

    vectors: DataFrame
    pivots: dict[int, np.ndarray]
    blocks: dict[tuple[int, int], int]


def cells(vectors: DataFrame, pivots: int = PIVOTS) -> Cells:
    """Deals vectors (chunk_id, embedding) to cells.

    Pivots are the vectors of least hash, about the square root of their number and `pivots` at most of each length, so any
    collection has some; which vectors they are has no influence on results, only on how much is left out.
    """
    rows = vectors.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        most = min(pivots, int(np.ceil(np.sqrt(n))))
        # the least hashes come first without a sort of the whole
        found = rows.where(F.col("dim") == dim).withColumn("draw", F.xxhash64("chunk_id")).orderBy("draw", "chunk_id").limit(most).collect()
        chosen[dim] = np.array([r["embedding"] for r in found], np.float64).reshape(len(found), dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([b]).filter(pa.array(dims == dim))
                v, p = _matrix(part["embedding"]), chosen[int(dim)]
                square = (v * v).sum(axis=1)[:, None] - 2 * v @ p.T + (p * p).sum(axis=1)[None, :]
                cell = square.argmin(axis=1)
                far = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part[c].combine_chunks() for c in ("chunk_id", "embedding", "dim")] + [pa.array(cell.astype(np.int32)), pa.array(far)], names=["chunk_id", "embedding", "dim", "cell", "far"])

    made = written(rows.mapInArrow(deal, "chunk_id long, embedding array<double>, dim int, cell int, far double"))
    # cells of many vectors are dealt to blocks by hash
    blocks = {(r["dim"], r["cell"]): r["n"] // BLOCK + 1 for r in made.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    held = vectors.sparkSession.createDataFrame([(*at, n) for at, n in blocks.items()], "dim int, cell int, blocks int")
    dealt = made.join(F.broadcast(held), ["dim", "cell"]).withColumn("blk", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")).drop("blocks")
    return Cells(dealt, chosen, blocks)


def _bounds(made: Cells, queries: DataFrame, radii: dict[tuple[int, int], tuple[float, int]]) -> DataFrame:
    """(qid, dim, cell, n, blocks, bound): what a vector of each cell can score at most."""
    pivots, blocks = made.pivots, made.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                q = _matrix(b.column("embedding").slice(i, 1))[0]
                known = [c for c in range(len(pivots.get(len(q), ()))) if (len(q), c) in radii]
                if known:
                    radius, n = np.array([radii[len(q), c] for c in known]).T
                    size = np.sqrt(q @ q)
                    bound = pivots[len(q)][known] @ q + size * radius
                    bound = bound + SLACK * (1 + np.abs(bound) + size * radius)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column("qid")[i].as_py()] * len(known), pa.int64()), pa.array(np.full(len(known), len(q), np.int32)), pa.array(np.array(known, np.int32)), pa.array(n.astype(np.int64)), pa.array([blocks[len(q), c] for c in known], pa.int32()), pa.array(bound)],
                        names=["qid", "dim", "cell", "n", "blocks", "bound"],
                    )

    return queries.mapInArrow(run, "qid long, dim int, cell int, n long, blocks int, bound double")


def _met(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, k: int, parts: int) -> DataFrame:
    """(qid, chunk_id, cosine): the k best vectors of each cell's block for the queries that are paired with the cell, in `parts` parts."""
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part")
    asked = pairs.join(queries, "qid").select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), part, "qid", "embedding")
    by = ["dim", "cell", "blk", "part"]
    held = vectors.select("dim", "cell", "blk", "chunk_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = left["qid"].to_numpy(), right["chunk_id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(qid) and len(ids):
            v = _matrix(right["embedding"])
            for lo in range(0, len(qid), 512):
                score = _matrix(left["embedding"].slice(lo, 512)) @ v.T
                order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                out.append((np.repeat(qid[lo : lo + 512], order.shape[1]), ids[order].ravel(), np.take_along_axis(score, order, axis=1).ravel()))
        whole = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("qid", "chunk_id", "cosine"), map(pa.array, whole), strict=True)))

    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, "qid long, chunk_id long, cosine double")


class Search:
    """One batch of queries (qid, embedding) against cells, of the vectors in `only` (chunk_id) if given."""

    def __init__(self, made: Cells, queries: DataFrame, k: int, only: DataFrame | None = None):
        self.vectors = made.vectors if only is None else made.vectors.join(only, "chunk_id", "left_semi")
        self.queries = written(_asked(queries))
        parts = self.queries.count() // ASKED + 1
        # a row a cell, of which there are PIVOTS at most for each length
        radii = {(r["dim"], r["cell"]): (r["far"], r["n"]) for r in self.vectors.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
        upto = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1))
        self.pairs = written(_bounds(made, self.queries, radii).withColumn("before", F.coalesce(upto, F.lit(0))))
        self.first = self.pairs.where(F.col("before") < k)
        found = written(top(_met(self.vectors, self.queries, self.first, k, parts), "cosine", k, descending=True).drop("rank"))
        reached = found.groupBy("qid").agg(F.count(F.lit(1)).alias("held"), F.min("cosine").alias("worst")).where(F.col("held") == k)
        rest = self.pairs.where(F.col("before") >= k).join(reached, "qid", "left").where(F.col("worst").isNull() | (F.round("bound", 9) >= F.round("worst", 9)))
        self.rest = written(rest.select("qid", "dim", "cell", "blocks"))
        self.best = top(found.union(_met(self.vectors, self.queries, self.rest, k, parts)), "cosine", k, descending=True)

    def skipped(self) -> float:
        """The share of pairs of queries and vectors that were not met."""
        whole = self.pairs.agg(F.sum("n")).first()[0] or 0
        met = (self.first.agg(F.sum("n")).first()[0] or 0) + (self.pairs.join(self.rest, ["qid", "dim", "cell"], "left_semi").agg(F.sum("n")).first()[0] or 0)
        return 1 - met / max(1, whole)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("embedding is not null").select("qid", F.col("embedding").cast("array<double>").alias("embedding"))


def _scan(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, cosine) of all vectors: the k best of each batch of a scan that ASKED queries at most are sent to, or of each block."""
    rows = vectors.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = written(_asked(queries))
    few = queries.limit(ASKED + 1).collect()  # ASKED rows, whatever the input
    if len(few) > ASKED:
        blocks, parts = rows.count() // BLOCK + 1, queries.count() // ASKED + 1
        dealt = rows.select("*", F.size("embedding").alias("dim"), F.lit(0).alias("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("blk"))
        return _met(dealt, queries, queries.select("qid", F.size("embedding").alias("dim"), F.lit(0).alias("cell"), F.lit(blocks).alias("blocks")), k, parts)
    by: dict[int, tuple] = {}
    for dim in {len(r["embedding"]) for r in few}:
        own = [r for r in few if len(r["embedding"]) == dim]
        by[dim] = np.array([r["embedding"] for r in own], np.float64).reshape(len(own), dim), np.array([r["qid"] for r in own], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("embedding").offsets.to_numpy())
            for dim in set(np.unique(size).tolist()) & set(by):
                part = pa.Table.from_batches([b]).filter(pa.array(size == dim))
                (q, qid), ids = by[dim], part["chunk_id"].to_numpy()
                score = q @ _matrix(part["embedding"]).T
                order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(score, order, axis=1).ravel())], names=["qid", "chunk_id", "cosine"]
                )

    return rows.mapInArrow(scan, "qid long, chunk_id long, cosine double")


def vector_search(vectors: DataFrame | Cells, queries: DataFrame, k: int = 50, only: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, cosine, rank) from vectors (chunk_id, embedding), or their cells, and queries (qid, embedding).

    Vectors and queries of different length never meet; null ones take no part; equal scores go to the smaller chunk_id.
    """
    if isinstance(vectors, Cells):
        return Search(vectors, queries, k, only).best
    return top(_scan(vectors if only is None else vectors.join(only, "chunk_id", "left_semi"), queries, k), "cosine", k, descending=True)
