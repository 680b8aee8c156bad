"""Centroid clustering in exact integers, with Elkan's bounds carried from round to round.

Method: with every vector lie its cluster, an upper bound of the distance to its own centroid and a lower bound for every
centroid.  When centroids move, the bounds widen by the length of the move.  A vector is left alone while its upper bound
is below half the distance from its centroid to the next, and a centroid while the upper bound is below its lower bound or
below half the distance between the two centroids.  What is left is measured exactly.  Bounds are single precision, upper
ones rounded up and lower ones down, and only a strictly smaller bound rules out, so ties reach the exact comparison and go
to the smaller number.  Distances that decide or are returned are 64-bit integers.

A round is one narrow pass without a shuffle: a task reads vectors with their bounds, assigns, writes both for the next round,
and ends with one row of its sums a cluster; the driver gets k x (components + 1) totals.  A round's table goes
once the next one is written, so two exist at most, and a lost executor repeats its part of one round.

Defined cases: vectors that are null, of another length than `dim`, or with null or non-finite components take no part;
integers are held within LIMIT, so that squared distances fit 64 bits; equal hashes order by vector; a row with a null vec_id
is clustered but never starts a centroid before one with an id; repeated rows count each; fewer than k vectors give fewer
centroids, none an empty result; an empty cluster keeps its centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, stored, table

#: Integers are held within this, either way: 8,192 squared differences fit a long.
LIMIT = 2**24


def finite(v: Column) -> Column:
    """Whether an array of numbers has components, and all of them are finite."""
    sound = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & sound, F.lit(False))


def floors(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held within LIMIT."""
    bound = F.lit(float(LIMIT))
    return F.transform(v, lambda x: F.floor(F.greatest(-bound, F.least(bound, F.lit(float(scale)) * x.cast("double")))).cast("int"))


def integer_vectors(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding", dim: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(vec_id, v, ...): the vectors that take part, as arrays of int; `more` names further columns to carry."""
    v = F.col(f"`{embedding}`")
    sound = vectors.where(finite(v) if dim is None else finite(v) & (F.size(v) == dim))
    return sound.select(F.col(f"`{vec_id}`").alias("vec_id"), floors(v, scale).alias("v"), *[c.alias(n) for n, c in (more or {}).items()])


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def above(d: np.ndarray) -> np.ndarray:
    """Roots in single precision, not below the true ones."""
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def beneath(d: np.ndarray) -> np.ndarray:
    """Roots in single precision, not above the true ones."""
    return np.maximum(np.float32(0), np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(-np.inf)))


class Round:
    """Centroids of one round, half the distances between them, and how far each has moved since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        self.moved = np.zeros(k, np.float32) if before is None else np.where((before == centroids).all(axis=1), np.float32(0), above(squared(before, centroids)))
        self.half = np.stack([beneath(squared(centroids, centroids[j])) for j in range(k)], axis=1) / np.float32(2)
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(axis=1)
        np.fill_diagonal(self.half, 0)

    def widen(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, by = self.moved[own], np.float32(np.inf)
        upper = np.where(up > 0, np.nextafter(upper + up, by), upper)
        lower = np.where(self.moved > 0, np.maximum(np.float32(0), np.nextafter(lower - self.moved, -by)), lower)
        return upper, lower

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Moves rows to their nearest centroids, in place; returns the number of distances that were worked out."""
        rows = np.flatnonzero(upper >= self.near[own])
        may = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= self.half[own[rows]])
        may[np.arange(len(rows)), own[rows]] = False
        open_ = may.any(axis=1)
        rows, may = rows[open_], may[open_]
        at, best = own[rows], squared(x[rows], self.c[own[rows]])
        done, bound = len(rows), above(best)
        lower[rows, at] = beneath(best)
        for j in range(len(self.c)):
            some = np.flatnonzero(may[:, j])
            some = some[(bound[some] >= lower[rows[some], j]) & (bound[some] >= self.half[at[some], j])]
            d = squared(x[rows[some]], self.c[j])
            done += len(some)
            lower[rows[some], j] = beneath(d)
            nearer = (d < best[some]) | ((d == best[some]) & (j < at[some]))
            some, d = some[nearer], d[nearer]
            at[some], best[some], bound[some] = j, d, above(d)
        own[rows], upper[rows] = at, bound
        return done


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least sha256 of `<seed>:<vec_id>`, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(order.alias("order"), "v").orderBy(F.asc_nulls_last("order"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def passed(rows: DataFrame, now: Round, kind: str, last: bool) -> DataFrame:
    """One assignment: (vec_id, v, cluster, upper, lower) for the next round, or (vec_id, cluster, distance) of the last; and a row of sums a task."""
    k, dim = now.c.shape
    fields = [("cluster", pa.int32()), *([("distance", pa.int64())] if last else [("v", pa.list_(pa.int32())), ("upper", pa.float32()), ("lower", pa.list_(pa.float32()))])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, done, id_kind = np.zeros((k, 1 if last else dim + 1), np.int64), 0, None
        for b in batches:
            id_kind = b.column("vec_id").type
            x = rows_of(b.column("v"), dim)
            own, upper = b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy()
            lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            upper, lower = now.widen(own, upper, lower)
            done += now.assign(x, own, upper, lower)
            made = [b.column("vec_id"), pa.array(own.astype(np.int32))]
            if last:
                distance = squared(x, now.c[own])
                np.add.at(sums[:, 0], own, distance)
                made.append(pa.array(distance))
            else:
                for j in np.unique(own):
                    mine = own == j
                    sums[j, :dim] += x[mine].sum(axis=0)
                    sums[j, dim] += int(mine.sum())
                edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                made += [b.column("v"), pa.array(upper), pa.ListArray.from_arrays(edges, pa.array(lower.ravel()))]
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(b), pa.list_(pa.int64()))], names=["vec_id", *[n for n, _ in fields], "sums"])
        if id_kind is not None:
            total = pa.array([[*sums.ravel().tolist(), done]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), *[pa.nulls(1, t) for _, t in fields], total], names=["vec_id", *[n for n, _ in fields], "sums"])

    schema = f"vec_id {kind}, cluster int, {'distance long' if last else 'v array<int>, upper float, lower array<float>'}, sums array<long>"
    return rows.mapInArrow(run, schema)


def totals(state: DataFrame, n: int) -> np.ndarray:
    """The tasks' sums, added up: as many rows as one task sends, whatever the input."""
    rows = state.where("sums is not null").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(n, np.int64)
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def cluster(kept: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> tuple[DataFrame, dict]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), and the centroids and the distances worked out a round.

    `kept` has (vec_id, v) with arrays of int of one length.
    """
    spark, kind = kept.sparkSession, kept.schema["vec_id"].dataType.simpleString()
    c = first_centroids(kept, k, seed)
    names = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], names), {"centroids": c, "worked_out": []}
    k, dim = c.shape
    state = kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), F.array_repeat(F.lit(0).cast("float"), k).alias("lower"))
    before, worked, old = None, [], None
    for _ in range(rounds):
        state, path = stored(passed(state.select("vec_id", "v", "cluster", "upper", "lower"), Round(c, before), kind, False), "clusters")
        discard(spark, old)
        sums = totals(state, k * (dim + 1) + 1)
        worked.append(int(sums[-1]))
        by = sums[:-1].reshape(k, dim + 1)
        before, c = c, np.where(by[:, dim:] > 0, by[:, :dim] // np.maximum(1, by[:, dim:]), c)
        old, state = path, state.where("sums is null")
    final, _ = stored(passed(state.select("vec_id", "v", "cluster", "upper", "lower"), Round(c, before), kind, True), "clustered")
    discard(spark, old)
    sums = totals(final, k + 1)
    worked.append(int(sums[-1]))
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    # k rows, whatever the input
    known = spark.createDataFrame([(j, int(sums[j]), int(sums[:k].sum()), digest[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.where("sums is null").drop("sums").join(F.broadcast(known), "cluster").select(*[f.split()[0] for f in names.split(", ")]), {"centroids": c, "worked_out": worked}


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(integer_vectors(table(spark, sf_dir, "embeddings"), 1024, dim=64))[0]


def sql(k: int = 8, rounds: int = 10) -> str:
    """The same in DuckDB: every round measures every distance."""
    step = """
d{r} as (select vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept cross join c{r}),
a{r} as materialized (select * from d{r} qualify row_number() over (partition by vec_id order by d, j) = 1),"""
    mean = """
s{r} as (select j, i, sum(x)::bigint as s, count(*) as n from (select j, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by j, i),
m{r} as (select j, list((s - ((s % n) + n) % n) // n order by i) as c from s{r} group by j),
c{n} as materialized (select c{r}.j, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (j)),"""
    body = "".join((step + mean).format(r=r, n=r + 1) for r in range(rounds)) + step.format(r=rounds)
    return f"""
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int as j, v as c from kept qualify j < {k}),{body}
t as (select j, sum(d)::bigint as ci from a{rounds} group by j)
select vec_id, a{rounds}.j as cluster, d as distance, ci as cluster_inertia, (select sum(d)::bigint from a{rounds}) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join t using (j) join c{rounds} using (j)
"""


SQL = sql()
