"""Product codes of vectors, each part's nearest codebook entry found by vector-approximation cells.

Method: the entries of a part's codebook are approximated, one coordinate at a time: a coordinate's values are cut at equal
counts into 2^BITS cells, and a cell keeps its least and greatest value.  A query (one part of one vector) makes a lookup
table a coordinate, of the least and the greatest squared difference to anything in each cell; what an entry's cells
say adds up to a lower and an upper bound of its distance.  The least upper bound is within reach of some entry, so only entries
whose lower bound does not exceed it are measured, in whole numbers; the nearest wins, ties to the smaller index.
All bounds are integers, so nothing is lost to rounding.

Learning is a scan a round in which a task sends one row of sums an entry, added up before the driver takes the new codebooks
(parts x entries rows, whatever the input); coding is one more scan.  Errors of a label are added up first and joined back by
label, so a label that holds most rows is never gathered in one place.

Defined cases: vectors that are null, empty, or with null or non-finite components take no part, nor do vectors of another
length than that of the smallest vec_id's; a length that parts do not divide is filled up with zeros; integers are held
within LIMIT; rows without a vec_id are coded but start no codebook before those with one; repeated rows count each, and
order by vector among the first; fewer vectors than entries give smaller codebooks, none an empty result; entries that
nothing chose stay; a null label is a label of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.centroids import integer_vectors, rows_of
from quillstone.llm.common import table, written

#: Bits of a cell number, and queries that are bounded together.
BITS, TOGETHER = 4, 2048


class Cells:
    """One part's entries and their approximations."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        n, dim = entries.shape
        self.entries, cells = entries, min(n, 2**bits)
        self.cell = np.empty((dim, n), np.int64)
        self.low, self.high = np.empty((dim, cells), np.int64), np.empty((dim, cells), np.int64)
        for j in range(dim):
            order = np.argsort(entries[:, j], kind="stable")
            self.cell[j, order] = np.arange(n) * cells // n
            first = np.searchsorted(self.cell[j, order], np.arange(cells))
            self.low[j] = entries[order[first], j]
            self.high[j] = entries[order[np.append(first[1:], n) - 1], j]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance from every query to every entry."""
        least = most = 0
        for j in range(q.shape[1]):
            under, over = self.low[j] - q[:, j, None], q[:, j, None] - self.high[j]
            gap, far = np.maximum(np.maximum(under, over), 0), np.maximum(np.abs(under), np.abs(over))
            least = least + np.take(gap * gap, self.cell[j], axis=1)
            most = most + np.take(far * far, self.cell[j], axis=1)
        return least, most

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each query's nearest entry, its squared distance, and how many distances were worked out."""
        at, best, done = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), 0
        for lo in range(0, len(q), TOGETHER):
            part = q[lo : lo + TOGETHER]
            least, most = self.bounds(part)
            i, e = np.nonzero(least <= most.min(axis=1)[:, None])  # ascending in both, and every query has one at least
            d = part[i] - self.entries[e]
            d = np.einsum("ij,ij->i", d, d)
            low = np.minimum.reduceat(d, np.searchsorted(i, np.arange(len(part))))
            hit = np.flatnonzero(d == low[i])[::-1]
            at[lo + i[hit]] = e[hit]  # the smallest index is written last
            best[lo : lo + len(part)] = low
            done += len(d)
        return at, best, done


class Codebooks:
    """(parts, entries, components of a part) in whole numbers."""

    def __init__(self, entries: np.ndarray, length: int, bits: int = BITS):
        self.entries, self.length = entries, length
        self.cells = [Cells(part, bits) for part in entries]

    def parts(self, column: pa.Array) -> np.ndarray:
        v = rows_of(column, self.length)
        n, _, dim = self.entries.shape
        filled = np.zeros((len(v), n * dim), np.int64)
        filled[:, : self.length] = v
        return filled.reshape(len(v), n, dim)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry numbers (rows, parts), squared distances added up over the parts, and distances worked out."""
        code, error, done = np.zeros(x.shape[:2], np.int64), np.zeros(len(x), np.int64), 0
        for p, cells in enumerate(self.cells):
            code[:, p], best, n = cells.nearest(x[:, p])
            error += best
            done += n
        return code, error, done

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_codebooks(kept: DataFrame, entries: int, parts: int) -> Codebooks | None:
    """The parts of the vectors of least vec_id; they also fix the length."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    if first is None:
        return None
    rows = kept.where(F.size("v") == first["n"]).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    dim = -(-first["n"] // parts)
    v = np.zeros((len(rows), parts * dim), np.int64)
    v[:, : first["n"]] = np.array([r["v"] for r in rows], np.int64)
    return Codebooks(v.reshape(len(rows), parts, dim).transpose(1, 0, 2).copy(), first["n"])


def learnt(kept: DataFrame, books: Codebooks) -> tuple[Codebooks, int]:
    """Every entry moved to the floored mean of the parts that chose it; and the distances worked out."""
    parts, n, dim = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, done = np.zeros((parts * n + 1, dim + 1), np.int64), 0
        for b in batches:
            x = books.parts(b.column("v"))
            code, _, some = books.encode(x)
            done += some
            slot = (code + np.arange(parts) * n).ravel()
            for j in range(dim):
                # sums in halves that doubles hold exactly
                value = x[:, :, j].ravel()
                high, low = value >> 12, value & 4095
                sums[:-1, j] += np.bincount(slot, high, parts * n).astype(np.int64) * 4096 + np.bincount(slot, low, parts * n).astype(np.int64)
            sums[:-1, dim] += np.bincount(slot, minlength=parts * n)
        sums[-1, dim] = done
        used = np.flatnonzero(sums[:, dim])
        edges = pa.array(np.arange(len(used) + 1, dtype=np.int32) * (dim + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(edges, pa.array(sums[used].ravel()))], names=["slot", "s"])

    sent = kept.select("v").mapInArrow(run, "slot int, s array<long>")
    rows = sent.groupBy("slot").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(dim + 1)]).alias("s")).collect()  # parts x entries + 1 at most
    made, done = books.entries.reshape(parts * n, dim).copy(), 0
    for r in rows:
        if r["slot"] == parts * n:
            done = r["s"][dim]
        else:
            made[r["slot"]] = [s // r["s"][dim] for s in r["s"][:dim]]
    return Codebooks(made.reshape(parts, n, dim), books.length), done


def coded(kept: DataFrame, entries: int = 64, parts: int = 16, rounds: int = 2) -> tuple[DataFrame, dict]:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, v, label), and the codebooks and distances worked out a round.

    A code has two hex digits a part, so `entries` is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has room for 256 entries a part")
    spark, kind = kept.sparkSession, kept.schema["vec_id"].dataType.simpleString()
    books, worked = first_codebooks(kept, entries, parts), []
    if books is None:
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string"), {"codebooks": None, "worked_out": worked}
    kept = kept.where(F.size("v") == books.length)
    for _ in range(rounds):
        books, done = learnt(kept, books)
        worked.append(done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error, _ = books.encode(books.parts(b.column("v")))
            digits = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digits, pa.string()), pa.array(error), b.column("label")], names=["vec_id", "code", "error", "label"])

    rows = written(kept.select("vec_id", "v", "label").mapInArrow(run, f"vec_id {kind}, code string, error long, label {kept.schema['label'].dataType.simpleString()}"), "codes")
    # written, so that the planner knows its size: broadcast while it is small, else a join whose hot labels can be split
    errors = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(errors, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), {"codebooks": books, "worked_out": worked}


def label_of(vectors: DataFrame, label: str = "label") -> Column:
    return F.col(f"`{label}`") if label in vectors.columns else F.lit(None).cast("int")


def op12_vector_code_compression(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return coded(integer_vectors(vectors, 256, more={"label": label_of(vectors)}))[0]


def sql(entries: int = 64, parts: int = 16, rounds: int = 2) -> str:
    """The same in DuckDB: every part is measured against every entry of its codebook."""
    step = """
d{r} as (select vec_id, label, b.p, e, x, list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint as d from part join b{r} b using (p)),
a{r} as materialized (select * from d{r} qualify row_number() over (partition by vec_id, p order by d, e) = 1),"""
    mean = """
s{r} as (select p, e, i, sum(z)::bigint as s, count(*) as n from (select p, e, unnest(x) as z, generate_subscripts(x, 1) as i from a{r}) group by all),
m{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as y from s{r} group by p, e),
b{n} as materialized (select b.p, b.e, coalesce(m.y, b.y) as y from b{r} b left join m{r} m on m.p = b.p and m.e = b.e),"""
    body = "".join((step + mean).format(r=r, n=r + 1) for r in range(rounds)) + step.format(r=rounds)
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
part as materialized (select vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) r(p)),
b0 as materialized (select p, e, x as y from part join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {entries}) using (vec_id)),{body}
h as (select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) as digest from b{rounds}),
o as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id, label),
l as (select label, sum(error)::bigint as label_error from o group by label)
select vec_id, code, error, label_error, (select digest from h) as codebooks_sha256 from o join l on o.label is not distinct from l.label
"""


SQL = sql()
