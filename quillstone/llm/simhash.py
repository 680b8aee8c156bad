"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Method: generalised pigeonhole.  The bits are cut into m parts; if the thresholds of the parts plus one each add up to the
threshold plus one, two fingerprints within the threshold are within its own threshold in some part.  Bits that go together in
the corpus share a part, so that what is frequent is frequent in few parts.  Every fingerprint looks for others by itself:
for each part, the number of fingerprints within 0, 1, ... bits of it is estimated from counts of all fingerprints (cut
into units of bits whose tables have a fixed size), and dynamic programming shares the threshold out so that probes and
candidates cost least; a part may go without any (threshold -1).  m is the one with the least cost over all fingerprints.
Probes are all keys within the part's threshold; they meet the index of plain keys in a join that compares whole
fingerprints as it goes, so only links leave it.

Equal fingerprints are one class.  To keep families of copies from emitting all their pairs, classes first meet the class of
most documents under their plain keys, then whole neighbourhoods of those centres are probed, and last everything is
probed, each time only pairs of different components being let through.

Defined cases: words are runs of bytes outside 0x20 and 0x09-0x0D after A-Z became a-z; texts of fewer words than a shingle
are one shingle; null texts and texts without words have fingerprint 0, and are linked like any other; repeated rows are
linked; a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import U, table, written
from quillstone.llm.graph import components

BITS, WIDTH, DIFFER, SEED = 64, 4, 4, 42
#: What a comparison within a bucket costs, in probes that are sent; bits of a unit at most; shingles hashed at a time;
#: sums in a row.
COMPARE, UNIT, TOGETHER, SENT = 1 / 50, 11, 1 << 16, 64
#: Numbers of parts that are weighed against each other.
PARTS = (2, 3, 4, 5)

GAPS = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Bits that are set in over half the hashes of the shingles of a text in UTF-8, the highest first."""
    import xxhash

    flat = GAPS.sub(b" ", (text or b"").translate(LOWER)).strip(b" ")
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
    start, end = np.append(0, gaps + 1), np.append(gaps, len(flat))
    n = max(1, len(start) - width + 1)
    start, end = start[:n], end[-n:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, TOGETHER):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(start[lo : lo + TOGETHER].tolist(), end[lo : lo + TOGETHER].tolist(), strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit(fp: np.ndarray, place: int) -> np.ndarray:
    return (fp >> U(place)) & U(1)


def summed(rows: DataFrame, work, n: int) -> np.ndarray:
    """The sum over tasks of what `work` makes of a task's fingerprints: n numbers, sent in rows of SENT of them, those of zeros left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-n // SENT) * SENT, np.int64)
        for b in batches:
            total[:n] += work(b.column("fp").to_numpy().view(U))
        sent = total.reshape(-1, SENT)
        some = np.flatnonzero(sent.any(axis=1))
        edges = pa.array(np.arange(len(some) + 1, dtype=np.int32) * SENT)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(edges, pa.array(sent[some].ravel()))], names=["i", "s"])

    out = np.zeros((-(-n // SENT), SENT), np.int64)
    for r in rows.select("fp").mapInArrow(run, "i int, s array<long>").groupBy("i").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(SENT)]).alias("s")).collect():
        out[r["i"]] = r["s"]
    return out.ravel()[:n]


def set_together(fp: np.ndarray) -> np.ndarray:
    """How many fingerprints have both bits set, for every two bits."""
    b = np.stack([bit(fp, p) for p in range(BITS)]).astype(np.float64)
    return (b @ b.T).astype(np.int64).ravel()


def grouped(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of about equal size; each takes the two free bits that go together most, then what goes most with it."""
    both = both.reshape(BITS, BITS) / max(1, n)
    one = np.diag(both)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    with_ = np.abs(both - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(with_, 0)
    free, out = list(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        sub = with_[np.ix_(free, free)]
        group = [free[j] for j in np.unravel_index(int(sub.argmax()), sub.shape)]
        group = group if group[0] != group[1] else free[:2]
        while len(group) < size:
            left = [p for p in free if p not in group]
            group.append(left[int(with_[np.ix_(left, group)].sum(axis=1).argmax())])
        out.append(sorted(group))
        free = [p for p in free if p not in group]
    return out


class Plan:
    """Parts of the bits, and what a fingerprint pays for each threshold of each."""

    def __init__(self, parts: list[list[int]], differ: int = DIFFER):
        self.parts, self.differ = parts, differ
        self.masks = np.array([sum(1 << p for p in part) for part in parts], U)
        self.units = [[part[i::n] for i in range(n)] for part in parts for n in (-(-len(part) // UNIT),)]
        self.sizes = [2 ** len(u) for part in self.units for u in part]

    def values(self, fp: np.ndarray) -> list[np.ndarray]:
        """The number that each unit's bits make."""
        return [sum(bit(fp, p) << U(i) for i, p in enumerate(u)).astype(np.int64) for part in self.units for u in part]

    def counts(self, fp: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(v, minlength=n) for v, n in zip(self.values(fp), self.sizes, strict=True)])

    def know(self, counts: np.ndarray, n: int) -> None:
        """Shares of all fingerprints at 0 to `differ` bits from every value of a unit: each bit in turn stays or flips."""
        self.n, self.near, at = n, [], 0
        for size in self.sizes:
            d = np.zeros((size, self.differ + 1))
            d[:, 0] = counts[at : at + size] / max(1, n)
            b = 1
            while b < size:
                flipped = d[np.arange(size) ^ b]
                d[:, 1:] += flipped[:, :-1]
                b *= 2
            self.near.append(d.astype(np.float32))
            at += size

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprint, part, threshold + 1): probes sent, and comparisons expected."""
        values, out, at = self.values(fp), np.zeros((len(fp), len(self.parts), self.differ + 2)), 0
        for i, part in enumerate(self.units):
            within = self.near[at][values[at]]
            for k in range(at + 1, at + len(part)):
                more = self.near[k][values[k]]
                within = np.stack([sum(within[:, a] * more[:, d - a] for a in range(d + 1)) for d in range(self.differ + 1)], axis=1)
            at += len(part)
            probes = np.cumsum([comb(len(self.parts[i]), d) for d in range(self.differ + 1)])
            out[:, i, 1:] = probes + COMPARE * self.n * np.cumsum(within, axis=1)
        return out

    def allocate(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """threshold + 1 of every part, and the cost: the cheapest shares of differ + 1 in all."""
        costs, total = self.costs(fp), self.differ + 1
        best = np.full((len(fp), total + 1), np.inf)
        best[:, 0] = 0
        took = np.zeros((len(fp), len(self.parts), total + 1), np.int8)
        for i in range(len(self.parts)):
            new = best.copy()  # nothing for this part
            for s in range(1, total + 1):
                for here in range(1, s + 1):
                    offer = best[:, s - here] + costs[:, i, here]
                    less = offer < new[:, s]
                    new[less, s], took[less, i, s] = offer[less], here
            best = new
        share, left, rows = np.zeros((len(fp), len(self.parts)), np.int8), np.full(len(fp), total), np.arange(len(fp))
        for i in range(len(self.parts) - 1, -1, -1):
            share[:, i] = took[rows, i, left]
            left = left - share[:, i]
        return share, best[:, total]

    def flips(self, part: int, most: int) -> np.ndarray:
        """All ways to flip at most `most` bits of a part."""
        return np.array([sum(1 << p for p in some) for d in range(most + 1) for some in combinations(self.parts[part], d)], U)

    def probes(self, rows: DataFrame) -> DataFrame:
        """(part, key, fp, root): the keys that each of (fp, root) asks for."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flips: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                fp, root = b.column("fp").to_numpy().view(U), b.column("root").to_numpy()
                share, _ = self.allocate(fp)
                for i, s in {(i, int(s)) for i in range(len(self.parts)) for s in np.unique(share[:, i]) if s}:
                    if (i, s) not in flips:
                        flips[i, s] = self.flips(i, s - 1)
                    ways, at = flips[i, s], np.flatnonzero(share[:, i] == s)
                    step = max(1, 100_000 // len(ways))
                    for lo in range(0, len(at), step):
                        some = at[lo : lo + step]
                        key = ((fp[some] & self.masks[i])[:, None] ^ ways[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)), pa.array(np.repeat(fp[some], len(ways)).view(np.int64)), pa.array(np.repeat(root[some], len(ways)))],
                            names=["part", "key", "fp", "root"],
                        )

        return rows.select("fp", "root").mapInArrow(run, "part int, key long, fp long, root long")

    def index(self, rows: DataFrame) -> DataFrame:
        """(part, key, ...): the plain keys of every row of (fp, ...)."""
        keys = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("key")) for i, m in enumerate(self.masks)]
        return rows.select(F.explode(F.array(*keys)).alias("k"), *rows.columns).select("k.part", "k.key", *rows.columns)


def planned(classes: DataFrame, differ: int = DIFFER, parts: tuple[int, ...] = PARTS) -> Plan:
    """The plan of least cost; three scans of the distinct fingerprints, whose sums have a fixed size."""
    n = classes.count()
    both = summed(classes, set_together, BITS * BITS)
    plans = [Plan(grouped(both, n, m), differ) for m in parts]
    cuts = np.cumsum([0, *(sum(p.sizes) for p in plans)])
    counts = summed(classes, lambda fp: np.concatenate([p.counts(fp) for p in plans]), int(cuts[-1]))
    for p, a, b in zip(plans, cuts, cuts[1:], strict=False):
        p.know(counts[a:b], n)
    cost = summed(classes, lambda fp: np.array([np.ceil(p.allocate(fp)[1].sum()) for p in plans], np.int64), len(plans))
    return plans[int(cost.argmin())]


def within(a: str, b: str, differ: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= differ


def stars(plan: Plan, classes: DataFrame) -> DataFrame:
    """Links (a, b) of every class with the class of most documents under each of its plain keys."""
    keys = plan.index(classes.select("fp", "n"))
    leads = keys.groupBy("part", "key").agg(F.max(F.struct("n", "fp"))["fp"].alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    # a reread table has no partitioning, so that both sides are dealt anew and a key of many classes can be split
    met = keys.drop("n").join(written(leads, "leads"), ["part", "key"])
    return met.where((F.col("fp") != F.col("lead")) & within("fp", "lead", plan.differ)).select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct()


def near(plan: Plan, rows: DataFrame, index: DataFrame) -> DataFrame:
    """Links (a, b) between the components of `rows` and `index`, both (fp, root)."""
    held = plan.index(index.select(F.col("fp").alias("b"), F.col("root").alias("root_b"), "fp")).drop("fp")
    asked = plan.probes(rows).withColumnsRenamed({"fp": "a", "root": "root_a"})
    met = asked.join(held, ["part", "key"]).where((F.col("root_a") != F.col("root_b")) & within("a", "b", plan.differ))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(classes: DataFrame, differ: int = DIFFER) -> DataFrame:
    """(fp, root) of the fingerprints that have a link, from (fp, n): distinct ones with their numbers of documents."""
    plan = planned(classes, differ)
    links = written(stars(plan, classes), "links")

    def rooted() -> tuple[DataFrame, DataFrame]:
        roots = components(links).withColumnRenamed("node", "fp")
        # written, so that the planner broadcasts the centres only while they are small
        return roots, written(classes.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")

    roots, rows = rooted()
    centres = written(rows.join(links.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi"), "centres")
    for index in (centres, None):
        links = written(links.union(near(plan, rows, rows if index is None else index)), "links")
        roots, rows = rooted()
    return roots


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", differ: int = DIFFER) -> DataFrame:
    """(doc_id, fp, component_id): one row a document."""
    rows = written(fingerprints(docs, text, doc_id), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "classes")
    member = classes.join(linked(classes.select("fp", "n"), differ), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = written(member.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = written(member.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp")


def op13_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


# DuckDB has no XXH64: tests compare with a plain version.
