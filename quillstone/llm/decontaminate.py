"""Benchmark decontamination by greedy string tiling.

Method: the Karp-Rabin hashes of all `tile`-word windows of the benchmark items are the seeds.  Documents are scanned
for seeds by running hashes; items whose words the seeds of a document could cover to `least` are tiled against it:
seeds, compared word by word, form maximal common passages on diagonals, the longest is marked in both texts, what
remains of overlapping ones goes back in line, and so on until nothing of `tile` words is left.  The marked share of the
item's words is its coverage, whatever the order of its passages in the document; an item covered to `least` makes
the document contaminated.

The benchmark's seeds are broadcast in slices of about `slice_items` items or `slice_bytes` bytes at most, one scan a
slice, so the broadcast is bounded and any number of items is matched.  A document's seeds are first counted once each, so a
common seed costs what the slice holds of it, and only then are the places of one item expanded, PAIRS at a time.

Defined cases: words are runs of ASCII letters, digits and all non-ASCII characters, A-Z lowered; null texts have
none; items without words match nothing; an item of fewer words than a tile must occur whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import carried, table, text_of
from quillstone.llm.text import LOWERCASE, PLAIN, U, slices, utf8, word_hashes, words

TILE, LEAST, SLICE, SLICE_BYTES, PAIRS = 4, 0.5, 20_000, 8_000_000, 1_000_000
PRIME, BASE = U(2**61 - 1), U(0x2F0B4C47)


def times_base(x: np.ndarray) -> np.ndarray:
    """x * BASE modulo 2^61 - 1, for x below it and BASE below 2^30."""
    high, low = (x >> U(31)) * BASE, (x & U(2**31 - 1)) * BASE
    out = (high >> U(30)) + ((high & U(2**30 - 1)) << U(31)) + (low >> U(61)) + (low & PRIME)
    out = (out & PRIME) + (out >> U(61))
    return np.where(out >= PRIME, out - PRIME, out)


def karp_rabin(words: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hashes of all runs of `width` words, by start."""
    n = max(0, len(words) - width + 1)
    x, out = words % PRIME, np.zeros(n, U)
    for j in range(width):
        out = times_base(out) + x[j : j + n]
        out = np.where(out >= PRIME, out - PRIME, out)
    return out


def joined(diagonal: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one diagonal that touch or overlap, as one."""
    order = np.lexsort((start, diagonal))
    diagonal, start, end = diagonal[order], start[order], end[order]
    new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (start[1:] > end[:-1])) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return diagonal[first], start[first], np.maximum.reduceat(end, first) if len(first) else end


def tiles(diagonal: np.ndarray, start: np.ndarray, end: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (document word - item word, document range): (document start, item start, length), longest first."""
    heap = [(a - b, a, a - d) for d, a, b in zip(diagonal.tolist(), start.tolist(), end.tolist(), strict=True)]
    heapq.heapify(heap)
    in_doc = np.zeros(int(end.max(initial=0)), bool)
    in_item = np.zeros(int((end - diagonal).max(initial=0)), bool)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        taken = in_doc[p : p - n] | in_item[q : q - n]
        if not taken.any():
            out.append((p, q, -n))
            in_doc[p : p - n] = in_item[q : q - n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ~taken, [0]]))).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] >= tile].tolist():  # what is left goes back, run by run
            heapq.heappush(heap, (a - b, p + a, q + a))
    return out


class Seeds:
    """Seeds of one slice of items: sorted hashes, each with its place in the items' words laid end to end."""

    def __init__(self, ids: list, texts: list[str | None], tile: int):
        buf, off = utf8(pa.array(texts, pa.string()))
        start, end, row = words(buf, off, PLAIN)
        self.word = word_hashes(LOWERCASE[buf], start, end)
        self.ids, self.at = ids, np.searchsorted(row, np.arange(len(off)))
        self.size, self.item = np.diff(self.at), row
        #: width -> (hashes, places)
        self.by: dict[int, tuple] = {}
        for width in sorted({min(tile, int(n)) for n in self.size if n}):
            own = np.flatnonzero(np.minimum(tile, self.size[row]) == width)
            s = own[own + width <= self.at[row[own] + 1]]
            h = karp_rabin(self.word, width)[s]
            order = np.lexsort((s, h))
            self.by[width] = (h[order], s[order])

    def able(self, width: int, first: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
        """Items of which the seeds from `first` on, `n` of each, could cover `least`."""
        place = np.sort(self.by[width][1][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
        item = self.item[place]
        step = np.full(len(place), width)
        same = item[1:] == item[:-1]
        step[:-1][same] = np.minimum(width, np.diff(place)[same])
        many, at = np.unique(item, return_inverse=True)
        return many[np.bincount(at, weights=step) >= least * self.size[many]]


def coverage(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", tile: int = TILE, least: float = LEAST, slice_items: int = SLICE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All columns of `docs` in `rest`, and hits: array of (item, covered) of the items covered to `least`."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), text_of(f"`{text}`").alias("text")).where("item_id is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(size["n"] // slice_items, size["bytes"] // slice_bytes) + 1
    found = None
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), text_of(f"`{text}`").alias("text"))
    hit = "array<struct<item:bigint,covered:double>>"
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").collect()  # about slice_items rows and slice_bytes bytes at most
        seeds = spark.sparkContext.broadcast(Seeds([r["item_id"] for r in rows], [r["text"] for r in rows], tile))

        def scan(batches, seeds=seeds):
            s = seeds.value
            for batch in batches:
                hits: list[list] = []
                buf, off = utf8(batch.column("text"))
                for lo, hi in slices(off):
                    hits += match(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], s, tile, least)
                kind = pa.list_(pa.struct([("item", pa.int64()), ("covered", pa.float64())]))
                yield pa.RecordBatch.from_arrays([carried(batch.column("rest")), batch.column("text"), pa.array(hits, kind)], names=["rest", "text", "found"])

        schema = f"rest {whole.schema['rest'].dataType.simpleString()}, text string, found {hit}"
        if found is None:
            found = whole.mapInArrow(scan, schema).withColumnRenamed("found", "hits")
        else:
            nested = found.select(F.struct("rest", "hits").alias("rest"), "text")
            schema = f"rest {nested.schema['rest'].dataType.simpleString()}, text string, found {hit}"
            found = nested.mapInArrow(scan, schema).select("rest.rest", "text", F.concat("rest.hits", "found").alias("hits"))
    return found.select("rest", "hits")


def match(buf: np.ndarray, off: np.ndarray, seeds: Seeds, tile: int, least: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    start, end, row = words(buf, off, PLAIN)
    word = word_hashes(LOWERCASE[buf], start, end)
    for width, (hashes, places) in seeds.by.items():
        h = karp_rabin(word, width)
        first = np.searchsorted(hashes, h)
        hit = (hashes[np.minimum(first, len(hashes) - 1)] == h) & (row[: len(h)] == row[width - 1 :][: len(h)])
        at = np.flatnonzero(hit)
        first = first[at]
        n = np.searchsorted(hashes, h[at], "right") - first
        cut = np.flatnonzero(np.append(True, np.diff(row[at]) != 0)) if len(at) else at
        for a, b in zip(cut.tolist(), np.append(cut, len(at))[1:].tolist(), strict=True):
            once, one = np.unique(first[a:b], return_index=True)
            for item in seeds.able(width, once, n[a:b][one], least).tolist():
                found = passages(word, at[a:b], seeds, item, width)
                marked = sum(t[2] for t in tiles(*found, width))
                if marked >= least * seeds.size[item]:
                    out[row[at[a]]].append({"item": int(seeds.ids[item]), "covered": marked / int(seeds.size[item])})
    return out


def passages(word: np.ndarray, at: np.ndarray, seeds: Seeds, item: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal common passages of an item and the document words around `at`, as (diagonal, start, end)."""
    own = seeds.word[seeds.at[item] : seeds.at[item + 1]]
    h = karp_rabin(own, width)
    order = np.argsort(h, kind="stable")
    mine = karp_rabin(word[at[0] : at[-1] + width], width)[at - at[0]]
    lo, hi = np.searchsorted(h[order], mine), np.searchsorted(h[order], mine, "right")
    n = hi - lo
    upto, found, i = np.cumsum(n), [], 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        k = n[i:j]
        p = np.repeat(at[i:j], k)
        q = order[np.repeat(lo[i:j] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        same = np.ones(len(p), bool)
        for x in range(width):  # words, not only their hash, must agree
            same &= word[p + x] == own[q + x]
        found.append(joined(p[same] - q[same], p[same], p[same] + width))
        i = j
    return joined(*(np.concatenate(x) for x in zip(*found, strict=True)))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that cover no item, in the columns of `docs`."""
    done = coverage(docs, benchmark).where(F.size("hits") == 0)
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    done = coverage(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select(
        F.col("rest.doc_id").alias("doc_id"), (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["covered"])), F.lit(0.0)).alias("covered"),
        F.array_sort(F.transform("hits", lambda x: x["item"])).alias("item_ids"),
    )
