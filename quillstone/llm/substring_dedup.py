"""Substring deduplication over a log-structured index of word-window fingerprints.

A window is `width` consecutive words of one document, its fingerprint the least hash of its 8-word grams.  Neighbours
mostly share the gram, and such a run of windows adds one fingerprint (about 7 windows in 100 do).  The index holds
immutable Parquet runs of (fingerprint, block, n), each bucketed and sorted by fingerprint, so a new batch is dealt and
sorted once and merge-joined with the runs before it without moving them; when `fanout` runs have gathered, they are
merged into one.  The join yields the fingerprints that have become shared.  The words around these are then compared
themselves, so sharing a gram or a hash removes nothing.  An index that the caller gives also keeps the texts of its
loads: of earlier loads the blocks that hold a fingerprint of the new one send their words again, so a new window equal
to an old one is found.

Defined cases: words are runs of bytes outside 0x20 and 0x09-0x0D, unchanged; null and empty texts have none; texts
of fewer words than a window lose none; a text that occurs twice loses all its words in both places.  What an earlier
call returned is not changed by a later one; a load given again meets itself as history.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.anchors import SHIPPED, Runs, settled, tied_words
from quillstone.llm.common import carried, durable, in_blocks, in_order, scratch, table
from quillstone.llm.text import grams, slices, utf8, word_hashes, words

GRAM = 8
RUN = "fp long, blk long, n long"
TEXTS = "blk long, row long, text string"
STATE = "loads long, width long, bytes long, parts int, runs array<string>, texts array<string>"
#: Bytes of words around its fingerprints that a bucket is meant to hold.
BUCKET_BYTES = 1_000_000
#: A block's number within its load has so many bits; the load's number stands above them.
BLOCK_BITS = 40


class Windows:
    """Word windows of consecutive rows, in runs that hang on the same gram."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, width: int):
        self.buf, self.off, self.width = buf, off, width
        self.start, self.end, self.row = words(buf, off)
        self.runs = Runs(grams(word_hashes(buf, self.start, self.end), GRAM), self.row, width, GRAM)

    def string(self, first: int, end: int) -> bytes:
        """The words of a range, joined by one space."""
        return b" ".join(self.buf[self.start[first] : self.end[end - 1]].tobytes().split())

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Per row the words that stay, joined by one space."""
        keep = np.flatnonzero(~gone)
        size = self.end[keep] - self.start[keep] + 1
        stop = np.cumsum(size)
        take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[keep] - (stop - size), size)
        out = np.append(self.buf, np.uint8(32))[take]
        out[stop - 1] = 32
        whole = out.tobytes()
        edge = np.concatenate([[0], stop])[np.searchsorted(self.row[keep], np.arange(len(self.off)))]
        return [whole[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def fingerprints(blocks: DataFrame, width: int) -> DataFrame:
    """(fp, blk, n runs) of every block that an Arrow batch touches, without moving the texts."""

    def scan(batches):
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            blk = batch.column("blk").to_numpy()
            for lo, hi in slices(off):
                w = Windows(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                if len(w.runs.fp):
                    pairs = np.stack([w.runs.fp.view(np.int64), blk[lo:hi][w.row[w.runs.first]]], axis=1)
                    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                    pairs = pairs[order]
                    new = np.flatnonzero(np.append(True, (np.diff(pairs, axis=0) != 0).any(axis=1)))
                    n = np.diff(np.append(new, len(pairs)))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[new, 0]), pa.array(pairs[new, 1]), pa.array(n.astype(np.int64))], names=["fp", "blk", "n"])

    return blocks.select("blk", "text").mapInArrow(scan, RUN)


class FingerprintIndex:
    """Sorted immutable runs, and the texts they were made of, under one folder with one writer at a time.

    A folder that is given outlives the session: every load ends with a row of its manifest, whose last row is read again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 4, parts: int | None = None):
        self.spark, self.fanout = spark, fanout
        #: Buckets of each run; a folder that is read again keeps its own.
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or f"{scratch(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.found: list[str] = []
        self.texts: list[str] = []
        self.loads, self.width, self.bytes = 0, 0, 0
        if folder:
            self._reload()

    def _reload(self) -> None:
        try:
            last = self.spark.read.schema(STATE).parquet(f"{self.folder}/manifest").orderBy(F.desc("loads")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        if last:
            self.loads, self.width, self.bytes, self.parts = last["loads"], last["width"], last["bytes"], last["parts"]
            self.runs, self.texts = ([f"{self.folder}/{x}" for x in last[c]] for c in ("runs", "texts"))

    @contextmanager
    def load(self, width: int, size: int) -> Iterator[int]:
        """The first block number of a new load; what it adds counts only if it ends without an error."""
        if self.width not in (0, width):
            raise ValueError(f"the index holds windows of {self.width} words, not {width}")
        runs, texts, self.found = list(self.runs), list(self.texts), []
        try:
            yield self.loads << BLOCK_BITS
            names = [[x.rpartition("/")[2] for x in paths] for paths in (self.runs, self.texts)]
            state = (self.loads + 1, width, self.bytes + size, self.parts, *names)
            self.spark.createDataFrame([state], STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        except BaseException:
            self.runs, self.texts = runs, texts
            raise
        self.loads, self.width, self.bytes = state[:3]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _run(self, path: str) -> DataFrame:
        """A run as a table bucketed by fingerprint, so that joins and groups on it need no shuffle."""
        name = path.rpartition("/")[2].replace("-", "_")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{x[0]}` {x[1]}' for x in map(str.split, RUN.split(', ')))}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.parts} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _new_run(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        name = path.rpartition("/")[2].replace("-", "_")
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.parts, "fp").sortBy("fp").saveAsTable(name)
        return path

    def keep(self, blocks: DataFrame) -> None:
        """Keeps a load's texts, for later loads to verify their windows against."""
        self.texts.append(self._write(blocks.select("blk", "row", "text"), "texts"))

    def earlier(self) -> DataFrame:
        """(blk, row, text) of the loads so far."""
        return self._read(self.texts, TEXTS)

    def shared(self) -> DataFrame:
        """Fingerprints of the load that at least two windows have; the windows' equality is for the caller to verify."""
        return self._read(self.found, "fp long").distinct()

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def fresh(self, run: str) -> DataFrame:
        """Fingerprints of a run that it has twice or that an earlier run has."""
        found = self._run(run).groupBy("fp").agg(F.sum("n").alias("n"))
        for i, earlier in enumerate(self.runs):
            seen = self._run(earlier).groupBy("fp").agg(F.first(F.lit(True)).alias(f"seen{i}"))
            found = found.join(seen.hint("merge"), "fp", "left")
        return found.where(" or ".join(["n > 1", *[f"seen{i}" for i in range(len(self.runs))]])).select("fp")

    def add(self, batch: DataFrame) -> None:
        """Appends the batch as a sorted run and records what it shares with the runs before, or within itself."""
        run = self._new_run(batch.repartition(self.parts, "fp"))
        self.found.append(self._write(self.fresh(run), "shared"))
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one; the old runs stay untouched for readers that still hold them."""
        merged = self._run(self.runs[0])
        for run in self.runs[1:]:
            merged = merged.union(self._run(run))
        self.runs = [self._new_run(merged.repartition(self.parts, "fp"))]

    def holders(self) -> DataFrame:
        """(blk, fps): the shared fingerprints of each block, at most as many as the block has windows."""
        shared = durable(self.shared())
        held = [self._run(run).join(shared.hint("merge"), "fp").select("blk", "fp") for run in self.runs]
        for more in held[1:]:
            held[0] = held[0].union(more)
        return held[0].groupBy("blk").agg(F.collect_set("fp").alias("fps"))


def repeated_windows(docs: DataFrame, width: int = 35, batches: int = 5, text: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """rest (the other columns), n_words, kept (string, words joined by one space), n_removed and spans of word numbers.

    The documents go through the index in `batches` parts, as they would arrive over time; then every window of any
    batch that has an equal elsewhere is removed, whichever came first.  With an `index` of earlier calls or sessions,
    their documents count as elsewhere.
    """
    blocks, total = in_blocks(docs, text)
    given, index = index is not None, index or FingerprintIndex(docs.sparkSession)
    buckets = (total + index.bytes) // BUCKET_BYTES + 1
    old = index.earlier() if index.texts else None
    with index.load(width, total) as base:
        blocks = blocks.withColumn("blk", F.col("blk") + F.lit(base))
        for i in range(batches):
            index.add(fingerprints(blocks.where(F.pmod(F.shiftright("row", 20), F.lit(batches)) == i), width))
        if given:
            index.keep(blocks)

    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        block = in_order(left)
        w = Windows(*utf8(block["text"]), width)
        known = pc.list_flatten(right["fps"]).to_numpy()
        blk = block["blk"][0].as_py() if len(block) else 0
        return w.runs.shipped(np.flatnonzero(np.isin(w.runs.fp.view(np.int64), known)), w.string, blk, buckets)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        block = in_order(left)
        w = Windows(*utf8(block["text"]), width)
        starts = w.runs.starts(right, w.string)
        step = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + width, -1)
        gone = np.cumsum(step)[:-1] > 0
        at_row = np.searchsorted(w.row, np.arange(len(w.off)))
        n, removed = np.diff(at_row), np.diff(np.concatenate([[0], np.cumsum(gone)])[at_row])
        spans = []
        for a, b, r in zip(at_row[:-1], at_row[1:], removed, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]))) if r else np.zeros(0, np.int64)
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"rest": carried(block["rest"]), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(w.kept(gone), pa.binary()).cast(pa.string()), "spans": pa.array(spans, kind)})

    dealt = blocks.groupBy("blk")
    held = index.holders()
    if old is not None:
        held = durable(held)
    shipped = dealt.cogroup(held.groupBy("blk")).applyInArrow(ship, SHIPPED)
    if old is not None:
        met = old.join(held.select("blk"), "blk", "left_semi").groupBy("blk")
        shipped = shipped.union(met.cogroup(held.groupBy("blk")).applyInArrow(ship, SHIPPED))
    answers = settled(shipped, [width], tied_words, lambda s: s.count(b" ") + 1).where(F.col("blk") >= base)
    schema = f"rest {blocks.schema['rest'].dataType.simpleString()}, n_words long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>"
    return dealt.cogroup(answers.groupBy("blk")).applyInArrow(last, schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("rest.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
