"""Suffix-array deduplication of long repeated byte strings.

Method: blockwise suffix sorting, one bucket of suffixes at a time, with long ties settled by the ranks of a sample.
Only suffixes whose first `min_bytes` bytes may occur elsewhere are sorted: those whose anchor (the least gram hash in
these bytes) occurs at a second place.  A bucket holds all suffixes with one anchor; each is cut where its last such
window ends, and equal cuts come once.  In a bucket, suffixes are sorted by their characters up to the next sample
place, then by the rank of the sample suffix, which was computed beforehand; a suffix with a neighbour of equal
distance to the anchor and at least `min_bytes` common bytes is repeated.

A difference cover serves to give any two suffixes sample places at equal distances.  Here the anchor does that: places
are counted from it, so the cover of one residue is enough, and a bucket needs only the text around its anchor instead
of the whole corpus.  Hashes choose what meets; only characters decide what is equal.

Defined cases: null and empty texts have no bytes and lose none; texts below the length lose none; a text that
occurs twice is removed whole in both places; repeated rows count as different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.anchors import SHIPPED, Runs, settled, tied_bytes
from quillstone.llm.common import PACKED, Keys, carried, in_blocks, in_order, judged, packed_table, prefix_bytes, table
from quillstone.llm.text import byte_grams, utf8

#: Bytes of text around its anchors that a bucket of suffixes is meant to hold.
BUCKET_BYTES = 1_000_000


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) of any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step)[:n] > 0


class Suffixes:
    """One block of documents, and for every length the runs of its suffixes that have so many bytes."""

    def __init__(self, block: pa.Table, lengths: list[int]):
        self.block, self.lengths = in_order(block), lengths
        self.blk = self.block["blk"][0].as_py() if len(block) else 0
        self.buf, self.off = utf8(self.block["text"])
        row = np.repeat(np.arange(len(self.off) - 1, dtype=np.int32), np.diff(self.off))
        self.runs = [Runs(byte_grams(self.buf, gram), row, n, gram) for n in lengths for gram in [min(64, n // 4)]]

    def string(self, start: int, end: int) -> bytes:
        return self.buf[start:end].tobytes()

    def repeated(self, answer: pa.Table, kind: int) -> np.ndarray:
        """Which bytes lie in strings of one length that start elsewhere too."""
        own = answer.filter(pc.equal(answer["kind"], kind))
        return covered(self.runs[kind].starts(own, self.string), self.lengths[kind], len(self.buf))


def whole_characters(buf: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """`gone` widened to all bytes of every character that loses one."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(buf)))) if len(buf) else gone


def repeated_spans(docs: DataFrame, min_bytes: int = 400, text: str = "text", characters: bool = False, also: int | None = None) -> DataFrame:
    """Every column of `docs` but the text in `rest`, then n_bytes, kept (binary) and spans (array of start, end).

    A span is a maximal run of bytes covered by `min_bytes`-byte strings that start anywhere else as well; with
    `characters`, widened to whole characters.  With `also`, n_also tells how many bytes lie in repeats of that many bytes
    and more; they stay.
    """
    lengths = [n for n in (min_bytes, also) if n is not None]
    if min(lengths) < 64:
        raise ValueError("repeats have at least 64 bytes")
    blocks, total = in_blocks(docs, text)
    lead, buckets = prefix_bytes(total), total // BUCKET_BYTES + 1

    def first(block: pa.Table) -> pa.Table:
        s = Suffixes(block, lengths)
        return packed_table([r for k, own in enumerate(s.runs) for r in Keys(own.fp, lead).rows(s.blk, k, 8 - lead)])

    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        s, parts = Suffixes(left, lengths), []
        for k, own in enumerate(s.runs):
            shared, _ = Keys(own.fp, lead).flags(right.filter(pc.equal(right["stage"], k)))
            parts.append(own.shipped(np.flatnonzero(shared), s.string, s.blk, buckets, k))
        return pa.concat_tables(parts)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Suffixes(left, lengths)
        gone = s.repeated(right, 0)
        more = np.concatenate([[0], np.cumsum(s.repeated(right, 1))])[s.off] if also else s.off * 0
        gone = whole_characters(s.buf, gone) if characters else gone
        kept, spans = [], []
        for a, b in zip(s.off[:-1], s.off[1:], strict=True):
            out = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
            kept.append(s.buf[a:b][~out].tobytes() if len(edge) else s.buf[a:b].tobytes())
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"rest": carried(s.block["rest"]), "n_bytes": pa.array(np.diff(s.off), pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind), "n_also": pa.array(np.diff(more), pa.int64())})

    dealt = blocks.groupBy("blk")
    shared = judged(dealt.applyInArrow(first, PACKED))
    answers = settled(dealt.cogroup(shared.groupBy("blk")).applyInArrow(ship, SHIPPED), lengths, tied_bytes, len)
    schema = f"rest {blocks.schema['rest'].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>, n_also long"
    done = dealt.cogroup(answers.groupBy("blk")).applyInArrow(last, schema)
    return done if also else done.drop("n_also")


def drop_repeats(docs: DataFrame, min_bytes: int = 400, text: str = "text") -> DataFrame:
    """The documents with every repeated string cut out of their text, in the columns of `docs`.

    A cut inside a character drops that character's other bytes too.
    """
    done = repeated_spans(docs, min_bytes, text, characters=True)
    return done.select(*[(F.col("kept").cast("string") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


#: Bytes of the shortest passages of over 50 words, which are counted but not cut.
PASSAGE = 150


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Beside the columns of repeats of 400 bytes, n_passage: bytes in repeats of PASSAGE bytes and more."""
    done = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), also=PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select(
        F.col("rest.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.col("n_also").alias("n_passage"),
    )
