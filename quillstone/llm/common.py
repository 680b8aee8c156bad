"""What the operators share: table access, durable cuts of the lineage, and the packed duplicate exchange."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where it names none, a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so later jobs survive lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Writes `df` as Parquet in the shared checkpoint folder; the table read back, and its folder."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes `df` as Parquet in the shared checkpoint folder and reads it back."""
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str | None) -> None:
    """Removes the folder of a table of `stored` that nothing reads any more."""
    if path is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def in_blocks(docs: DataFrame, text: str = "text", block_bytes: int = 2_000_000) -> tuple[DataFrame, int]:
    """(blk, row, text, rest) and the bytes of all texts.

    Rows are dealt to blocks of about `block_bytes` by a hash of all their columns, so neither a hot source nor a
    group of copies meets in one block; `rest` is a struct of the other columns, whatever their names.  The order in a
    block is that of `row` (equal rows are interchangeable), so every pass over a block sees the same sequence.
    """
    total = text_bytes(docs, text)
    rest = [c for c in docs.columns if c != text]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    made = docs.select(
        row.alias("row"), text_of(f"`{text}`").alias("text"),
        (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"),
    )
    return made.select(F.pmod("row", F.lit(total // block_bytes + 1)).alias("blk"), "row", "text", "rest"), total


def nullable(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable(kind.value_type)))
    return kind


def carried(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """A struct of other columns as the stated schemas have it: every field nullable, also those of constants."""
    return column if nullable(column.type).equals(column.type) else column.cast(nullable(column.type))


def in_order(block: pa.Table) -> pa.Table:
    return block.sort_by([("row", "ascending")])


def prefix_bytes(total_bytes: int) -> int:
    """Leading key bytes that name a bucket: 256, 65,536 or 16.7 million buckets, so that one bucket fits a task."""
    return 1 if total_bytes < 64e9 else 2 if total_bytes < 16e12 else 3


PACKED = "bucket int, blk long, stage int, width int, keys binary"
FLAGS = "blk long, stage int, bucket int, shared binary, leads binary, holders binary"


class Keys:
    """The distinct 64-bit keys of one block, cut into buckets by their leading bytes."""

    def __init__(self, keys: np.ndarray, lead: int):
        self.lead = lead
        self.keys, self.first, self.back, self.count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        top = (self.keys >> U(64 - 8 * lead)).astype(np.int64)
        self.buckets, self.at = np.unique(top, return_index=True)
        self.ends = np.append(self.at, len(self.keys))[1:]

    def rows(self, blk: int, stage: int, width: int) -> list[tuple]:
        """One row a bucket: its sorted keys, without the leading bytes, cut to `width` bytes."""
        body = self.keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, self.lead : self.lead + width]
        return [(int(b), blk, stage, width, body[i:j].tobytes()) for b, i, j in zip(self.buckets, self.at, self.ends, strict=True)]

    def flags(self, answer: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For every key given, whether it occurs anywhere else, and whether this is its first holder."""
        shared, leads = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        place = dict(zip(self.buckets.tolist(), zip(self.at, self.ends, strict=True), strict=True))
        for b, s, r in zip(*(answer[c].to_pylist() for c in ("bucket", "shared", "leads")), strict=True):
            i, j = place[b]
            shared[i:j] = np.unpackbits(np.frombuffer(s, np.uint8), count=j - i)
            leads[i:j] = np.unpackbits(np.frombuffer(r, np.uint8), count=j - i)
        first = np.zeros(len(self.back), bool)
        first[self.first] = True
        return (shared | (self.count > 1))[self.back], leads[self.back] & first


def holders_of(keys: Keys, answer: pa.Table) -> np.ndarray:
    """For every key given, in how many blocks it occurs, up to 255."""
    out = np.zeros(len(keys.keys), np.int64)
    place = dict(zip(keys.buckets.tolist(), zip(keys.at, keys.ends, strict=True), strict=True))
    for b, h in zip(answer["bucket"].to_pylist(), answer["holders"].to_pylist(), strict=True):
        out[slice(*place[b])] = np.frombuffer(h, np.uint8)
    return out[keys.back]


def packed_table(rows: list[tuple]) -> pa.Table:
    kinds = (("bucket", pa.int32()), ("blk", pa.int64()), ("stage", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})


def _judge_bucket(bucket: pa.Table, holders: bool = False) -> pa.Table:
    bucket = bucket.sort_by([("blk", "ascending")])
    width = bucket["width"][0].as_py()
    parts = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in bucket["keys"].to_pylist()]
    ends = np.cumsum([len(x) for x in parts])
    wide = np.zeros((int(ends[-1]), 8), np.uint8)
    wide[:, 8 - width :] = np.concatenate(parts)
    _, first, back, count = np.unique(wide.view(">u8").ravel().astype(U), return_index=True, return_inverse=True, return_counts=True)
    leads = np.zeros(len(back), bool)
    leads[first] = True
    shared = (count > 1)[back]
    cut = lambda x: [np.packbits(p).tobytes() for p in np.split(x, ends[:-1])]
    number = [x.tobytes() for x in np.split(np.minimum(count, 255)[back].astype(np.uint8), ends[:-1])] if holders else [None] * len(parts)
    return pa.table({
        "blk": bucket["blk"], "stage": bucket["stage"], "bucket": bucket["bucket"], "shared": pa.array(cut(shared), pa.binary()),
        "leads": pa.array(cut(leads), pa.binary()), "holders": pa.array(number, pa.binary()),
    })


def judged(packed: DataFrame, holders: bool = False) -> DataFrame:
    """Sorts one bucket at a time and answers, for every block and bucket, which keys other blocks hold too.

    Every block sends a key once, so a key that fills a third of the corpus still has at most one entry a block.  With
    `holders`, the number of blocks that hold a key is told too, up to 255.
    """
    return packed.groupBy("bucket", "stage").applyInArrow(lambda bucket: _judge_bucket(bucket, holders), FLAGS)
