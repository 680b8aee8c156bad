"""A relation that is changed by key: only the buckets of changed keys are written anew, and a change is in force whole or not at all.

Rows lie in buckets by a hash of their key.  A change reads and writes the buckets that its keys fall in, beside the old files,
and then commits a version that names each bucket's folder (`sources.snapshots`).  A reader keeps the version it took; of two
writers that began with the same version the second gets Conflict, and has changed nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import catalog
from quillstone.sources.snapshots import Snapshots

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class Keyed:
    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 64):
        """`buckets` is fixed by the first change; a bucket should be of a size that a task rewrites with ease."""
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder, key, schema, buckets
        self.shots = Snapshots(spark, folder)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _rows(self, held: dict[str, str]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        at = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(f"{self.schema}, v string, bucket int").option("basePath", f"{self.folder}/data").parquet(*at).drop("v", "bucket")

    def read(self, version: int | None = None) -> DataFrame:
        state = self.shots.current()[1] if version is None else self.shots.read(version)
        return self._rows(state.get("held", {}))

    def change(self, changes: DataFrame, combine: Combine, after: int | None = None, batch: int | None = None) -> int:
        """Puts combine(rows of the touched buckets, changes) in place of those buckets.

        `after` is the version that the changes were made from.  Batches come in ascending order: one that is not above the
        last has been taken in already and changes nothing.
        """
        version, state = self.shots.current() if after is None else (after, self.shots.read(after) if after else {})
        if batch is not None and batch <= state.get("batch", -1):
            return version
        buckets = state.get("buckets", self.buckets)
        held = dict(state.get("held", {}))
        touched = [str(r[0]) for r in changes.select(self._bucket(buckets).alias("b")).distinct().collect()]  # `buckets` numbers at most
        made = combine(self._rows({b: held[b] for b in touched if b in held}), changes)
        v = uuid.uuid4().hex
        columns = [c.split()[0] for c in self.schema.split(", ")]
        made.select(*columns, self._bucket(buckets).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.folder}/data/v={v}")
        filled = {str(r[0]) for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/data/v={v}").select("bucket").distinct().collect()}
        if stray := filled - set(touched):
            raise ValueError(f"rows of other buckets: {sorted(stray)}")
        held = {b: x for b, x in held.items() if b not in touched} | dict.fromkeys(sorted(filled), v)
        return self.shots.commit(version, {"buckets": buckets, "held": held, "batch": state.get("batch", -1) if batch is None else batch, "tables": sorted({f"data/v={x}" for x in held.values()})})


def upserted(key: str = "goid") -> Combine:
    """Loads (with load_seq) over what is there: columns that keep their first value keep it, others take the last; see catalog.upsert_orders."""

    def combine(old: DataFrame, loads: DataFrame) -> DataFrame:
        new = catalog.upsert_orders(loads, key).withColumn("load_seq", F.lit(1))
        return catalog.upsert_orders(old.withColumn("load_seq", F.lit(0)).unionByName(new), key)

    return combine


def replaced(keys: list[str]) -> Combine:
    """Changed rows in place of those of the same keys."""
    return lambda old, new: old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def marked(old: DataFrame, passages: DataFrame) -> DataFrame:
    """Orders (goid, ocr_ok, ...) with the flag set where there are passages (goid)."""
    return catalog.mark_indexed(old, passages)
