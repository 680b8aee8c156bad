"""Tables written on the way: in a folder that is given, or in the session's checkpoint folder, which all executors share.

Those in the checkpoint folder live as long as the application: they are removed when it ends, or before by `removed` if nothing reads them any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Scratch folders made since the innermost `on_the_way` began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where none is set, a temporary one on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


@contextmanager
def on_the_way(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are made within are removed at the end."""
    before = _MADE.set([])
    try:
        yield
    finally:
        removed(spark, *_MADE.get())
        _MADE.reset(before)


#: Spark's setting by which a write's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffled_once(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files behind; without it they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes `df` as Parquet and reads it back: planned once, its size known to the planner."""
    path = folder or scratch(df.sparkSession)
    with shuffled_once(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
