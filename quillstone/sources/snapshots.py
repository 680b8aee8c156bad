"""Versions of a folder of immutable tables: which of them are in force, changed all at once or not at all.

A version is one small JSON file, named by its number and written only if no such file exists.  Readers that took an older
version keep its tables; of two writers that start from the same version the second fails with Conflict and may try again.
The guarantee is that of the file system's create-without-overwrite.  A writer that ends between creating and writing its file
leaves an empty one, which stands in the way of others until it is removed by hand.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, least: int = 0) -> list[str]:
        at = self.path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at) if f.getLen() >= least] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        """Versions in force; one whose file is empty is still being written."""
        return sorted(int(n[:-5]) for n in self._names(f"{self.folder}/versions", 1) if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:012d}.json", wholetext=True).first()[0])

    def current(self) -> tuple[int, dict]:
        """The latest version and its state; (0, {}) before the first."""
        known = self.versions()
        return (known[-1], self.read(known[-1])) if known else (0, {})

    def commit(self, after: int, state: dict) -> int:
        """Puts `state` in force as the version that follows `after`."""
        at = self.path(f"{self.folder}/versions/{after + 1:012d}.json")
        try:
            out = self.fs.create(at, False)
        except Exception as e:
            if self.fs.exists(at):
                raise Conflict(f"version {after + 1} of {self.folder} exists") from e
            raise
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        return after + 1

    def clear(self, keep: int = 2) -> list[str]:
        """Removes versions but the last `keep`, and the tables, or their parts, that no remaining version names; for times without writers."""
        known = self.versions()
        held = {name for v in known[-keep:] for name in self.read(v).get("tables", [])}
        there = [n for n in self._names(self.folder) if n != "versions"]
        parts = {n: [f"{n}/{m}" for m in self._names(f"{self.folder}/{n}") if "=" in m] for n in there}
        gone = [m for n in there for m in (parts[n] or [n]) if m not in held]
        for n in gone:
            self.fs.delete(self.path(f"{self.folder}/{n}"), True)
        for v in known[:-keep]:
            self.fs.delete(self.path(f"{self.folder}/versions/{v:012d}.json"), False)
        return gone
