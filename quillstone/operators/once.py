"""Dear calls (a language model, a recognition engine) made once a key: a ledger of results, and notes for runs that break off.

The ledger is a table of finished keys; work that it has is not done again.  What is left is spread over tasks by key.  A task
writes a note of each result in the shared folder before it hands the result on, and looks for one before it calls, so
neither a task that is repeated nor a run that was killed calls again for what had an answer.  After a run its results are in the
ledger and the notes are removed.  A call that fails is tried again up to `tries` times in all, also over several runs;
then its error is the result.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources import readers

LEDGER = "key string, value string, error string, tries int"


class Notes:
    """Small files of results by key, in any folder that pyarrow can open."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.at = at.rstrip("/")

    def _path(self, key: str) -> str:
        digest = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.at}/{digest[:2]}/{digest}.json"

    def find(self, key: str) -> dict | None:
        try:
            with self.fs.open_input_stream(self._path(key)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def leave(self, key: str, note: dict) -> None:
        """Moved into place whole, so that a reader never finds half a note."""
        path = self._path(key)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(note).encode())
        self.fs.move(part, path)


def once(work: DataFrame, call: Callable[[dict], str], folder: str, tries: int = 3, pause: float = 0.0) -> DataFrame:
    """(key, value, error, tries) of every key in `work` (key, ...): what `call` made of a row with that key.

    `pause` seconds, times the tries so far, lie between tries.  Rows of one key are one piece of work.  A null key is left out.
    """
    spark, path, notes = work.sparkSession, f"{folder}/ledger", f"{folder}/notes"
    fields = work.columns

    def done() -> DataFrame:
        last = F.max_by(F.struct("value", "error", "tries"), F.struct("tries", F.col("error").isNull()))
        return readers.relation(spark, path, LEDGER).groupBy("key").agg(last.alias("r")).select("key", "r.*")

    finished = done().where(F.col("error").isNull() | (F.col("tries") >= tries)).select("key")
    left = work.where("key is not null").join(finished, "key", "left_anti").dropDuplicates(["key"])
    before = done().select("key", F.col("tries").alias("__tries"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Notes(notes)
        for b in batches:
            made = []
            for row in b.to_dict("records"):
                used = int(row.pop("__tries"))
                note = kept.find(row["key"])
                if note is None or (note["error"] is not None and note["tries"] < tries):
                    used = max(used, note["tries"] if note else 0)
                    while True:
                        used += 1
                        try:
                            note = {"key": row["key"], "value": call({f: row[f] for f in fields}), "error": None, "tries": used}
                        except Exception as e:  # the error is the result
                            note = {"key": row["key"], "value": None, "error": f"{type(e).__name__}: {e}", "tries": used}
                        kept.leave(row["key"], note)
                        if note["error"] is None or used >= tries:
                            break
                        time.sleep(pause * used)
                made.append(note)
            yield pd.DataFrame(made, columns=["key", "value", "error", "tries"])

    todo = left.join(before, "key", "left").withColumn("__tries", F.coalesce("__tries", F.lit(0))).repartition("key")
    todo.mapInPandas(run, LEDGER).write.mode("append").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(notes)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return work.select("key").where("key is not null").distinct().join(done(), "key")
