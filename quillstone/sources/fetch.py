"""Fetching the files of orders: what is there is not fetched again, what fails for good is told from what may work later."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A smaller file is not taken for a whole one; tries of an address; seconds, times the try, between them; how a PDF begins.
WHOLE, TRIES, PAUSE, MAGIC = 1000, 3, 1.5, b"%PDF-"
OUTCOME = "goid long, url string, status string, bytes long, fetched_at string, error string"


class Missing(Exception):
    """What a transport raises where there is nothing at an address; it is not asked again."""


def _outcome(files, at: str, goid: int, url: str, transport: Callable[[str], bytes], pause: float) -> tuple:
    now = lambda: datetime.now(UTC).isoformat()
    path = f"{at}/{goid}.pdf"
    held = files.get_file_info(path).size or 0
    if held > WHOLE:
        return goid, url, "skipped", held, None, None
    for n in range(1, TRIES + 1):
        try:
            body = transport(url)
            if not body.startswith(MAGIC):
                raise ValueError("not a PDF")
            with files.open_output_stream(f"{path}.part") as f:
                f.write(body)
            files.move(f"{path}.part", path)  # so that a file is there whole or not at all
            return goid, url, "ok", len(body), now(), None
        except Missing as e:
            return goid, url, "missing", None, None, f"404 {e}".strip()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if n < TRIES:
                time.sleep(pause * n)
    return goid, url, "failed", None, None, error


def fetched(worklist: DataFrame, transport: Callable[[str], bytes], folder: str, together: int = 8, pause: float = PAUSE) -> DataFrame:
    """(goid, url, status, bytes, fetched_at, error) of (goid, url), after the files have been put into `folder` as <goid>.pdf.

    `together` tasks fetch at a time at most.  Status is ok, skipped (it was there), missing or failed; rows without goid or url
    are left out, and of rows of one goid the least url is taken.  The result is computed when it is used: write it once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(at, recursive=True)
        names = [c.split()[0] for c in OUTCOME.split(", ")]
        for b in batches:
            yield pd.DataFrame([_outcome(files, at.rstrip("/"), int(g), u, transport, pause) for g, u in zip(b["goid"], b["url"], strict=True)], columns=names).astype({"bytes": "Int64"})

    rows = worklist.where("goid is not null and url is not null").groupBy("goid").agg(F.min("url").alias("url"))
    return rows.select("goid", "url").repartition(together, "goid").mapInPandas(run, OUTCOME)


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: ok, skipped, missing, failed."""
    return outcomes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "missing", "failed")])
