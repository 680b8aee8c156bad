"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Method: every whole text becomes a fixed row of statistics.  Standardised, they go through `features` random cosines
that approximate a Gaussian kernel.  The normal equations of the ridge fit are summed within partitions, then row by
row of the matrix across them; only the `features` + 1 sums reach the driver.  A part of the learning rows is kept from the fit; its raw scores, counted in `bins` bins, are
made monotone by pooling adjacent violators, which yields the score.

Labels are learnt from at most `most_labels` labelled rows (those of least hash); doc_id, lang, source and labels are
never part of a score.

Defined cases: null and empty texts have the statistics of an empty text and are scored; documents labelled twice
count twice; without any labelled row of both kinds every score is the share of good ones, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable, table, text_of
from quillstone.llm.text import LOWERCASE, slices, utf8, word_hashes, words

MOST_LABELS, FEATURES, BINS, RIDGE, SEED = 40_000, 384, 400, 1e-3, 7
_B = np.arange(256)
LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122) | (_B >= 128)
CLASSES = np.stack([LETTER, (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), np.isin(_B, list(b"#$%&*|<>{}[]\\^~=_+@")), np.isin(_B, list(b"!?")), np.isin(_B, list(b".,;:")), _B == 10, np.isin(_B, [32, 9, 13]), _B >= 128]).astype(np.float64)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x statistics of whole texts."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256).astype(np.float64)
    size = np.maximum(1, np.diff(off)).astype(np.float64)
    share = counts / size[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    start, end, doc = words(buf, off)
    h = word_hashes(LOWERCASE[buf], start, end)
    per = lambda x: np.bincount(doc, weights=x, minlength=n)
    length = (end - start).astype(np.float64)
    nw = np.bincount(doc, minlength=n).astype(np.float64)
    some = np.maximum(1, nw)
    distinct = lambda keys, docs: np.bincount(docs[_first(keys, docs)], minlength=n)
    pair = (h[1:] * np.uint64(3) + h[:-1])[doc[1:] == doc[:-1]] if len(h) else h
    pair_doc = doc[1:][doc[1:] == doc[:-1]] if len(h) else doc
    first, last = buf[start], buf[end - 1] if len(end) else buf[:0]
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    mean = per(length) / some
    return np.column_stack([
        np.log1p(np.diff(off)), np.log1p(nw), mean, np.sqrt(np.maximum(0, per(length**2) / some - mean**2)), share @ CLASSES.T, entropy,
        distinct(h, doc) / some, distinct(pair, pair_doc) / np.maximum(1, nw - 1), np.log1p(longest),
        per(length <= 3) / some, per(length == 1) / some, per((first >= 65) & (first <= 90)) / some, per(~LETTER[last]) / some, per(~LETTER[first]) / some,
        np.log1p(counts[:, 10]), share.max(axis=1),
    ])


def _first(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, docs))
    k, d = keys[order], docs[order]
    return order[np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))] if len(k) else order


def of_batch(batch: pa.RecordBatch) -> np.ndarray:
    buf, off = utf8(batch.column("text"))
    parts = [statistics(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off)]
    return np.concatenate(parts) if parts else np.zeros((0, 28))


class Fourier:
    """Random cosines of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) * (0.6 / np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b), np.ones(len(x))])


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least-squares monotone means of good / n along rising x: adjacent violators are pooled."""
    pools: list[list[float]] = []
    for g, m in zip(good, n, strict=True):
        pools.append([g, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, m2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + m2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / m) for g, m, k in pools]) if pools else np.zeros(0)


def scored(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    learn = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).select("doc_id", F.col("quality").cast("double").alias("y"))
    learn = learn.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_labels)
    texts = docs.select("doc_id", text_of().alias("text"))
    rows = texts.join(F.broadcast(learn), "doc_id").withColumn("fit", fold != 1).select("text", "y", "fit")  # at most most_labels rows are broadcast

    def take(batches):
        for b in batches:
            x = of_batch(b)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), b.column("y"), b.column("fit")], names=["x", "y", "fit"])

    x = durable(rows.mapInArrow(take, "x array<double>, y double, fit boolean"))
    wide = len(CLASSES) + 4 + 12 - 1
    share = x.agg(F.avg("y").alias("m"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(wide)], *[F.stddev(F.col("x")[i]).alias(f"s{i}") for i in range(wide)]).first()
    mean = np.array([share[f"m{i}"] or 0.0 for i in range(wide)])
    scale = np.array([max(share[f"s{i}"] or 0.0, 1e-6) for i in range(wide)])
    fourier = Fourier(mean, scale, features)

    def sums(batches):
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            z = fourier(np.array(b.column("x").to_pylist(), np.float64).reshape(-1, wide))
            total += z.T @ np.column_stack([z, b.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(part: pa.Table) -> pa.Table:
        return pa.table({"i": part["i"][:1], "row": pa.array([np.array(part["row"].to_pylist()).sum(axis=0)], pa.list_(pa.float64()))})

    normal = x.where("fit").mapInArrow(sums, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").collect()  # features + 1 rows
    full = np.zeros((features + 1, features + 2))
    for r in normal:
        full[r["i"]] = r["row"]
    count = max(1.0, full[-1, -2])
    weights = np.linalg.solve(full[:, :-1] / count + RIDGE * np.eye(features + 1), full[:, -1] / count)

    def raw(batches):
        for b in batches:
            s = fourier(np.array(b.column("x").to_pylist(), np.float64).reshape(-1, wide)) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)), b.column("y")], names=["bin", "y"])

    bins = x.where("not fit").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("y").alias("n")).orderBy("bin").collect()  # at most BINS rows
    at = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    level = isotonic(at, np.array([r["good"] for r in bins]), np.array([r["n"] for r in bins]))
    if not len(level):
        at, level = np.zeros(1), np.array([0.5 if share["m"] is None else share["m"]])

    def score(batches):
        for b in batches:
            s = np.interp(fourier(of_batch(b)) @ weights, at, level) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    done = texts.mapInArrow(score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")
    return done.select("doc_id", (fold == 0).alias("held_out"), "score")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    done = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
