"""Toxicity by a classifier chain.

Method: the categories are predicted one after the other by logistic regressions.  Each sees counts of the words and
word beginnings that tell its category apart, the probabilities of the categories before it, and nothing else.  While
learning, those earlier probabilities are out-of-fold predictions (`folds` folds by a hash of doc_id), so that a later
model meets inputs as honest as it will get on new documents.

Terms are chosen per category by the standard score of their document frequency among positive and other rows, from
counts made where the texts lie.  At most `most_labels` labelled rows (those of least hash) and `terms` terms per category
are learnt from; all documents are scored whole.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered; null and empty texts are
scored by the constants alone; a category without rows of both kinds has probability 1 if all rows are of it, else 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import U, carried, durable, table, text_of
from quillstone.llm.text import LOWERCASE, PLAIN, mix, slices, utf8, word_hashes, words

MOST_LABELS, TERMS, FOLDS, LEAST_Z, RIDGE = 20_000, 384, 3, 4.0, 1.0
#: Bytes of word beginnings that count as terms beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
#: The categories of table `labels`, from broad to narrow: (name, column, value of the positive rows).
CATEGORIES = (("unfit", "quality", 0), ("toxic", "toxic", 1))


def terms_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, row) of every word and word beginning, repeated as they occur."""
    start, end, row = words(buf, off, PLAIN)
    buf = LOWERCASE[buf]
    hashes, rows = [word_hashes(buf, start, end)], [row]
    for n in BEGINNINGS:
        at = np.flatnonzero(end - start > n)
        hashes.append(mix(word_hashes(buf, start[at], start[at] + n) + U(n)))
        rows.append(row[at])
    return np.concatenate(hashes), np.concatenate(rows)


def occurrences(buf: np.ndarray, off: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Rows x terms: how often each of the sorted hashes `terms` occurs, up to 65535."""
    out = np.zeros((len(off) - 1, len(terms)), np.int32)
    if len(terms):
        h, row = terms_of(buf, off)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[at] == h
        np.add.at(out, (row[hit], at[hit]), 1)
    return np.minimum(out, 65535).astype(np.uint16)


def damped(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts, dtype=np.float32)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 12, rows: int = 2048) -> np.ndarray:
    """Ridge logistic regression by Newton steps, `rows` at a time; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], RIDGE)
    pull[-1] = 1e-3
    for _ in range(rounds):
        slope, bend = -pull * w, np.diag(pull)
        for a in range(0, len(x), rows):
            part = x[a : a + rows].astype(np.float64)
            p = sigmoid(part @ w)
            slope += part.T @ (y[a : a + rows] - p)
            bend += (part * (p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def inputs(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([x, *[e.astype(x.dtype) for e in earlier], np.ones(len(x), x.dtype)])


class Chain:
    """The terms and weights of every category, in order."""

    def __init__(self, names: list[str], picked: list[np.ndarray]):
        self.names = names
        self.terms = np.unique(np.concatenate(picked)) if picked else np.zeros(0, U)
        self.columns = [np.searchsorted(self.terms, p) for p in picked]
        self.weights: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        earlier: list[np.ndarray] = []
        for k, columns in enumerate(self.columns):
            own = inputs(x[:, columns], earlier)
            self.weights.append(self._one(own, y[:, k]))
            held = np.zeros(len(x))
            for f in np.unique(fold):
                held[fold == f] = sigmoid(own[fold == f] @ self._one(own[fold != f], y[fold != f, k]))
            earlier.append(held)

    @staticmethod
    def _one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if len(y) and 0 < y.sum() < len(y):
            return logistic(x, y)
        w = np.zeros(x.shape[1])
        w[-1] = 30.0 if len(y) and y.all() else -30.0
        return w

    def predict(self, x: np.ndarray) -> np.ndarray:
        found: list[np.ndarray] = []
        for columns, w in zip(self.columns, self.weights, strict=True):
            found.append(sigmoid(inputs(x[:, columns], found) @ w))
        return np.column_stack(found)


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, most_labels: int = MOST_LABELS, terms: int = TERMS, folds: int = FOLDS) -> Chain:
    names = [c[0] for c in categories]
    known = labels.select("doc_id", *[(F.col(c) == v).cast("int").alias(n) for n, c, v in categories]).dropna()
    known = known.orderBy(F.xxhash64("doc_id"), *["doc_id", *names]).limit(most_labels)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")  # at most most_labels rows are broadcast
    rows = durable(rows.select("text", F.array(*names).alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold")))

    def frequencies(batches):
        for b in batches:
            buf, off = utf8(b.column("text"))
            y = np.array(b.column("y").to_pylist(), np.int64).reshape(-1, len(names))
            for lo, hi in slices(off):
                h, row = terms_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
                h, row = h[new], row[new] + lo
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                pos = np.add.reduceat(y[row], at, axis=0) if len(at) else y[:0]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h)))), pa.array(list(pos), pa.list_(pa.int64()))], names=["term", "n", "pos"])

    size = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col("y")[k]), F.lit(0)).alias(x) for k, x in enumerate(names)]).first()
    counts = rows.mapInArrow(frequencies, "term long, n long, pos array<long>")
    counts = durable(counts.groupBy("term").agg(F.sum("n").alias("n"), *[F.sum(F.col("pos")[k]).alias(x) for k, x in enumerate(names)]).where("n >= 3"))
    picked = []
    for x in names:
        p, q = max(1, size[x]), max(1, size["n"] - size[x])
        rate, other = F.col(x) / p, (F.col("n") - F.col(x)) / q
        pooled = F.col("n") / max(1, size["n"])
        z = (rate - other) / F.sqrt(pooled * (1 - pooled) * (1 / p + 1 / q) + 1e-9)
        best = counts.where(z >= LEAST_Z).orderBy(z.desc(), "term").limit(terms).select("term").collect()  # at most `terms` rows
        picked.append(np.sort(np.array([r["term"] for r in best], np.int64).view(U)))
    chain = Chain(names, picked)

    def take(batches):
        for b in batches:
            buf, off = utf8(b.column("text"))
            for lo, hi in slices(off):
                x = occurrences(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], chain.terms)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("y").slice(lo, hi - lo), b.column("fold").slice(lo, hi - lo)], names=["x", "y", "fold"])

    def fit(batches):
        parts = [b for b in batches if len(b)]
        x = damped(np.frombuffer(b"".join(v for b in parts for v in b.column("x").to_pylist()), np.uint16).reshape(sum(map(len, parts)), len(chain.terms)))
        y = np.array([v for b in parts for v in b.column("y").to_pylist()], np.float64).reshape(-1, len(names))
        fold = np.array([v for b in parts for v in b.column("fold").to_pylist()], np.int64)
        chain.fit(x, y, fold)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names))), pa.array(chain.weights, pa.list_(pa.float64()))], names=["k", "w"])

    # at most most_labels rows of at most terms x categories numbers meet in the fitting task
    fitted = rows.mapInArrow(take, "x binary, y array<int>, fold int").repartition(1).mapInArrow(fit, "k long, w array<double>").collect()
    chain.weights = [np.array(r["w"]) for r in sorted(fitted)]
    return chain


def scored(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """rest: all columns of `docs`; p: the probabilities, in the order of the chain."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"), text_of(f"`{text}`").alias("text"))

    def score(batches):
        for b in batches:
            buf, off = utf8(b.column("text"))
            p = [chain.predict(damped(occurrences(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], chain.terms))) for lo, hi in slices(off)]
            yield pa.RecordBatch.from_arrays([carried(b.column("rest")), pa.array(list(np.concatenate(p)) if p else [], pa.list_(pa.float64()))], names=["rest", "p"])

    return whole.mapInArrow(score, f"rest {whole.schema['rest'].dataType.simpleString()}, p array<double>")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose last category (toxic) is less likely than `least`, in the columns of `docs`."""
    done = scored(docs, learn(docs, labels)).where(F.element_at("p", -1) < least)
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return done.select(F.col("rest.doc_id").alias("doc_id"), F.col("p")[0].alias("unfit_p"), F.col("p")[1].alias("toxic_p"), (F.col("p")[1] >= 0.5).alias("rejected"))
