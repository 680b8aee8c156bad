"""Classifiers by held-out accuracy, decontamination against plain tiling, and the pipeline stage by stage."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, quality, queries, toxicity
from quillstone.llm.common import table
from tests.llm import brute
from tests.llm.cases import empty, frame, odd_texts, prose
from tests.sessions import MIDDLE, SMALL

LARGE = "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    done = quality.op2_quality_classifier(spark, LARGE)
    rows = done.where("held_out").join(table(spark, LARGE, "labels"), "doc_id").where("quality is not null").select("score", "quality").collect()
    assert brute.auc([r["score"] for r in rows], [r["quality"] for r in rows]) > 0.8
    assert done.where("score is null or score < 0 or score > 1").count() == 0


def test_quality_equals_a_plain_fit(spark):
    """Ridge over all learning rows at once, and monotone levels by their min-max formula."""
    docs, labels = table(spark, MIDDLE, "documents").select("doc_id", "text"), table(spark, MIDDLE, "labels")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels, features=24).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = [(r["doc_id"], float(r["quality"])) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    stats = lambda ids: quality.of_batch(pa.RecordBatch.from_arrays([pa.array([texts[i] for i in ids])], names=["text"]))
    x, y = stats([i for i, _ in known]), np.array([v for _, v in known])
    fourier = quality.Fourier(x.mean(axis=0), np.maximum(x.std(axis=0, ddof=1), 1e-6), 24)
    fit = np.array([zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in known])
    z = fourier(x[fit])
    held = np.sqrt(quality.RIDGE * fit.sum())
    weights = np.linalg.lstsq(np.vstack([z, held * np.eye(25)]), np.append(y[fit], np.zeros(25)), rcond=None)[0]
    bins = np.clip(np.floor((fourier(x[~fit]) @ weights + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    at = np.unique(bins)
    good, n = np.array([y[~fit][bins == b].sum() for b in at]), np.array([(bins == b).sum() for b in at])
    mean = lambda i, j: good[i : j + 1].sum() / n[i : j + 1].sum()
    level = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    want = np.interp(fourier(stats(list(texts))) @ weights, (at + 0.5) / quality.BINS * 2 - 0.5, level)
    assert max(abs(got[i] - w) for i, w in zip(texts, want, strict=True)) < 1e-6


def plain_logistic(x, y):
    w = np.zeros(x.shape[1])
    pull = np.append(np.full(x.shape[1] - 1, toxicity.RIDGE), 1e-3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + np.diag(pull), x.T @ (p - y) + pull * w)
    return w


def test_chain_of_three_categories_equals_a_plain_one(spark):
    """Every link sees the links before it, out of fold while it learns."""
    draw, rows = random.Random(11), []
    for i in range(240):
        a = draw.random() < 0.5
        b = a and draw.random() < 0.7
        c = b and draw.random() < 0.7
        words = [f"w{draw.randrange(9)}" for _ in range(12)] + ["aa"] * (a + draw.randrange(2)) + ["bb"] * (2 * b) + ["cc"] * c + ["dd"] * draw.randrange(2)
        rows.append((i, " ".join(draw.sample(words, len(words))), int(a), int(b), int(c)))
    names = ["a", "b", "c"]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, a int, b int, c int")
    chain = toxicity.learn(docs, labels, [(n, n, 1) for n in names])
    got = {r["doc_id"]: r["p"] for r in toxicity.scored(docs, chain).select("rest.doc_id", "p").collect()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    fold, y, n = np.array([fold[r[0]] for r in rows]), np.array([r[2:] for r in rows], float), len(rows)
    counts = [Counter(r[1].split()) for r in rows]
    earlier_fit, earlier = [], []
    for k in range(3):
        positive = y[:, k].sum()
        picked = []
        for t in sorted({t for c in counts for t in c}):
            holds = np.array([t in c for c in counts])
            p, q, m = (holds & (y[:, k] == 1)).sum() / positive, (holds & (y[:, k] == 0)).sum() / (n - positive), holds.mean()
            if holds.sum() >= 3 and (p - q) / np.sqrt(m * (1 - m) * (1 / positive + 1 / (n - positive)) + 1e-9) >= toxicity.LEAST_Z:
                picked.append(t)
        x = np.array([[np.log1p(c[t]) for t in picked] for c in counts]).reshape(n, len(picked))
        own = np.column_stack([x, *earlier_fit, np.ones(n)])
        earlier.append(1 / (1 + np.exp(-(np.column_stack([x, *earlier, np.ones(n)]) @ plain_logistic(own, y[:, k])))))
        held = np.zeros(n)
        for f in range(toxicity.FOLDS):
            held[fold == f] = 1 / (1 + np.exp(-(own[fold == f] @ plain_logistic(own[fold != f], y[fold != f, k]))))
        earlier_fit.append(held)
    assert max(abs(got[r[0]][k] - earlier[k][i]) for i, r in enumerate(rows) for k in range(3)) < 1e-4


def test_quality_of_odd_tables(spark):
    docs, labels = frame(spark, odd_texts()), table(spark, SMALL, "labels")
    assert quality.scored(docs, labels).count() == len(odd_texts())
    assert {r["score"] for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(empty(spark), labels).count() == 0


def test_toxicity_on_rows_not_learnt_from(spark):
    docs, labels = table(spark, LARGE, "documents").select("doc_id", "text"), table(spark, LARGE, "labels")
    chain = toxicity.learn(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.scored(docs.join(labels.where("doc_id % 4 = 0 and toxic is not null"), "doc_id"), chain).select("rest.toxic", F.element_at("p", -1).alias("p")).collect()
    assert brute.auc([r["p"] for r in rows], [r["toxic"] for r in rows]) > 0.97
    assert sum((r["p"] >= 0.5) != r["toxic"] for r in rows) <= 0.03 * len(rows)


def test_toxicity_of_odd_tables(spark):
    docs, labels = frame(spark, odd_texts()), table(spark, SMALL, "labels")
    kept = toxicity.accepted(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert toxicity.accepted(empty(spark), labels).count() == 0


def plain_words(text):
    return re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_coverage_equals_plain_tiling(spark):
    item = prose(40, 20)
    words = item.split(" ")
    texts = [None, "", item, prose(30, 21), " ".join([*words[20:], "gap", *words[:20]]), " ".join(words[:22]), " ".join(words[:12]), "a b a b a b", item.upper() + " " + item, " ".join(words[5:25] + words[:20])]
    items = [(1, item), (2, "a b"), (3, None), (4, "a b a b c a b a b"), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(0))
    for slice_items in (20_000, 1):
        done = decontaminate.coverage(frame(spark, texts), benchmark, slice_items=slice_items).select("rest.doc_id", "hits")
        got = {(r["doc_id"], h["item"]): round(h["covered"], 9) for r in done.collect() for h in r["hits"]}
        want = {}
        for i, t in enumerate(texts):
            for k, x in items:
                if k is not None and plain_words(x):
                    covered = brute.tile_coverage(plain_words(t), plain_words(x), min(decontaminate.TILE, len(plain_words(x))))
                    if covered >= decontaminate.LEAST:
                        want[i, k] = round(covered, 9)
        assert got == want


def test_repetitive_texts_are_tiled_in_bounded_memory(spark):
    """Every place of the document matches every place of the item."""
    texts, items = ["w " * 20_000, "a b " * 9_000, "w " * 3 + "x"], [(1, "w " * 60), (2, "a b " * 40 + "c"), (3, "w w w w")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for slice_bytes in (8_000_000, 100):
        rows = decontaminate.coverage(frame(spark, texts), benchmark, slice_bytes=slice_bytes).select("rest.doc_id", "hits").collect()
        assert {(r["doc_id"], h["item"]): round(h["covered"], 6) for r in rows for h in r["hits"]} == {(0, 1): 1.0, (0, 3): 1.0, (1, 2): round(80 / 81, 6)}


def test_running_hashes_are_polynomials():
    words = np.random.default_rng(3).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    prime, base = int(decontaminate.PRIME), int(decontaminate.BASE)
    plain = [sum(int(w) % prime * base ** (3 - j) for j, w in enumerate(words[i : i + 4])) % prime for i in range(47)]
    assert decontaminate.karp_rabin(words, 4).tolist() == plain


def test_verbatim_items_are_found_in_the_corpus(spark):
    found = {r["doc_id"] for r in decontaminate.op7_benchmark_decontamination(spark, MIDDLE).where("contaminated").collect()}
    items = [r["text"] for r in table(spark, MIDDLE, "benchmark").collect()]
    whole = {r["doc_id"] for r in table(spark, MIDDLE, "documents").collect() if any(x in (r["text"] or "") for x in items)}
    assert whole and whole <= found


def test_decontamination_of_odd_tables(spark):
    docs, benchmark = frame(spark, odd_texts()), table(spark, SMALL, "benchmark")
    assert decontaminate.decontaminated(docs, benchmark.limit(0)).count() == len(odd_texts())
    assert decontaminate.decontaminated(docs, benchmark).columns == docs.columns
    assert decontaminate.decontaminated(empty(spark), benchmark).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        seen.append(name)
        if name == "ngram_jaccard_join":
            ids = sorted(before)
            assert {r["doc_id"] for r in docs.collect()} == {ids[r] for r in brute.linked([before[i] for i in ids])}
        if name == "suffix_array_dedup":
            plain = dict(zip(before, brute.removed_bytes(list(before.values()), pipeline.MIN_REPEAT), strict=True))
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(after) == set(before)
            assert all(after[i] == p[3].decode("utf-8", "ignore") for i, p in plain.items())
        if name != "best_fit_packing":
            assert docs.columns == columns
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
    assert len(seen) == 5


def test_clean_odd_documents_pass_the_whole_pipeline_functions(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, odd_texts()).withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, SMALL), f"odd-{name}")
    assert docs.count() > 0
