"""Substring dedup, suffix dedup and the n-gram join against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import anchors, jaccard_join, substring_dedup, suffix_dedup
from quillstone.llm.common import table
from quillstone.llm.graph import components
from quillstone.llm.text import byte_grams
from tests.llm import brute
from tests.llm.cases import CLASHES, empty, frame, odd_texts, prose
from tests.sessions import SMALL


def corpus(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_removed_from_the_corpus(spark):
    texts = corpus(spark)
    got = by_id(substring_dedup.op3_substring_dedup(spark, SMALL), "n_words", "n_removed", "kept_sha256")
    assert got == dict(zip(texts, brute.removed_words(list(texts.values())), strict=True))


@pytest.mark.parametrize("batches", [1, 6])
def test_words_removed_from_odd_texts(spark, batches):
    texts = odd_texts()
    done = substring_dedup.repeated_windows(frame(spark, texts), batches=batches)
    got = by_id(done.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h"), "rest.row"), "n_words", "n_removed", "h")
    assert got == dict(enumerate(brute.removed_words(texts)))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in done.select("spans", "n_removed").collect())


def test_words_removed_across_calls(spark, tmp_path):
    """Two calls, the second by a new index over the folder of the first, and a third by the index of the second."""
    texts, folder = [*odd_texts(), prose(60, 20), prose(60, 20)], f"{tmp_path}/index"
    old, new = texts[::2], texts[1::2]
    words = lambda own, index: by_id(substring_dedup.repeated_windows(frame(spark, own), index=index).selectExpr("rest.doc_id", "n_words", "n_removed", "sha2(kept, 256) as h"), "n_words", "n_removed", "h")
    first = substring_dedup.FingerprintIndex(spark, folder)
    assert words(old, first) == dict(enumerate(brute.removed_words(old)))
    assert len(first.runs) == 2  # the first four batches of a call are merged
    second = substring_dedup.FingerprintIndex(spark, folder)
    want = brute.removed_words(texts)[1::2]
    assert want != brute.removed_words(new)
    assert words(new, second) == dict(enumerate(want))
    both = prose(34, 21) + " " + prose(60, 20)
    assert words([both, prose(50, 22)], second) == dict(enumerate(brute.removed_words([both, prose(50, 22), *texts])[:2]))
    with pytest.raises(ValueError):
        substring_dedup.repeated_windows(frame(spark, new), 40, index=substring_dedup.FingerprintIndex(spark, folder))


def test_history_is_joined_where_it_lies(spark):
    """A new run is dealt once, when it is written; runs before it are neither shuffled nor gathered."""
    index = substring_dedup.FingerprintIndex(spark, fanout=9)
    for part in (odd_texts()[10:14], odd_texts()[11:20], odd_texts()[5:30]):
        index.add(substring_dedup.fingerprints(frame(spark, part).selectExpr("doc_id as blk", "text"), 35))
    earlier, run = index.runs[:-1], index.runs[-1]
    index.runs = earlier
    plan = index.fresh(run)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "SortMergeJoin" in plan and "Exchange" not in plan


def test_index_merges_runs_and_keeps_old_ones(spark):
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    first = substring_dedup.fingerprints(frame(spark, odd_texts()[10:11]).selectExpr("doc_id as blk", "text"), 35)
    index.add(first)
    assert index.shared().count() == first.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").count()  # windows of one text can share theirs
    index.add(first)
    assert len(index.runs) == 1 and index.shared().count() == first.select("fp").distinct().count()


def test_bytes_removed_from_the_corpus(spark):
    texts = corpus(spark)
    got = by_id(suffix_dedup.op5_suffix_array_dedup(spark, SMALL), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    plain = brute.removed_bytes(list(texts.values()))
    assert got == {i: (*p[:3], hashlib.sha256(p[3]).hexdigest()) for i, p in zip(texts, plain, strict=True)}


def test_bytes_removed_from_odd_texts(spark):
    texts = odd_texts()
    got = by_id(suffix_dedup.repeated_spans(frame(spark, texts)).select("rest.doc_id", "n_bytes", F.size("spans").alias("n"), "kept"), "n_bytes", "n", "kept")
    assert {i: (a, n, bytes(k)) for i, (a, n, k) in got.items()} == {i: (p[0], p[2], p[3]) for i, p in enumerate(brute.removed_bytes(texts))}


def test_shorter_passages_are_counted_beside_long_ones(spark):
    texts = odd_texts()
    got = by_id(suffix_dedup.repeated_spans(frame(spark, texts), also=150).select("rest.doc_id", F.size("spans").alias("n"), "kept", "n_also"), "n", "kept", "n_also")
    long, short = brute.removed_bytes(texts), brute.removed_bytes(texts, 150)
    assert {i: (n, bytes(k), a) for i, (n, k, a) in got.items()} == {i: (p[2], p[3], q[1]) for i, (p, q) in enumerate(zip(long, short, strict=True))}
    assert any(q[1] > p[1] for p, q in zip(long, short, strict=True))


def test_cut_texts_are_whole_characters(spark):
    kept = suffix_dedup.drop_repeats(frame(spark, odd_texts()))
    assert kept.columns == frame(spark, []).columns
    assert all("�" not in r["text"] for r in kept.collect())


def test_components_of_the_corpus(spark):
    texts = corpus(spark)
    ids = sorted(texts)
    root = brute.linked([texts[i] for i in ids])
    got = by_id(jaccard_join.op4_ngram_jaccard_join(spark, SMALL), "n_shingles", "component_id")
    assert got == {i: (len(brute.shingles(texts[i])), ids[r]) for i, r in zip(ids, root, strict=True)}


def test_components_of_odd_texts(spark):
    texts = odd_texts()
    got = by_id(jaccard_join.groups(frame(spark, texts)), "n_shingles", "component_id")
    assert got == {i: (len(brute.shingles(t)), r) for (i, t), r in zip(enumerate(texts), brute.linked(texts), strict=True)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_components_of_edited_copies(spark, data):
    words = data.draw(st.lists(st.sampled_from("abcdefgh"), min_size=20, max_size=120))
    texts = []
    for _ in range(14):
        copy = list(words)
        for at in data.draw(st.lists(st.integers(0, len(words) - 1), max_size=3)):
            copy[at] = data.draw(st.sampled_from("xyz"))
        texts.append(" ".join(copy))
    got = by_id(jaccard_join.groups(frame(spark, texts)), "component_id")
    assert got == {i: (r,) for i, r in enumerate(brute.linked(texts))}


def test_components_of_a_family_around_the_threshold(spark):
    draw, base, texts = random.Random(4), prose(120, 9).split(" "), []
    for i in range(90):
        copy = list(base) + prose(i % 7, 100 + i).split(" ")
        for at in draw.sample(range(len(base)), draw.choice([0, 1, 2, 3, 4, 5, 7, 9])):
            copy[at] = f"edit{draw.randrange(6)}"
        texts.append(" ".join(copy))
    got = by_id(jaccard_join.groups(frame(spark, texts)), "component_id")
    want = brute.linked(texts)
    assert got == {i: (r,) for i, r in enumerate(want)}
    assert 1 < len(set(want)) < len(texts)


def tasks_of(spark, group, work):
    """What `work` returns, and the number of tasks that Spark has run for it."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        found, status = work(), sc.statusTracker()
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(name, None)
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return found, sum(info.numCompletedTasks for info in map(status.getStageInfo, stages) if info)


def test_components_take_few_tasks(spark):
    """Paths, stars, loops and a ring; every round may cost some shuffles, but nothing twice."""
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)] + [(300, 300)] + [(400 + i, 400 + (i + 1) % 9) for i in range(9)] + [(7, 5), (6, 7), (5, 7)]
    linked = spark.createDataFrame(edges, "a long, b long").repartition(4)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        roots, tasks = tasks_of(spark, "components", lambda: components(linked.where("a >= 200 or a < 100")).collect())
        paths = components(linked).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = dict.fromkeys(range(200, 260), 200) | {300: 300} | dict.fromkeys(range(400, 409), 400) | dict.fromkeys([5, 6, 7], 5)
    assert {r["node"]: r["root"] for r in roots} == want
    assert {r["node"]: r["root"] for r in paths} == want | dict.fromkeys(range(100, 131), 100)
    assert tasks < 61 * 16


def test_pairs_of_open_sets_miss_no_link(spark):
    """With every document a stray of its own, the pairs that are left must hold every link."""
    draw, base, texts = random.Random(5), prose(80, 10).split(" "), []
    for _ in range(60):
        copy = list(base)
        for at in draw.sample(range(len(base)), draw.choice([0, 1, 2, 3, 5, 8])):
            copy[at : at + draw.choice([0, 1, 2])] = [f"edit{draw.randrange(9)}"]
        texts.append(" ".join(copy))
    sets = [brute.shingles(t) for t in texts]
    rows = [(i, len(s), t, 0) for i, (s, t) in enumerate(zip(sets, texts, strict=True))]
    docs = spark.createDataFrame(rows, "cls long, n_shingles long, text string, central long")
    roots = spark.createDataFrame([], "cls long, root long")
    got = {frozenset((r["a"], r["b"])) for r in jaccard_join.crossing(jaccard_join.rare_first(docs), roots, False).collect()}
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want and want <= {p for p in got}


def test_pairs_are_told_apart_by_their_words():
    texts = [t or "" for t in odd_texts()]
    sets = [brute.shingles(t) for t in texts]
    held, n = jaccard_join.exact_sets(pa.array(texts))
    assert n.tolist() == [len(s) for s in sets] and len(held) == n.sum()
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]]
    got = jaccard_join.linked_pairs(*(pa.array([texts[p[k]] for p in pairs], pa.large_string()) for k in (0, 1)))
    assert got.tolist() == [100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for i, j in pairs]


def test_unlinked_variants_are_not_all_verified(spark, monkeypatch):
    """Variants of one text, each with other words changed, are no links of each other: few pairs may reach the texts, and none twice."""
    asked, verified = [], jaccard_join.verified

    def noted(pairs, texts):
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        return verified(pairs, texts)

    monkeypatch.setattr(jaccard_join, "verified", noted)
    base, seen = prose(200, 11).split(" "), {}
    for size in (100, 300):
        draw, texts = random.Random(6), []
        for i in range(size):
            copy = list(base)
            for at in draw.sample(range(len(base)), 6):
                copy[at] = f"own{i}x{at}"
            texts.append(" ".join(copy))
        asked.clear()
        got = by_id(jaccard_join.groups(frame(spark, texts)), "component_id")
        if size == 100:
            assert got == {i: (r,) for i, r in enumerate(brute.linked(texts))}
        assert len(asked) == len(set(asked))
        seen[size] = len(asked)
    assert seen[300] <= 4 * seen[100]  # each meets its signatures' most central members, and no more


def test_one_of_each_group_stays(spark):
    texts = odd_texts()
    docs = frame(spark, texts)
    kept = jaccard_join.one_of_each(docs.union(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute.linked(texts)))


def test_one_row_stays_of_repeated_and_null_ids(spark):
    a, b, c = prose(200, 30), prose(200, 31), prose(200, 32)
    rows = [(1, a, "en"), (1, a, "de"), (1, a + " edited", "en"), (2, a, "en"), (None, a, "en"), (1, c, "en"), (None, b, "en"), (None, b, "de"), (None, b + " edited", "en"), (3, "", "en"), (3, None, "en")]
    kept = [tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted((i or 0, (t or "")[:20]) for i, t, _ in kept) == sorted([(1, a[:20]), (1, c[:20]), (0, b[:20]), (3, ""), (3, "")])


SHORT = [["one", "two words", None], ["", None], ["a b c d e", "a b c d e"], ["x"] * 4]


@pytest.mark.parametrize("texts", SHORT)
def test_tables_of_short_texts(spark, texts):
    docs = frame(spark, texts)
    words = by_id(substring_dedup.repeated_windows(docs).selectExpr("rest.doc_id", "n_words", "n_removed", "sha2(kept, 256) as h"), "n_words", "n_removed", "h")
    assert words == dict(enumerate(brute.removed_words(texts)))
    spans = by_id(suffix_dedup.repeated_spans(docs).select("rest.doc_id", "n_bytes", F.size("spans").alias("n")), "n_bytes", "n")
    assert spans == {i: (len((t or "").encode()), 0) for i, t in enumerate(texts)}
    assert by_id(jaccard_join.groups(docs), "component_id") == {i: (r,) for i, r in enumerate(brute.linked(texts))}


def swapped_words(letters: int = 1024) -> tuple[str, str]:
    """Two words that polynomial hashes modulo a power of two confuse."""
    s, t = "a", "b"
    while len(s) < letters:
        s, t = s + t, t + s
    return s, t


def test_words_that_polynomial_hashes_confuse(spark):
    s, t = swapped_words()
    head, tail = prose(20, 40), prose(20, 41)
    texts = [f"{head} {s} {tail}", f"{head} {t} {tail}", "z" * 100_000, "z" * 100_000 + "y", s * 3, t * 3]
    words = by_id(substring_dedup.repeated_windows(frame(spark, texts)).selectExpr("rest.doc_id", "n_words", "n_removed", "sha2(kept, 256) as h"), "n_words", "n_removed", "h")
    assert words == dict(enumerate(brute.removed_words(texts))) and words[0][1] == words[1][1] == 0
    assert by_id(jaccard_join.groups(frame(spark, texts)), "component_id") == {i: (r,) for i, r in enumerate(brute.linked(texts))}
    spans = by_id(suffix_dedup.repeated_spans(frame(spark, texts)).select("rest.doc_id", "kept"), "kept")
    assert {i: bytes(k) for i, (k,) in spans.items()} == {i: p[3] for i, p in enumerate(brute.removed_bytes(texts))}


def fake_frame(block):
    """What groupBy().applyInArrow() does with one group."""

    class One:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, _):
            return f(block)

    return One()


@pytest.mark.parametrize("seed", range(12))
def test_windows_settled_by_characters(seed):
    """Texts of two letters, periodic ones and edited copies: everything hangs on few anchors."""
    draw, width, gram = random.Random(seed), (64, 80, 150)[seed % 3], (16, 24, 32)[seed % 3]
    base = bytes(draw.choice(b"ab") for _ in range(400))
    docs = [b"a" * 300, b"ab" * 150, b""]
    for _ in range(6):
        copy = bytearray(base)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(copy))
            copy[at : at + draw.randrange(5)] = bytes(draw.choice(b"abc") for _ in range(draw.randrange(3)))
        docs.append(bytes(copy))
    buf, sizes = np.frombuffer(b"".join(docs), np.uint8), [len(d) for d in docs]
    runs = anchors.Runs(byte_grams(buf, gram), np.repeat(np.arange(len(docs)), sizes), width, gram)
    cut = lambda a, b: buf[a:b].tobytes()
    answers = anchors.settled(fake_frame(runs.shipped(np.arange(len(runs.fp)), cut, 0, 1)), [width], anchors.tied_bytes, len)
    got, off = set(runs.starts(answers, cut).tolist()), np.cumsum([0, *sizes])
    seen = Counter(d[i : i + width] for d in docs for i in range(len(d) - width + 1))
    assert got == {int(off[k]) + i for k, d in enumerate(docs) for i in range(len(d) - width + 1) if seen[d[i : i + width]] > 1}


def test_empty_tables(spark):
    docs = empty(spark)
    assert substring_dedup.repeated_windows(docs).count() == 0
    assert suffix_dedup.repeated_spans(docs).count() == 0
    assert jaccard_join.groups(docs).count() == 0
    assert jaccard_join.one_of_each(docs).columns == ["doc_id", "text", *CLASHES]
