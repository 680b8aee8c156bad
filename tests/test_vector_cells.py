"""Search over cells and over scans against all pairs, with families of vectors, filters, lengths and ties."""

import random

import numpy as np

from quillstone.operators import vector


def families(n, dim, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    v = centres[np.arange(n) % 8] + spread * r.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plain(vectors, queries, k, only=None):
    out = []
    for q, x in queries:
        if x is None:
            continue
        scored = sorted((-round(float(np.dot(x, v)), 9), i) for i, v in vectors if v is not None and len(v) == len(x) and (only is None or i in only))
        out += [(q, rank + 1, i) for rank, (_, i) in enumerate(scored[:k])]
    return sorted(out)


def frames(spark, vectors, queries):
    return spark.createDataFrame(vectors, "chunk_id long, embedding array<double>"), spark.createDataFrame(queries, "qid long, embedding array<double>")


def ranked(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"]) for r in df.collect())


def cases():
    v = [(i, x.tolist()) for i, x in enumerate(families(600, 16, 1))]
    v += [(1000 + i, v[3][1]) for i in range(5)] + [(2000, None), (2001, [3.0] * 16), (2002, [0.0] * 16), (2003, [1.0, 0.0]), (2004, [0.5, 0.5])]
    q = [(i, x.tolist()) for i, x in enumerate(families(12, 16, 1, 0.01))] + [(50, v[3][1]), (51, [1.0, 1.0]), (52, [0.0] * 16), (53, None), (54, [1.0])]
    return v, q


def test_cells_find_what_all_pairs_find(spark):
    v, q = cases()
    vectors, queries = frames(spark, v, q)
    made = vector.cells(vectors)
    some = {i for i, _ in v if i % 7 == 2}
    only = spark.createDataFrame([(i,) for i in sorted(some)], "chunk_id long")
    assert ranked(vector.vector_search(made, queries, 5)) == plain(v, q, 5)
    assert ranked(vector.vector_search(made, queries, 5, only)) == plain(v, q, 5, some)
    assert ranked(vector.vector_search(vectors, queries, 5, only)) == plain(v, q, 5, some)
    assert ranked(vector.vector_search(vectors, queries, 700)) == plain(v, q, 700)
    assert vector.vector_search(vector.cells(vectors.limit(0)), queries, 5).count() == 0


def test_families_leave_most_cells_out(spark):
    v = [(i, x.tolist()) for i, x in enumerate(families(4000, 24, 2))]
    q = [(i, x.tolist()) for i, x in enumerate(families(16, 24, 2))]
    vectors, queries = frames(spark, v, q)
    search = vector.Search(vector.cells(vectors), queries, 5)
    assert ranked(search.best) == plain(v, q, 5)
    assert search.skipped() > 0.5


def test_many_queries_and_full_cells_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "ASKED", 6)
    monkeypatch.setattr(vector, "BLOCK", 50)
    v, q = cases()
    vectors, queries = frames(spark, v, q)
    made = vector.cells(vectors, pivots=3)
    assert max(made.blocks.values()) > 1
    assert ranked(vector.vector_search(made, queries, 5)) == plain(v, q, 5)
    assert ranked(vector.vector_search(vectors, queries, 5)) == plain(v, q, 5)
    random.Random(0).shuffle(v)
    assert ranked(vector.vector_search(frames(spark, v, q)[0], queries, 5)) == plain(v, q, 5)
