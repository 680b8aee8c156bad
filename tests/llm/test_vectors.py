"""Clustering, vector codes and fingerprints against plain versions, with every odd case, and against their SQL."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import centroids, queries, simhash, vector_codes
from tests.llm.brute import WORD
from tests.llm.cases import CLASHES, empty, frame, odd_texts, prose
from tests.sessions import MIDDLE, agree

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate([*CLASHES, "v", "code", "own", "sums"])])


def odd_vectors(dim, n=90, seed=5):
    """Families around few centres, whole repeats, ties by symmetry, and everything that takes no part."""
    r = random.Random(seed)
    base = [[round(r.uniform(-1, 1), 3) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [x + r.choice([0, 0, 0.01, -0.02]) for x in base[i % 4]], i % 3) for i in range(n)]
    rows += [(n + i, [1.0 if j == i % 2 else 0.0 for j in range(dim)], None) for i in range(6)]
    rows += [rows[7], rows[7], (3, base[1], 9), (None, base[2], 1), (n + 30, [3e30] * dim, 2), (n + 31, [-3e30] * dim, None)]
    odd = [None, [], [1.0] * (dim - 1), [1.0] * (dim + 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1)]
    return rows, [(1000 + i, v, 0) for i, v in enumerate(odd)]


def whole(v, scale):
    return [int(max(-centroids.LIMIT, min(centroids.LIMIT, np.floor(scale * float(np.float32(x)))))) for x in v]


def plain_clusters(rows, k, rounds):
    rows = [(i, whole(v, 1024)) for i, v, _ in rows]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in [*first, *sorted(r for r in rows if r[0] is None)]][:k]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in rows]
    inertia = lambda j=None: sum(d for _, d, o in found if j is None or o == j)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, inertia(j), inertia(), digest[j]) for i, d, j in found), key=repr)


def test_clusters_equal_a_plain_version(spark):
    rows, odd = odd_vectors(12)
    for some, k in ((rows, 8), (rows, 3), (rows[:5], 8), (rows[-4:], 8), (rows[:1] * 4, 8)):
        kept = centroids.integer_vectors(vectors(spark, some + odd), 1024, dim=12)
        done, told = centroids.cluster(kept, k, 6)
        assert sorted(map(tuple, done.collect()), key=repr) == plain_clusters(some, k, 6)
        assert len(told["worked_out"]) == 7
    none = centroids.cluster(centroids.integer_vectors(vectors(spark, odd), 1024, dim=12))[0]
    assert none.count() == 0 and none.columns == done.columns
    assert centroids.cluster(centroids.integer_vectors(vectors(spark, rows).limit(0), 1024))[0].count() == 0


def test_clusters_skip_distances_and_leave_one_table(spark):
    from quillstone.llm.common import scratch, table

    fs = lambda: sum(f.startswith("clusters-") for f in __import__("os").listdir(scratch(spark).removeprefix("file:")))
    before = fs()
    _, told = centroids.cluster(centroids.integer_vectors(table(spark, "/root/testdata/sf0.1", "embeddings"), 1024, dim=64))
    assert sum(told["worked_out"]) < 0.75 * 11 * 2000 * 8 and fs() == before


def test_bounds_of_roots_are_on_the_safe_side():
    d = np.array([0, 1, 2, 3, 2**24 + 1, 2**52 + 1, 2**62 - 1, 10**12 + 7], np.int64)
    for x, up, down in zip(d.tolist(), centroids.above(d).tolist(), centroids.beneath(d).tolist(), strict=True):
        assert int(up) ** 2 >= x or up * up >= x
        assert down * down <= x


def plain_codes(rows, entries, parts, rounds):
    rows = [(i, whole(v, 256), label) for i, v, label in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = -(-len(first[0][1]) // parts)
    cut = lambda v: [(v + [0] * (parts * dim - len(v)))[p * dim : (p + 1) * dim] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(cut(v)[p], books[p])[1] for _, v, _ in rows]
            new = []
            for e, old in enumerate(books[p]):
                mine = [cut(v)[p] for (_, v, _), o in zip(rows, own, strict=True) if o == e]
                new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else old)
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = []
    for i, v, label in rows:
        best = [nearest(cut(v)[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    return sorted(((i, code, err, sum(e for _, _, e, k in found if k == label), digest) for i, code, err, label in found), key=repr)


@pytest.mark.parametrize(("dim", "parts", "entries"), [(12, 4, 16), (10, 4, 64), (8, 8, 3)])
def test_codes_equal_a_plain_version(spark, dim, parts, entries):
    rows, odd = odd_vectors(dim)
    for some in (rows, rows[:2], rows[:1] * 4):
        made = vectors(spark, some + odd)
        done, _ = vector_codes.coded(centroids.integer_vectors(made, 256, more={"label": vector_codes.label_of(made)}), entries, parts)
        assert sorted(map(tuple, done.collect()), key=repr) == plain_codes(some, entries, parts, 2)
    none = vectors(spark, rows).limit(0)
    assert vector_codes.coded(centroids.integer_vectors(none, 256, more={"label": vector_codes.label_of(none)}))[0].count() == 0


def test_codes_measure_few_entries(spark):
    from quillstone.llm.common import table

    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    _, told = vector_codes.coded(centroids.integer_vectors(v, 256, more={"label": vector_codes.label_of(v)}))
    assert all(n < 0.1 * 2000 * 16 * 64 for n in told["worked_out"])


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_code_compression"])
def test_vector_query_equals_its_sql(spark, name):
    assert agree(queries.queries()[name](spark, MIDDLE), queries.oracle_sql()[name], MIDDLE) == 500


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().translate(simhash.LOWER))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, differ=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= differ:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_link_like_all_pairs(spark):
    base = prose(300, 21).split(" ")
    r = random.Random(3)
    family = [" ".join(w if r.random() > 0.004 * (k % 6) else f"x{r.randrange(99)}" for w in base) for k in range(60)]
    texts = [*odd_texts(), *family, family[0], "a b c d e", "É É É É", "é é é é"]
    fps = [plain_fingerprint(t) for t in texts]
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.groups(frame(spark, texts)).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fp"), "component_id").collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, plain_components(fps), strict=True))}
    assert len({c for _, c in got.values()}) < len(texts)
    assert simhash.groups(empty(spark)).count() == 0
    odd = spark.createDataFrame([(1, bytearray(b"caf\xe9 a b c")), (2, bytearray(b"caf\xe9 A B C"))], "doc_id long, text binary")
    assert [r["component_id"] for r in simhash.groups(odd).collect()] == [1, 1]  # bytes that are no UTF-8 count as they are
    ids = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c d"), (None, "c d"), (7, "c d")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in simhash.groups(ids).collect()), key=repr) == sorted([(None, None), (None, None), (7, 7), (None, 7), (7, 7)], key=repr)


def test_every_plan_finds_every_pair(spark):
    """Dense balls of fingerprints, skewed bits and strangers, under each number of parts."""
    r = random.Random(9)
    centres = [r.getrandbits(64) & 0xFFFF_FFFF_0000_0FFF for _ in range(4)]
    flipped = lambda f, n: f ^ sum(1 << b for b in r.sample(range(64), n))
    fps = sorted({flipped(c, k % 9) for c in centres for k in range(90)} | {r.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = {}
    for i, c in enumerate(plain_components(fps)):
        want.setdefault(c, []).append(signed[i])
    classes = spark.createDataFrame([(f, i % 3 + 1) for i, f in enumerate(signed)], "fp long, n long").cache()
    rows = classes.select("fp", F.col("fp").alias("root"))
    pairs = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (fps[i] ^ fps[j]).bit_count() <= 4}
    for m in simhash.PARTS:
        plan = simhash.planned(classes, parts=(m,))
        assert len(plan.parts) == m and sorted(b for p in plan.parts for b in p) == list(range(64))
        share, _ = plan.allocate(np.array(fps, np.uint64))
        assert (share.sum(axis=1) == 5).all()
        assert {(x["a"], x["b"]) for x in simhash.near(plan, rows, rows).collect()} == pairs
    roots = {x["fp"]: x["root"] for x in simhash.linked(classes).collect()}
    assert roots == {f: min(g) for g in want.values() if len(g) > 1 for f in g}


def test_estimates_are_counts_of_neighbours():
    """With one unit a part, an estimate is the exact number of fingerprints within the threshold."""
    fps = np.array([random.Random(i).getrandbits(64) & 0x3FF for i in range(400)], np.uint64)
    plan = simhash.Plan([list(range(10)), *[list(range(a, a + 9)) for a in range(10, 64, 9)]])
    plan.know(plan.counts(fps), len(fps))
    costs = plan.costs(fps)
    for t in range(5):
        exact = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= t).sum(axis=1)
        probes = sum(simhash.comb(10, d) for d in range(t + 1))
        assert np.allclose(costs[:, 0, t + 1], probes + simhash.COMPARE * exact, rtol=1e-4)
