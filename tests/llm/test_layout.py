"""Top-k search, WARC archives, shards and packing."""

import shutil
import zlib
from array import array
from itertools import groupby
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import packing, queries, sharding, topk, warc
from quillstone.llm.common import scratch, table
from tests.llm.cases import empty, frame, odd_texts
from tests.sessions import SMALL, agree


def test_queries_with_sql(spark):
    for name, sql in queries.oracle_sql().items():
        assert agree(queries.queries()[name](spark, SMALL), sql, SMALL) > 0


def test_top_k_ties_repeats_and_unfit_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, []), (8, [float("inf"), 0.0]), (9, [1.0]), (2, [0.5, 0.5]), (None, [1.0, 1.0])]
    v = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit(1)))
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id in (1, 9)"), 2, block=2, query_block=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 65536), (1, 2, 2, 32768)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_in_blocks_equals_one_block(spark):
    v = topk.integers(table(spark, SMALL, "embeddings"))
    q = v.where("vec_id % 50 = 0")
    assert sorted(topk.top_k(v, q, block=97, query_block=3).collect()) == sorted(topk.top_k(v, q).collect())


def test_archives_of_odd_pages(spark):
    big = "b" * 1200
    rows = [(1, "http://a/\r\nX: 1", big), (2, None, big), (3, "http://c", None), (4, "u", "small"), (5, "u", "small"), (6, "ü", "é" * 600), (None, "n", big), (2, None, big)]
    warc.register(spark)
    path = f"{scratch(spark)}/odd-warc"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("n", F.lit(2))
    warc.records_of(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    assert read.count() == len(rows)
    revisits = read.where("record_type = 'revisit'").collect()
    assert all(r["refers_to"] == "urn:page:2" and r["payload"] is None and r["payload_length"] == 1200 for r in revisits) and len(revisits) >= 1
    assert {bytes(r["payload"]) for r in read.where("record_type = 'response'").collect()} == {big.encode(), b"", b"small", ("é" * 600).encode()}
    head = spark.read.format("warc").option("payload", "false").load(path).where("record_id = 'urn:page:6'").collect()
    assert len(head) == 1 and head[0]["payload"] is None and head[0]["payload_length"] == 1200


def test_pushed_predicates_equal_unpushed_ones(spark):
    big = "p" * 1100
    warc.register(spark)
    path = f"{scratch(spark)}/pushed-warc"
    pages = spark.createDataFrame([(1, "http://a", big), (2, None, big), (3, "http://c", "own"), (4, "http://a", "")], "page_id long, url string, html string")
    warc.records_of(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    rows = read.select(*warc.NAMED).collect()
    unpushed = spark.createDataFrame(rows, read.select(*warc.NAMED).schema)
    for column in warc.NAMED:
        values = sorted({r[column] for r in rows} - {None})
        for where in (f"{column} = '{values[0]}'", f"{column} in ('{values[-1]}', 'none such')", f"{column} in ('{values[0]}', '{values[-1]}', null)", f"{column} = 'none such'"):
            mine, theirs = (sorted(r["record_id"] for r in df.where(where).collect()) for df in (read, unpushed))
            assert mine == theirs and bool(mine) == ("= 'none" not in where), where


def test_archives_in_nested_folders(spark):
    warc.register(spark)
    top = f"{scratch(spark)}/nested-warc".removeprefix("file:")
    page = lambda i: warc.records_of(spark.createDataFrame([(i, "u", f"page {i}")], "page_id long, url string, html string"))
    for i, folder in enumerate(["day1", "day1", "day2/early/", "plain"]):
        page(i).write.format("warc").mode("append").save(f"{top}/{folder}")
    local = Path(top)
    for listed in (local / "plain").glob("*.manifest.json"):
        listed.unlink()
    written = next((local / "day1").glob("*.warc"))
    shutil.copy(written, local / "day1" / "lost-attempt.warc")
    shutil.copy(written, local / "day1.warc")
    ids = lambda path: sorted(r["record_id"][-1] for r in spark.read.format("warc").load(path).select("record_id").collect())
    again = ids(str(local / "day1.warc"))
    assert ids(top) == ids(f"{top}/") == ids(local.as_uri() + "/") == sorted(["0", "1", "2", "3", *again])
    assert ids(f"{top}/day1") == ids(f"{top}/day1/") == ["0", "1"] and ids(f"{top}/day2") == ["2"] and ids(f"{top}/plain/") == ["3"]
    (local / "none yet").mkdir()
    assert ids(f"{top}/none yet") == []
    written.unlink()
    for path in (top, f"{top}/day1", f"{top}/none"):
        with pytest.raises(Exception, match="FileNotFoundError"):
            ids(path)


def test_shards_are_contiguous_and_balanced(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    rows = sharding.op9_sharding(spark, SMALL).orderBy("doc_id").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards) and set(shards) <= set(range(40))
    most, total = max(r["size"] for r in rows), sum(r["size"] for r in rows)
    for _, own in groupby(rows, key=lambda r: r["shard"]):
        own = list(own)
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 40) <= most


def test_shards_of_odd_rows(spark):
    docs = frame(spark, odd_texts())
    docs = docs.union(docs.where("doc_id = 10")).union(docs.where("doc_id = 11").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shards(docs, 3).collect()
    assert len(rows) == docs.count()
    for k, own in groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        assert [r["slot"] for r in own] == list(range(sum(r["shard"] == k for r in rows)))
    assert sharding.shards(empty(spark), 3).count() == 0


def test_shards_of_hot_and_odd_ids(spark):
    """One id holds half of the rows, and ids may be strings or null."""
    rows = [(7 if i % 2 else i, "text " * (i % 9)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for own in (docs, docs.withColumn("doc_id", F.col("doc_id").cast("string")), docs.withColumn("doc_id", F.nullif("doc_id", F.lit(7)))):
        done = sharding.shards(own, 5)
        got = done.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
        assert sum(r["n"] for r in got) == 4000 and all(r["n"] == r["slots"] == r["last"] + 1 for r in got)
        total = sum(r["bytes"] for r in got)
        assert all(abs(r["bytes"] - total / 5) <= 61 for r in got)


def test_lists_are_not_read_to_their_ends(spark):
    rows = [(r["vec_id"], r["v"]) for r in topk.integers(table(spark, "/root/testdata/sf0.1", "embeddings")).collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    asked = ids % 50 == 0
    known, share = topk.best(v[asked], ids[asked], v, ids, 5)
    assert share < 0.95
    score = v[asked] @ v.T
    for q, own, found in zip(ids[asked], score, known, strict=True):
        assert found == sorted((-int(s), int(i)) for s, i in zip(own, ids, strict=True) if i != q)[:5]


@pytest.mark.parametrize("most", [3, 200, 10**6, 2**45])
def test_top_k_in_every_number_type(most):
    draw = np.random.default_rng(most % 97)
    v, ids = draw.integers(-most, most + 1, (90, 7)), draw.permutation(90)
    known, _ = topk.best(v[:6], ids[:6], v, ids, 5)
    for i in range(6):
        plain = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], x, strict=True)), int(j)) for x, j in zip(v, ids, strict=True) if j != ids[i])
        assert known[i] == plain[:5]


def held_together(rows, texts, capacity=1024):
    """Pieces are those of the tokenizer, sequences are gapless and hold at most `capacity`."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, own in groupby(sorted(rows, key=lambda r: (r["doc_id"], r["piece"])), key=lambda r: r["doc_id"]):
        own, ids = list(own), t.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    sequences = 0
    for _, own in groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        sequences += 1
    return sequences


def test_packing_of_the_corpus(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    rows = packing.op10_best_fit_packing(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert held_together(rows, texts) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 2


def test_packing_of_odd_texts(spark):
    texts = [*odd_texts(), "<|endoftext|> x", "a" * 20000, *["tiny"] * 50]
    rows = packing.pack_documents(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    held_together(rows, dict(enumerate(texts)))
    assert packing.pack_documents(empty(spark)).count() == 0
