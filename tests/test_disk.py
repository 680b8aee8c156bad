"""What loads, merges and the stream hold on disk: shuffles and tables on the way go once they have been read."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.operators import chunking, index
from quillstone.plans import fixtures as fx
from quillstone.plans import registry
from quillstone.sources import readers
from quillstone.sources.stored import scratch, written
from quillstone.streaming import maintain
from tests.sessions import SMALL, agree


def size(path, begin=""):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path.removeprefix("file:")) for f in files if f.startswith(begin))


def shuffled(spark):
    """Bytes of shuffle files that lie on disk."""
    return sum(size(d.getPath(), "shuffle_") for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())


def test_a_load_leaves_its_segment_alone(spark, tmp_path):
    top = os.path.dirname(scratch(spark)).removeprefix("file:")
    rows, folder = fx.passages(spark, SMALL).select("chunk_id", "text"), str(tmp_path / "i")
    before, tables = shuffled(spark), set(os.listdir(top))
    made = index.change(spark, folder, rows, batch=0)
    assert set(os.listdir(top)) == tables  # not the tokens
    assert shuffled(spark) - before < 0.1 * size(f"{folder}/blocks")
    made = index.change(spark, folder, gone=rows.where("chunk_id % 3 = 0"), batch=1)
    assert set(os.listdir(top)) == tables and made.terms.count()  # nor the texts that were taken out


def test_an_index_that_was_maintained_keeps_no_merged_segment(spark):
    made = fx.maintained(spark, SMALL)
    assert len(os.listdir(made.folder.removeprefix("file:") + "/blocks")) == len(made.state["segments"])


def test_bundles_are_a_row_a_part_and_come_back_as_blocks():
    r = np.random.default_rng(2)
    rows = pa.table({"chunk_id": [-1500, -3, 0, 7, 1000], "ts": ["\n".join(f"w{i}" for i in r.integers(0, 90, n)) for n in (40, 1, 200, 90, 300)]})
    rows = rows.append_column("dl", pa.array([40, 1, 200, 90, 300], pa.int32()))
    bundles = index._counted(1024, 4, 64)(rows)
    assert len(bundles) <= 8  # 4 parts, and a bunch on either side of 0
    held = {}
    for i in range(len(bundles)):
        blocks = index._joined(1024, 100.0)(bundles.slice(i, 1))
        n = index.whole(blocks["n"])
        at, c = 0, np.split(index.widened(blocks["places"]), np.cumsum(index.widened(blocks["tfs"])))
        for j, id_ in enumerate(index.ids_of(blocks, n, 1024)):
            held[int(id_), np.repeat(blocks["term"].to_pylist(), n)[j]] = list(c[j])
        assert set(blocks["part"].to_pylist()) == {bundles["part"][i].as_py()}
    want = {}
    for id_, ts in zip(rows["chunk_id"].to_pylist(), rows["ts"].to_pylist(), strict=True):
        for place, w in enumerate(ts.split("\n")):
            want.setdefault((id_, w), []).append(place)
    assert held == want


def test_a_merge_of_parts_at_a_time_equals_one_in_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PER_PART", 1 << 10)
    rows = fx.passages(spark, SMALL).select("chunk_id", "text")
    for name, most in (("a", 1 << 26), ("b", 1 << 12)):
        monkeypatch.setattr(index, "PER_MERGE", most)
        for step in range(4):  # the fourth fills the size class
            made = index.change(spark, str(tmp_path / name), rows.where(F.col("chunk_id") % 4 == step), rows.where("chunk_id % 8 = 1") if step == 2 else None, batch=step)
        assert len(made.state["segments"]) == 1
    got = [sorted(map(tuple, index.load(spark, str(tmp_path / n)).blocks.drop("segment").collect())) for n in "ab"]
    assert got[0] == got[1] and got[0]
    assert agree(index.load(spark, str(tmp_path / "a")).terms.select("term"), "select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{Co}][\\p{L}\\p{N}\\p{Co}\\x{0300}-\\x{0331}]*')) as term from documents where doc_id % 8 <> 1", SMALL)


def odd_pages(spark):
    line = lambda block, par, line, word, text, conf="80", x="3": f"5\t1\t{block}\t{par}\t{line}\t{word}\t{x}\t20\t9\t12\t{conf}\t{text}"
    many = [line(b, p, n, w, f"w{b}{p}{n}{w}", x=str(w * 7)) for b in (2, 1) for p in (1, 2) for n in (9, 3, 10) for w in (2, 0, 1, 11, 1)]
    values = [
        "\n".join(many), "\r\n".join(many[::-1]), "level\tpage\tblock\n" + many[0], "", None, "\n\n", line(1, 1, 1, 1, "alone"), line(1, 1, 1, 1, "---"), line(1, 1, "x", 1, "no"), line(1, 1, 1, 1, "  "),
        "\n".join(line(1, 1, n // 9, n % 9, f"t\u200b{n}", conf="12.5") for n in range(300)), "\n".join([line(1, 1, 1, w, "....") for w in range(9)] + [line(1, 1, 2, w, "kept", conf="-1") for w in range(9)]),
        "\n".join(line(1, 1, 1, w, t) for w, t in enumerate("PG-1/2-A-B Department".split())) + "\n" + line(" 2", "+1", 1, 1, "seven") + "\textra cells\there",
    ]
    return spark.createDataFrame([(i, 1 + i % 2, v) for i, v in enumerate(values)] + [(None, 1, many[0]), (99, None, many[0])], maintain.PAGES)


def test_pages_in_one_row_equal_pages_of_word_rows(spark):
    for rows in (odd_pages(spark), written(fx.page_rows(spark, SMALL))):
        paged, words = chunking.paged(readers.listed_words(rows)), readers.page_words(rows)
        assert "Exchange" not in paged._jdf.queryExecution().executedPlan().toString()  # no words are sent
        paged, made = written(paged).where("words > 0"), chunking.passages(words)
        drop = lambda df: sorted(map(tuple, df.drop("word_ids").collect()), key=repr)
        assert drop(chunking.passages_of(paged)) == drop(made) != []
        assert drop(chunking.pages_of(paged)) == drop(chunking.pages(words, made)) != []


def test_a_page_that_comes_twice_at_once_is_put_together(spark):
    rows = odd_pages(spark).where("goid is not null and page is not null")
    twice = rows.unionByName(rows.where("goid < 4"))
    first = maintain.FirstOnly()
    first.taken = type("", (), {"exists": lambda s: False, "update": lambda s, v: None})()
    put = [tuple(r) for g in range(13) for r in next(first.handleInputRows((g,), iter([twice.where(f"goid = {g}").toPandas()]), None)).itertuples(index=False)]
    together = written(chunking.paged(readers.listed_words(spark.createDataFrame(put, maintain.PAGES))))
    words = readers.page_words(twice)
    assert sorted(map(tuple, chunking.passages_of(together).drop("word_ids").collect())) == sorted(map(tuple, chunking.passages(words).drop("word_ids").collect()))


def test_the_stream_keeps_no_words_and_no_tables_on_the_way(spark):
    top = os.path.dirname(scratch(spark)).removeprefix("file:")
    tables = set(os.listdir(top))
    passages = registry.streamed_passages(spark, SMALL)
    incoming, folder = sorted(set(os.listdir(top)) - tables, key=lambda n: "data" in os.listdir(f"{top}/{n}"))  # these two alone
    assert sorted(os.listdir(f"{top}/{folder}/data")) == ["ids", "pages", "passages", "phonetic", "words"] and os.listdir(f"{top}/{incoming}") == ["second"]
    assert passages.count()
