"""The engine over small relations: build from files, search with all channels and filters, answers, reruns."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.engine import Config, Engine
from quillstone.functions import embed as em
from quillstone.functions.romanise import romanise
from quillstone.operators import catalog, chunking, fusion, grounding, keyword
from quillstone.sources import readers, sinks
from quillstone.streaming import ingest

TOPICS = ["pension rules for retired teachers of state schools", "road repair budget for the hill districts", "appointment of medical officers in rural hospitals", "water supply scheme for the new town"]


def subject(i):
    return f"{TOPICS[i % 4]} part {i}"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A folder made the way the command line makes it, from metadata and recognised words."""
    from argparse import Namespace

    from quillstone.__main__ import build

    top = tmp_path_factory.mktemp("build")
    (top / "meta").mkdir()
    rows = [{"GOID": 100 + i, "GONo": f"{i}/IT-{i % 3}", "GODate1678": f"{i + 1}-3-20{10 + i}", "Subject": subject(i), "DepartmentNameE": f"Dept {i % 2}", "SectionNameE": f"S{i % 2}", "CategoryNameE": "Order" if i % 2 else "Circular", "FilePath": f"\\files\\{i}.pdf"} for i in range(8)]
    (top / "meta/dept-1.json").write_text(json.dumps({"scraped_at": "x", "department_id": 1, "count": 8, "rows": rows}))
    for i in range(8):
        folder = top / "ocr" / str(100 + i)
        folder.mkdir(parents=True)
        for page in (1, 2):
            lines = ["level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"]
            text = f"{TOPICS[i % 4]} page {page} says that the sanctioned amount is {1000 + i} and refers to No. {(i + 1) % 8}/IT-{(i + 1) % 3}/2019 of the department".split()
            lines += [f"5\t1\t1\t1\t1\t{k}\t{k * 10}\t20\t9\t12\t{80 + page}\t{w}" for k, w in enumerate(text)]
            lines += ["broken\trow", f"5\t1\t1\t1\t2\t1\tx\t20\t9\t12\t80\tbad", f"5\t1\t1\t1\t2\t1\t1\t20\t9\t12\t80\t "]
            (folder / f"page-{page}.tsv").write_text("\n".join(lines))
    build(spark, Namespace(metadata=f"{top}/meta/dept-*.json", words=f"{top}/ocr/*/page-*.tsv", base_url="https://example.org", folder=f"{top}/data"))
    return f"{top}"


def test_build_reads_metadata_and_words(spark, built):
    orders = {r["goid"]: r for r in readers.metadata(spark, f"{built}/meta/dept-*.json", "https://example.org").collect()}
    assert len(orders) == 8 and orders[103]["go_date_iso"] == "2013-03-04" and orders[103]["pdf_url"] == "https://example.org/files/3.pdf"
    words = readers.words(spark, f"{built}/ocr/*/page-*.tsv")
    assert words.groupBy("goid", "page").count().count() == 16 and words.where("text = 'bad'").count() == 0
    engine = Engine.load(spark, f"{built}/data")
    kinds = {r["kind"]: r["count"] for r in engine.passages.groupBy("kind").count().collect()}
    assert kinds == {"ocr": 16, "subject": 8}
    assert [r["chunk_id"] for r in engine.passages.orderBy("chunk_id").collect()] == list(range(1, 25))
    assert engine.orders.where("ocr_ok = 1").count() == 8
    assert engine.vectors.count() == 24 and engine.pages.count() == 16


def test_search_channels_and_filters(spark, built):
    engine = Engine.load(spark, f"{built}/data", config=Config(phonetic_weight=0.3))
    rows = engine.search(["pension rules for teachers", "पेंशन rules"], 10).collect()
    assert {r["qid"] for r in rows} == {0, 1}
    first = [r for r in rows if r["qid"] == 0 and r["position"] == 1][0]
    assert first["goid"] in (100, 104) and first["matched_by"] == "keyword+vector+phonetic" and first["bm25"] < 0 < first["cosine"]
    for filters, want in (({"category": "Order"}, "category = 'Order'"), ({"department": "Dept 0"}, "department = 'Dept 0'"), ({"date_from": "2013-01-01", "date_to": "2014-12-31"}, "go_date_iso between '2013-01-01' and '2014-12-31'"), ({"go_no": "2/IT"}, "go_no like '%2/IT%'"), ({"goid": 101}, "goid = 101")):
        allowed = {r["goid"] for r in engine.orders.where(want).collect()}
        found = {r["goid"] for r in engine.search("pension road water officers department", 10, **filters).collect()}
        assert found and found <= allowed


def test_fused_score_of_three_channels(spark):
    frame = lambda rows, extra: spark.createDataFrame(rows, f"qid long, chunk_id long, rank int{extra}")
    fused = fusion.fuse({"keyword": frame([(1, 7, 1, -2.0), (1, 8, 2, -1.0)], ", bm25 double"), "vector": frame([(1, 8, 1, 0.5)], ", cosine double"), "phonetic": frame([(1, 9, 1, -9.0)], ", bm25 double")}, {"phonetic": 0.3})
    got = {r["chunk_id"]: (round(r["score"], 9), r["place"], r["bm25"], r["cosine"]) for r in fused.collect()}
    assert got == {8: (round(1 / 62 + 1 / 61, 9), 1, -1.0, 0.5), 7: (round(1 / 61, 9), 2, -2.0, None), 9: (round(0.3 / 61, 9), 3, None, None)}


def test_answers_order_facets_and_evaluation(spark, built):
    engine = Engine.load(spark, f"{built}/data", config=Config(expand_subjects=True))
    said = {r["qid"]: r for r in engine.ask(["pension rules for retired teachers", "zzz qqq"]).collect()}
    assert said[0]["found"] and said[0]["kept"] == 1 and not said[1]["found"]
    quote, shown = said[0]["quotes"][0], said[0]["passages"]
    source = engine.passages.where(F.col("chunk_id") == quote["chunk_id"]).first()
    assert quote["text"].split() == source["text"].split()[:12] and quote["box"] == [source[c] for c in grounding.BOX] and quote["go_no"] and quote["page"] == source["page"]
    assert shown[0]["chunk_id"] == quote["chunk_id"] and len(shown) <= 6 and said[0]["dropped_quotes"] == [] and said[0]["provider"] == "extractive"
    assert said[1]["quotes"] == [] and said[1]["passages"] is not None
    strict = Engine.load(spark, f"{built}/data", config=Config(min_cosine=2.0, min_coverage=2.0))
    assert not strict.ask("pension rules for retired teachers").first()["found"]
    own = engine.order(103)
    assert own["order"].count() == 1 and own["pages"].count() == 2 and own["mentions"].count() > 0 and own["related"].count() > 0
    assert engine.facets().count() == 2 + 2 + 8 and engine.health().first()["orders"] == 8
    gold = spark.createDataFrame([(1, TOPICS[0], "en", 100, 1, False, [100, 104]), (2, "zzz", "hi", None, None, True, None)], "qid long, question string, language string, expect_goid long, expect_page int, unanswerable boolean, accept_goids array<long>")
    metrics = engine.evaluate(gold).first()
    assert metrics["n"] == 1 and metrics["hit_at_1"] == 1.0 and metrics["declined_correctly"] == 1.0
    details = {r["qid"]: r for r in engine.answer_details(gold).collect()}
    assert details[1]["found"] and details[1]["cited_expected_order"] and set(details[1]["cited"]) <= {100, 104} and not details[2]["found"]
    answers = engine.evaluate_answers(gold).first()
    assert answers["answered"] == 1.0 and answers["cited_expected_order"] == 1.0 and answers["declined_unanswerable"] == 1.0 and answers["median_seconds"] is None


def test_index_of_phrases_and_odd_passages(spark, tmp_path):
    texts = [(1, "alpha beta alpha"), (2, "beta alpha foo_bar foo bar"), (3, None), (4, ""), (5, "bar foo"), (6, "समिति foo_bar")]
    made = keyword.build(spark.createDataFrame(texts, "chunk_id long, text string"), folder=str(tmp_path / "index"))
    assert made.docs == 6 and made.terms.where("term = 'foo'").first()["df"] == 3
    again = keyword.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "foo_bar"), (2, "alpha alpha"), (3, "?!"), (4, None)], "qid long, question string")
    got = {(r["qid"], r["chunk_id"]) for r in keyword.keyword_search(again, asked, 10).collect()}
    assert got == {(1, 2), (1, 6), (2, 1), (2, 2)}
    none = keyword.build(spark.createDataFrame([], "chunk_id long, text string"))
    assert keyword.keyword_search(none, asked, 10).count() == 0


def test_romanised_words_have_one_key_in_both_scripts(spark):
    rows = spark.createDataFrame([("समिति",), ("samiti",), (None,), ("कक्ष १२",)], "t string").select(romanise(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["samiti", "samiti", "", "kakSha 12"]


def test_subject_hits_without_body_stay(spark):
    body = spark.createDataFrame([(1, 10, 1, 0, "ocr"), (2, 10, 1, 1, "ocr"), (3, 10, 2, 0, "ocr")], "chunk_id long, goid long, page int, ord int, kind string")
    hits = spark.createDataFrame([(1, 91, 10, "subject", 0.5, 1, "keyword"), (1, 92, 11, "subject", 0.4, 2, "keyword"), (1, 3, 10, "ocr", 0.3, 3, "vector")], "qid long, chunk_id long, goid long, kind string, score double, position int, matched_by string")
    got = [(r["place"], r["chunk_id"], r["matched_by"]) for r in fusion.expand_subjects(hits, body).orderBy("place").collect()]
    assert got == [(1, 1, "via subject"), (2, 2, "via subject"), (3, 92, "keyword"), (4, 3, "vector")]


def test_replies_with_and_without_found(spark):
    raw = spark.createDataFrame([(1, '{"answer": "a", "found": null}'), (2, '{"answer": "a"}'), (3, 'x {"answer": "a", "found": false} y'), (4, "words")], "qid long, raw string")
    assert {r["qid"]: r["found"] for r in grounding.parse(raw).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_gate_reason_rounds_halves_to_even(spark):
    questions = spark.createDataFrame([(1,), (2,)], "qid long")
    results = spark.createDataFrame([(1, 1, None, 0.625), (2, 1, None, 0.635)], "qid long, position int, cosine double, lexical_coverage double")
    assert {r["qid"]: r["reason"] for r in grounding.relevance(questions, results).collect()} == {1: "term overlap 62%", 2: "term overlap 64%"}


def test_ingest_adds_nothing_twice(spark, tmp_path):
    words = spark.createDataFrame([(g, 1, 1, 1, line, w, w * 10, line * 20, 9, 12, 90.0, f"word{w}") for g in (1, 2) for line in range(3) for w in range(12)], ingest.WORDS)
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda check: ingest.start(spark, incoming, out, str(tmp_path / check)).awaitTermination()
    held = lambda: spark.read.option("recursiveFileLookup", True).parquet(out).groupBy("goid").count().collect()
    words.where("goid = 1").write.parquet(incoming)
    run("a")
    once = {r["goid"]: r["count"] for r in held()}
    assert set(once) == {1}
    words.write.mode("append").parquet(incoming)  # order 1 comes again beside order 2
    run("a")
    both = {r["goid"]: r["count"] for r in held()}
    assert both == {1: once[1], 2: once[1]}
    run("b")  # a lost checkpoint repeats everything as batch 0
    assert {r["goid"]: r["count"] for r in held()} == both


def test_late_rows_do_not_reopen_windows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(source)
        counts = ingest.event_counts(spark.readStream.schema(schema).parquet(source))
        counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    feed([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)])
    feed([("2024-01-01 09:00:00", "a", 5.0)])
    feed([("2024-01-01 00:30:00", "a", 100.0), ("2024-01-01 15:00:00", "a", 1.0)])
    got = {r["w"]["start"].hour: (r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got[0] == (2, 3.0) and got[9] == (1, 5.0)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"1": {"bytes": 5, "url": "u", "fetched_at": "t"}, "2": {"error": "404 not found"}, "3": {"error": "timeout"}}))
    rows = readers.manifest(spark, str(tmp_path / "manifest.json"))
    assert {r["status"]: r["n"] for r in readers.manifest_counts(rows).collect()} == {"ok": 1, "missing": 1, "failed": 1}
    (tmp_path / "gold.json").write_text(json.dumps([{"id": 2, "question": " "}, {"id": 1, "question": "q", "accept_goids": [3]}, {"id": 3, "question": "r", "unanswerable": True}]))
    assert [(r["qid"], r["unanswerable"]) for r in readers.gold(spark, str(tmp_path / "gold.json")).orderBy("qid").collect()] == [(1, False), (3, True)]
    (tmp_path / "sum.json").write_text(json.dumps([{"goid": "7", "pages_total": 2, "pages": [{"page": 1, "chars": 3}, {"page": 2, "error": "e"}]}]))
    assert readers.summaries(spark, str(tmp_path / "sum.json")).count() == 2
    assert readers.vectors(spark, str(tmp_path / "none")).count() == 0
    sinks.vectors(spark.createDataFrame([(1, [0.5, 0.25])], "chunk_id long, embedding array<double>"), str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v")).first()["embedding"] == [0.5, 0.25]
    sinks.results(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "r").glob("part-*.json"))) == {"a": 1, "b": None}
    (tmp_path / "pdf").mkdir()
    for n in ("12.pdf", "x.pdf", "9.pdf"):
        (tmp_path / "pdf" / n).write_bytes(b"%PDF")
    assert [r["goid"] for r in readers.documents(spark, str(tmp_path / "pdf"), limit=1).collect()] == [9]


def test_encoder_is_stable(spark):
    rows = spark.createDataFrame([("road repair",), ("road repair",), ("",)], "t string").select(em.embed(F.col("t"), em.hashing()).alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-6


def test_numbering_follows_text_order(spark):
    made = spark.createDataFrame([(10, 1, 0, "ocr"), (9, 1, 0, "ocr"), (10, 0, 0, "subject"), (100, 1, 1, "ocr")], "goid long, page int, ord int, kind string")
    assert [(r["goid"], r["kind"]) for r in chunking.number(made).orderBy("chunk_id").collect()] == [(10, "ocr"), (10, "subject"), (100, "ocr"), (9, "ocr")]


def test_resolved_references_are_counted(spark):
    refs = spark.createDataFrame([(1, "2/IT", None), (1, "9/IT", None), (2, "x", 5)], "goid long, ref_text string, target_goid long")
    orders = spark.createDataFrame([(2, "2-IT")], "goid long, go_no string")
    assert catalog.resolved_count(catalog.resolve(refs, orders)).first()["resolved"] == 2
