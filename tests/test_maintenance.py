"""The index kept by segments, ids by ledger, and the stream that maintains both: increments equal a rebuild."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import chunking, ids, index, keyword
from quillstone.sources import readers
from quillstone.sources.snapshots import Conflict, Snapshots
from quillstone.streaming import maintain

WORDS = "river stone harbour winter lantern market copper valley foo_bar समिति the the the of of".split()


def texts(n, seed, first=1):
    r = random.Random(seed)
    return [(first + i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def found(index_, questions, k=5, only=None):
    rows = keyword.keyword_search(index_, questions, k, only).collect()
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["bm25"], 9)) for r in rows)


QUESTIONS = ("river stone", "foo_bar", "समिति the", "of", "copper copper lantern", " ".join(WORDS), "nowhere")


def test_snapshots_let_one_writer_win(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "s"))
    assert shots.current() == (0, {})
    assert shots.commit(0, {"tables": ["a"]}) == 1
    with pytest.raises(Conflict):
        Snapshots(spark, str(tmp_path / "s")).commit(0, {"tables": ["b"]})
    assert shots.current() == (1, {"tables": ["a"]})
    (tmp_path / "s/versions/000000000002.json").touch()
    assert shots.current()[0] == 1  # being written
    with pytest.raises(Conflict):
        shots.commit(1, {})
    (tmp_path / "s/versions/000000000002.json").unlink()
    for name in ("a", "b", "c"):
        (tmp_path / "s" / name).mkdir()
    shots.commit(1, {"tables": ["b"]})
    shots.commit(2, {"tables": ["c"]})
    assert shots.clear(keep=2) == ["a"] and shots.versions() == [2, 3] and shots.read(2) == {"tables": ["b"]}


def test_increments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "LEAST", 20)
    folder, now = str(tmp_path / "i"), {}
    questions = asked(spark, *QUESTIONS)
    for step in range(6):
        new = texts(15, step, 1 + 100 * step) + [(100 * step + 50, None), (100 * step + 51, "")]
        old = [(c, t) for c, t in now.items() if c % 7 == step]
        renewed = [(c, f"{t or ''} river") for c, t in old[:2]]  # some come back under their own id
        made = index.change(spark, folder, frame(spark, new + renewed), frame(spark, old) if old else None, batch=step)
        now = {c: t for c, t in now.items() if (c, t) not in old} | dict(new + renewed)
        again = index.change(spark, folder, frame(spark, new + renewed), frame(spark, old) if old else None, batch=step)
        assert again.version == made.version
    whole = keyword.build(frame(spark, list(now.items())), folder=str(tmp_path / "w"))
    assert (made.docs, round(made.mean, 9)) == (whole.docs, round(whole.mean, 9))
    assert sorted(map(tuple, made.terms.collect())) == sorted(map(tuple, whole.terms.collect()))
    assert found(made, questions) == found(whole, questions) != []
    some = frame(spark, [(c, t) for c, t in now.items() if c % 2]).select("chunk_id")
    assert found(made, questions, 3, some) == found(whole, questions, 3, some)
    assert len(made.state["segments"]) < 6  # size classes have been merged
    held = made.blocks.select("segment").distinct().count()
    assert held <= len(made.state["segments"])


def test_readers_keep_their_version(spark, tmp_path):
    folder = str(tmp_path / "i")
    first = index.change(spark, folder, frame(spark, texts(20, 1)))
    before = found(first, asked(spark, "river"))
    index.change(spark, folder, frame(spark, texts(20, 2, 100)), frame(spark, texts(20, 1)))
    assert found(first, asked(spark, "river")) == before
    assert found(index.load(spark, folder, first.version), asked(spark, "river")) == before
    assert {r[2] for r in found(index.load(spark, folder), asked(spark, "river"))} <= set(range(100, 120))


def test_bounds_hold_and_spans_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 8)
    monkeypatch.setattr(keyword, "SPAN", 8)
    rows = texts(400, 3) + [(500, "lantern copper valley lantern copper valley"), (501, "lantern copper valley"), (502, "valley lantern copper")]
    made = keyword.build(frame(spark, rows), folder=str(tmp_path / "i"))
    lists = keyword.Lists(made, keyword.phrases(asked(spark, "lantern copper valley", "the of", "foo_bar समिति river")))
    best = lists.best(3).collect()
    bounds = {(r["qid"], r["span"]): r["bound"] for r in lists.bounds().collect()}
    scores = lists.scores(lists.spans.select("qid", "span")).collect()
    assert all(-r["bm25"] <= bounds[r["qid"], r["chunk_id"] // 8] + keyword.SLACK for r in scores)
    by = {}
    for r in sorted(scores, key=lambda r: (r["qid"], round(r["bm25"], 9), r["chunk_id"])):
        by.setdefault(r["qid"], []).append(r["chunk_id"])
    assert {(r["qid"], r["rank"], r["chunk_id"]) for r in best} == {(q, i + 1, c) for q, ids_ in by.items() for i, c in enumerate(ids_[:3])}
    assert lists.rest.count() < 0.5 * lists.spans.count()


def read_of(df):
    """(files opened, row groups, rows) of a plan's scans of blocks, from the metrics of its run."""
    df.collect()
    files = rows = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            m = node.metrics()
            files, rows = files + m.apply("numFiles").value(), rows + m.apply("numOutputRows").value()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return files, rows


def test_a_search_of_three_words_opens_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PER_PART", 150)
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    made = keyword.build(frame(spark, [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(600)]), folder=str(tmp_path / "i"))
    all_files, all_rows = read_of(made.blocks.select("term"))
    lists = keyword.Lists(made, keyword.phrases(asked(spark, "w5 w77 w1234")))
    files, rows = read_of(lists.blocks.select("term"))
    assert 0 < files <= 3 < 0.05 * all_files and rows < 0.05 * all_rows


def test_ids_stay_and_repeat(spark, tmp_path):
    made = lambda *goids: spark.createDataFrame([(g, 1, o, "ocr") for g in goids for o in range(2)], "goid long, page int, ord int, kind string")
    got = lambda df: {(r["goid"], r["ord"]): r["chunk_id"] for r in df.collect()}
    folder = str(tmp_path / "ids")
    first = got(ids.numbered(made(10, 9), folder, 0))
    assert first == {(10, 0): 1, (10, 1): 2, (9, 0): 3, (9, 1): 4}
    second = got(ids.numbered(made(1), folder, 1))
    assert second == {(1, 0): 5, (1, 1): 6} == got(ids.numbered(made(1), folder, 1))
    with pytest.raises(ValueError):
        ids.numbered(made(1, 2), folder, 1)
    with pytest.raises(ValueError):
        ids.numbered(made(10, 9), folder, 0)
    assert got(ids.numbered(made(2), folder, 5)) == {(2, 0): 7, (2, 1): 8} and ids.last_batch(spark, folder) == 5


def page(folder, goid, n, seed):
    r = random.Random(seed)
    (folder / str(goid)).mkdir(parents=True, exist_ok=True)
    lines = ["level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"]
    lines += [f"5\t1\t1\t1\t{i // 12}\t{i % 12}\t{i}\t20\t9\t12\t80\t{r.choice(WORDS)}" for i in range(60)]
    (folder / str(goid) / f"page-{n}.tsv").write_text("\n".join(lines))


def test_stream_maintains_relations_and_indexes(spark, tmp_path):
    incoming, folder = tmp_path / "in", str(tmp_path / "data")
    orders = spark.createDataFrame([(g, f"{g}/IT-1", "too short" if g > 2 else f"water supply order {g}") for g in range(1, 9)], "goid long, go_no string, subject string")
    run = lambda check: maintain.start(maintain.page_files(spark, str(incoming)), folder, str(tmp_path / check), orders).awaitTermination()
    held = lambda: {(r["goid"], r["page"], r["ord"]): r["chunk_id"] for r in spark.read.parquet(f"{folder}/passages").collect()}
    for g in (1, 2):
        for n in (1, 2):
            page(incoming, g, n, g * 10 + n)
    run("a")
    first = held()
    assert {g for g, _, _ in first} == {1, 2} and sorted(first.values()) == list(range(1, len(first) + 1))
    page(incoming, 1, 3, 13)  # a page of an order that is there, beside new orders
    page(incoming, 3, 1, 31)
    run("a")
    second = held()
    assert {k: second[k] for k in first} == first and {g for g, _, _ in second} == {1, 2, 3}
    page(incoming, 4, 1, 41)
    run("b")  # a lost checkpoint: everything is offered again, only what is new goes in
    third = held()
    assert {k: third[k] for k in second} == second and {g for g, _, _ in third} == {1, 2, 3, 4}
    whole = spark.read.parquet(f"{folder}/passages")
    questions = asked(spark, *QUESTIONS)
    assert found(index.load(spark, f"{folder}/words"), questions) == found(keyword.build(whole, folder=str(tmp_path / "w")), questions)
    phonetic = keyword.build(whole, tx.phonetic_tokens(maintain.romanise(F.col("text"))), str(tmp_path / "p"))
    assert sorted(map(tuple, index.load(spark, f"{folder}/phonetic").terms.collect())) == sorted(map(tuple, phonetic.terms.collect()))
    words = readers.words(spark, f"{incoming}/*/page-*.tsv").where("not (goid = 1 and page = 3)")
    assert sorted((r["goid"], r["text"]) for r in whole.where("kind = 'subject'").collect()) == [(1, "water supply order 1"), (2, "water supply order 2")]
    assert sorted((r["goid"], r["page"], r["text"]) for r in whole.where("kind = 'ocr'").collect()) == sorted((r["goid"], r["page"], r["text"]) for r in chunking.passages(words).collect())
    assert spark.read.parquet(f"{folder}/pages").count() == 6


def test_a_failed_batch_is_repeated_without_a_trace(spark, tmp_path, monkeypatch):
    incoming, folder = tmp_path / "in", str(tmp_path / "data")
    for g in (1, 2):
        page(incoming, g, 1, g)
    run = lambda: maintain.start(maintain.page_files(spark, str(incoming)), folder, str(tmp_path / "c")).awaitTermination()
    change, calls = index.change, []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:  # the words' index has been changed, the phonetic one has not
            raise RuntimeError("lost")
        return change(*args, **kwargs)

    monkeypatch.setattr(index, "change", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    passages = spark.read.parquet(f"{folder}/passages")
    n = passages.count()
    assert sorted(r["chunk_id"] for r in passages.collect()) == list(range(1, n + 1))
    assert index.load(spark, f"{folder}/words").docs == n == index.load(spark, f"{folder}/phonetic").docs
    assert json.loads(json.dumps(index.load(spark, f"{folder}/words").state))["batch"] == 0


def test_an_engine_over_what_was_ingested(spark, tmp_path):
    """Metadata and page files through the command line's ingest, twice, then search, answers and order pages."""
    from argparse import Namespace

    from quillstone.__main__ import ingest
    from quillstone.engine import Engine, summary
    from quillstone.sources import sinks

    (tmp_path / "meta").mkdir()
    rows = [{"GOID": g, "GONo": f"{g}/IT-1", "GODate1678": f"{g}-3-2012", "Subject": f"water supply scheme {name}", "DepartmentNameE": "D", "SectionNameE": "S", "CategoryNameE": "Order", "FilePath": f"{g}.pdf"} for g, name in ((1, "alpha"), (2, "beta"), (3, "gamma"))]
    (tmp_path / "meta/dept-1.json").write_text(json.dumps({"scraped_at": "x", "department_id": 1, "count": 3, "rows": rows}))
    args = Namespace(metadata=f"{tmp_path}/meta/dept-*.json", base_url="https://example.org", incoming=f"{tmp_path}/ocr", files=None, folder=f"{tmp_path}/data")
    for goids in ((1, 2), (3,)):
        for g in goids:
            page(tmp_path / "ocr", g, 1, g)
        ingest(spark, args)
    engine = Engine.load(spark, f"{tmp_path}/data")
    assert engine.orders.where("ocr_ok = 1").count() == 3 and engine.passages.where("kind = 'subject'").count() == 3
    assert engine.vectors.count() == engine.passages.count() == engine.words.docs
    rows = engine.search("water supply scheme gamma", 5).orderBy("position").collect()
    assert rows[0]["goid"] == 3 and "keyword" in rows[0]["matched_by"] and "vector" in rows[0]["matched_by"]
    said = engine.ask("water supply scheme gamma").first()
    assert said["found"] and said["error"] is None and said["quotes"][0]["goid"] == 3
    assert engine.order(2)["passages"].count() >= 2 and engine.order(2)["pages"].count() == 1
    assert summary(spark, f"{tmp_path}/data").first().asDict() == {"ran": False, "answers": None}
    sinks.results(spark.createDataFrame([(3, 0.5)], "n long, hit_at_1 double"), f"{tmp_path}/data/eval.json")
    sinks.results(spark.createDataFrame([(2, 1.0)], "n long, answered double"), f"{tmp_path}/data/answers.json")
    told = summary(spark, f"{tmp_path}/data").first()
    assert told["ran"] and told["hit_at_1"] == 0.5 and told["answers"]["answered"] == 1.0
