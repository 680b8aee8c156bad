"""Calls made once a key under failures, page counts of hand-made PDFs, and recognition that resumes."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.functions.pdf import page_count
from quillstone.operators import grounding
from quillstone.operators.once import once
from quillstone.sources import readers, recognition


def counting(folder, fail=(), broken=()):
    """A call that leaves a trace a call, raises on some keys, and can end the first worker that meets some."""

    def call(row):
        with open(f"{folder}/{row['key']}", "a") as f:
            f.write("x")
        if row["key"] in broken and os.path.getsize(f"{folder}/{row['key']}") < 3:
            raise RuntimeError("not yet")
        if row["key"] in fail:
            raise ValueError("never")
        return row["text"].upper()

    return call


def work(spark, *keys):
    return spark.createDataFrame([(k, f"text of {k}") for k in keys], "key string, text string")


def test_results_are_kept_and_failures_are_tried_again(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    call = counting(str(calls), fail={"c"}, broken={"b"})
    rows = {r["key"]: r for r in once(work(spark, "a", "a", "b", "c", None), call, folder, tries=3).collect()}
    assert rows["a"]["value"] == "TEXT OF A" and rows["b"]["value"] == "TEXT OF B" and rows["b"]["tries"] == 3
    assert rows["c"]["value"] is None and rows["c"]["error"] == "ValueError: never" and rows["c"]["tries"] == 3 and set(rows) == {"a", "b", "c"}
    again = once(work(spark, "a", "c", "d"), call, folder, tries=3)
    assert {r["key"]: r["tries"] for r in again.collect()} == {"a": 1, "c": 3, "d": 1}
    assert {f.name: f.stat().st_size for f in calls.iterdir()} == {"a": 1, "b": 3, "c": 3, "d": 1}
    assert not os.path.exists(f"{folder}/notes")


def test_a_run_that_broke_off_does_not_call_again(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    plain, traces = counting(str(calls)), str(calls)

    class Killed(BaseException):
        pass

    def dying(row):
        if len(os.listdir(traces)) >= 5:
            raise Killed  # not an error of the call: the worker is gone
        return plain(row)

    keys = [f"k{i}" for i in range(12)]
    with pytest.raises(Exception, match="Killed"):
        once(work(spark, *keys).coalesce(1), dying, folder)
    made = {f.name for f in calls.iterdir()}
    assert 0 < len(made) < 12
    assert once(work(spark, *keys), plain, folder).where("value is not null").count() == 12
    assert all(f.stat().st_size == 1 for f in calls.iterdir())


def test_a_prompt_is_asked_once_and_errors_are_told(spark, tmp_path):
    traces = tmp_path / "calls"
    traces.mkdir()

    def model(batches):
        for b in batches:
            for p in b["prompt"]:
                with open(traces / p, "a") as f:
                    f.write("x")
                if p == "bad":
                    raise TimeoutError("slow")
            yield b.assign(raw=b["prompt"].str.upper())[["qid", "raw"]]

    asked = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two"), (4, "bad")], "qid long, prompt string")
    for _ in range(2):
        got = {r["qid"]: (r["raw"], r["error"]) for r in grounding.ask_once(asked, model, str(tmp_path / "replies"), tries=2).collect()}
        assert got == {1: ("ONE", None), 2: ("ONE", None), 3: ("TWO", None), 4: (None, "TimeoutError: slow")}
    assert {f.name: f.stat().st_size for f in traces.iterdir()} == {"one": 1, "two": 1, "bad": 2}


def pdf(kids, packed=False):
    """A PDF whose page tree is a nested list: an inner list is a node, anything else a page."""
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R /Note (a \\) 9 0 R >>) >>"}

    def node(number, items):
        own = []
        for item in items:
            own.append(max(objects | {number: b""}) + 1)
            objects[own[-1]] = b"<< /Type /Page /MediaBox [0 0 9 9] >>"
            if isinstance(item, list):
                node(own[-1], item)
        objects[number] = b"<< /Type /Pages /Count 99 /Kids [" + b" ".join(b"%d 0 R" % k for k in own) + b"] >>"

    node(2, kids)
    out, places = b"%PDF-1.7\n", {}
    if not packed:
        for n, body in sorted(objects.items()):
            places[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
        at = len(out)
        rows = b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places))
        return out + b"xref\n0 1\n0000000000 65535 f \n1 %d\n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(places), rows, len(places) + 1, at)
    bodies = [objects[n] for n in sorted(objects)]
    starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
    head = b" ".join(b"%d %d" % (n, s) for n, s in zip(sorted(objects), starts, strict=True)) + b" "
    body = zlib.compress(head + b" ".join(bodies))
    holder, table = len(objects) + 1, len(objects) + 2
    places[holder] = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (holder, len(bodies), len(head), len(body), body)
    at = len(out)
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, 0, holder, i]) for i in range(len(bodies))] + [bytes([1]) + places[holder].to_bytes(2, "big") + b"\0", bytes([1]) + at.to_bytes(2, "big") + b"\0"]
    above, coded = bytes(4), b""
    for row in rows:
        coded += b"\2" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    coded = zlib.compress(coded)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (table, table + 1, len(coded), coded)
    return out + b"startxref\n%d\n%%%%EOF" % at


@pytest.mark.parametrize("packed", [False, True])
def test_pages_of_made_files(packed):
    assert page_count(pdf(["p"], packed)) == 1
    assert page_count(pdf(["p", ["p", "p", ["p"]], [], "p"], packed)) == 5
    assert page_count(pdf([], packed)) == 0


def test_pages_of_broken_files():
    whole = pdf(["p", "p"])
    assert page_count(None) == page_count(b"") == page_count(b"%PDF-1.4 nothing") == page_count(whole[:200]) == 0
    assert page_count(whole.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R")) == 0
    assert page_count(whole.replace(b"/Kids [3 0 R 4 0 R]", b"/Kids [2 0 R 4 0 R]")) == 0  # a node below itself
    older = whole + b"\n4 0 obj\n<< /Type /Pages /Kids [3 0 R] >>\nendobj\n"
    assert page_count(older) == 2  # what no table names is not there


def test_recognition_resumes_by_page(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for name, kids in (("7", ["p", "p", "p"]), ("8", ["p"])):
        (tmp_path / "pdf" / f"{name}.pdf").write_bytes(pdf(kids))
    (tmp_path / "pdf" / "9.pdf").write_bytes(b"no pdf")
    calls = tmp_path / "calls"
    calls.mkdir()
    counted = recognition.page_counts(readers.documents(spark, str(tmp_path / "pdf")))
    assert {r["goid"]: r["pages_total"] for r in counted.collect()} == {7: 3, 8: 1, 9: 0}
    traces = str(calls)

    def engine(path, page):
        with open(f"{traces}/{path.rsplit('/', 1)[1]}-{page}", "a") as f:
            f.write("x")
        if page == 2:
            raise OSError("blank")
        return "\t".join(["5", "1", "1", "1", "1", "1", "0", "0", "9", "9", "90", f"word{page}"])

    made = recognition.recognised(counted, engine, str(tmp_path / "ledger"))
    assert {(r["goid"], r["page"], r["error"]) for r in made.collect()} == {(7, 1, None), (7, 2, "OSError: blank"), (7, 3, None), (8, 1, None)}
    assert {(r["goid"], r["pages_done"], r["failed"]) for r in recognition.progress(counted, made).collect()} == {(7, 2, 1), (8, 1, 0), (9, 0, 0)}
    assert sorted(r["text"] for r in readers.page_words(made.where("value is not null")).select(F.col("text")).collect()) == ["word1", "word1", "word3"]
    recognition.recognised(counted, engine, str(tmp_path / "ledger")).collect()
    assert all(f.stat().st_size == 1 for f in calls.iterdir())
