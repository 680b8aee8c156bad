"""Fetching with a local transport: counters, resumption, files that are no PDFs, passing and lasting failures."""

import os

from quillstone.sources import fetch, readers


def transport(folder):
    def get(url):
        name = url.rsplit("/", 1)[1]
        trace = f"{folder}/{name}.asked"
        with open(trace, "a") as f:
            f.write("x")
        if name == "gone":
            raise fetch.Missing(url)
        if name == "slow" and os.path.getsize(trace) < 3 or name == "never":
            raise TimeoutError("slow")
        return b"<html>" if name == "page" else b"%PDF-1.4 " + b"x" * (10 if name == "small" else 2000)

    return get


def test_fetch_counts_and_resumes(spark, tmp_path):
    traces, out = tmp_path / "traces", tmp_path / "pdf"
    traces.mkdir()
    names = ["a", "b", "gone", "slow", "never", "page", "small"]
    work = spark.createDataFrame([(i, f"https://example.org/{n}") for i, n in enumerate(names)] + [(0, "https://example.org/a"), (None, "x"), (9, None)], "goid long, url string")
    run = lambda: {r["goid"]: r for r in fetch.fetched(work, transport(str(traces)), str(out), 3, 0.0).collect()}
    first = run()
    assert {g: r["status"] for g, r in first.items()} == {0: "ok", 1: "ok", 2: "missing", 3: "ok", 4: "failed", 5: "failed", 6: "ok"}
    assert first[0]["bytes"] == 2009 and first[2]["error"].startswith("404") and first[5]["error"] == "ValueError: not a PDF"
    assert sorted(os.listdir(out)) == ["0.pdf", "1.pdf", "3.pdf", "6.pdf"]
    assert {n: (traces / f"{n}.asked").stat().st_size for n in names} == {"a": 1, "b": 1, "gone": 1, "slow": 3, "never": 3, "page": 3, "small": 1}
    second = spark.createDataFrame([tuple(r) for r in run().values()], fetch.OUTCOME)
    assert tuple(fetch.counters(second).first()) == (1, 3, 1, 2)  # a file too small to be whole comes again
    assert readers.documents(spark, str(out)).count() == 4
