"""Relations changed by key: versions, conflicts, untouched files, and equality with whole recomputation."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import catalog, tallies
from quillstone.sources.keyed import Keyed, marked, replaced, upserted
from quillstone.sources.snapshots import Conflict

ORDERS = "goid long, subject string, department string, ocr_ok int"


def loads(spark, rows, seq=1):
    return spark.createDataFrame(rows, ORDERS).withColumn("load_seq", F.lit(seq))


def held(df):
    return sorted(map(tuple, df.collect()))


def test_changes_by_key_equal_whole_upserts(spark, tmp_path):
    table = Keyed(spark, str(tmp_path / "t"), "goid", ORDERS, buckets=8)
    assert table.read().count() == 0
    first = loads(spark, [(g, f"s{g}", "old", 0) for g in range(40)])
    again = loads(spark, [(3, "new", "other", 0), (3, "newer", "other", 0), (99, None, "late", 0)], 2).withColumn("load_seq", F.when(F.col("subject") == "newer", 3).otherwise(2))
    assert table.change(first, upserted()) == 1
    files = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert table.change(again, upserted()) == 2
    assert held(table.read()) == held(catalog.upsert_orders(first.unionByName(again)).select("goid", "subject", "department", "ocr_ok"))
    assert held(table.read(1)) == held(first.drop("load_seq"))
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet") if f.name in files} == files  # nothing written over
    state = table.shots.read(2)
    assert len({b for b, v in state["held"].items() if v != table.shots.read(1)["held"].get(b)}) <= 2  # of two keys


def test_marks_and_replacements(spark, tmp_path):
    table = Keyed(spark, str(tmp_path / "t"), "goid", ORDERS, buckets=4)
    table.change(loads(spark, [(g, f"s{g}", "d", 0) for g in range(10)]), upserted())
    table.change(spark.createDataFrame([(2,), (5,), (5,)], "goid long"), marked)
    assert {r["goid"] for r in table.read().where("ocr_ok = 1").collect()} == {2, 5} and table.read().count() == 10
    table.change(spark.createDataFrame([(2, "x", None, 1)], ORDERS), replaced(["goid"]))
    assert table.read().where("goid = 2").first()["subject"] == "x" and table.read().count() == 10


def test_of_two_writers_one_loses_and_readers_stay(spark, tmp_path):
    folder = str(tmp_path / "t")
    table, other = Keyed(spark, folder, "goid", ORDERS, 4), Keyed(spark, folder, "goid", ORDERS, 4)
    at = table.change(loads(spark, [(1, "a", "d", 0)]), upserted())
    reader = table.read()
    other.change(loads(spark, [(1, "b", "d", 0)]), upserted(), after=at)
    with pytest.raises(Conflict):
        table.change(loads(spark, [(1, "c", "d", 0)]), upserted(), after=at)
    assert held(reader) == [(1, "a", "d", 0)] and held(table.read()) == [(1, "b", "d", 0)]
    table.change(loads(spark, [(1, "c", "d", 0)]), upserted())
    assert held(other.read()) == [(1, "c", "d", 0)]
    gone = table.shots.clear(keep=1)
    assert len(gone) == 3 and held(table.read()) == [(1, "c", "d", 0)]


def test_rows_of_other_buckets_are_refused(spark, tmp_path):
    table = Keyed(spark, str(tmp_path / "t"), "goid", ORDERS, 64)
    with pytest.raises(ValueError, match="other buckets"):
        table.change(loads(spark, [(1, "a", "d", 0)]), lambda old, new: new.withColumn("goid", F.col("goid") + 1))
    assert table.read().count() == 0


def test_tallies_follow_inserts_and_changes(spark, tmp_path):
    schema = "goid long, category string, department string, go_date_iso string, ocr_ok int"
    orders = lambda rows: spark.createDataFrame(rows, schema)
    first = [(g, "a" if g % 2 else None, f"d{g % 3}", f"201{g % 4}-01-0{g % 9 + 1}" if g % 5 else None, g % 2) for g in range(30)]
    moved = [(g, "moved", d, "1999-12-31", 1) for g, _, d, _, _ in first[:7]]
    kept = tallies.open_(spark, str(tmp_path / "t"))
    equal = lambda now: held(tallies.facets(kept.read())) == held(catalog.facets(now)) and held(tallies.totals(kept.read())) == held(catalog.totals(now))
    tallies.change(kept, None, orders(first), batch=0)
    assert equal(orders(first))
    tallies.change(kept, orders(first[:7]), orders(moved), batch=1)
    tallies.change(kept, orders(first[:7]), orders(moved), batch=1)  # a repetition changes nothing
    assert equal(orders(moved + first[7:]))
    tallies.change(kept, orders(moved), None, batch=2)
    assert equal(orders(first[7:]))
    tallies.change(kept, orders(first[7:]), None, batch=3)
    assert kept.read().count() == 0 and tallies.totals(kept.read()).first()["orders"] == 0
