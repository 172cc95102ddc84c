"""Commits of tables by day: whole or not at all, two writers, resumed backfills."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantwave.sources import committed

ROW = "loop_id string, ts timestamp, pv double, version long"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def tables(spark, tmp_path):
    return committed.CommittedTables(spark, f"file://{tmp_path}/t")


def make(spark, rows):
    return spark.createDataFrame(rows, ROW)


def content(tables):
    df = tables.read("samples")
    return [] if df is None else sorted((r["loop_id"], int((r["ts"] - at(0)).total_seconds()), r["pv"]) for r in df.collect())


def test_merge_and_replace(spark, tables):
    assert tables.read("samples") is None and tables.days("samples") == []
    committed.merge_samples(tables, make(spark, [("a", at(0), 1.0, 1), ("b", at(0), 2.0, 1), ("a", at(90_000), 3.0, 1)]))
    committed.merge_samples(tables, make(spark, [("a", at(0), 9.0, 3), ("a", at(0), 8.0, 2), ("a", at(1), 5.0, 2)]))
    assert content(tables) == [("a", 0, 9.0), ("a", 1, 5.0), ("a", 90_000, 3.0), ("b", 0, 2.0)]
    committed.replace_range(tables, make(spark, [("a", at(2), 7.0, 4)]), ["a"], str(at(0)), str(at(10)))
    assert content(tables) == [("a", 2, 7.0), ("a", 90_000, 3.0), ("b", 0, 2.0)]
    committed.replace_range(tables, make(spark, []), ["a"], str(at(80_000)), str(at(99_000)))
    assert content(tables) == [("a", 2, 7.0), ("b", 0, 2.0)] and tables.days("samples") == ["2024-01-01"]
    assert tables.read("samples", "2024-01-02", "2024-01-03") is None and tables.read("samples", version=1).count() == 3
    assert tables.vacuum() == 0
    for i in range(committed.KEPT):
        committed.merge_samples(tables, make(spark, [("a", at(2), float(i), 10 + i)]))
    assert len(tables.versions()) == committed.KEPT and tables.vacuum() >= 3 and content(tables) == [("a", 2, 4.0), ("b", 0, 2.0)]


def test_a_crash_leaves_the_last_commit(spark, tables, monkeypatch):
    committed.merge_samples(tables, make(spark, [("a", at(0), 1.0, 1), ("a", at(90_000), 1.0, 1)]))
    bad = make(spark, [("a", at(0), 2.0, 2), ("a", at(90_000), 2.0, 2)]).withColumn("pv", F.when(F.col("ts") > F.lit(at(1)), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("pv")))
    with pytest.raises(Exception, match="lost"):
        committed.merge_samples(tables, bad)
    assert content(tables) == [("a", 0, 1.0), ("a", 90_000, 1.0)]
    monkeypatch.setattr(tables, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))  # killed after the data, before the manifest
    with pytest.raises(KeyboardInterrupt):
        committed.merge_samples(tables, make(spark, [("a", at(0), 3.0, 3)]))
    monkeypatch.undo()
    assert content(tables) == [("a", 0, 1.0), ("a", 90_000, 1.0)] and tables.vacuum() >= 1
    committed.merge_samples(tables, make(spark, [("a", at(0), 4.0, 4)]))
    assert content(tables) == [("a", 0, 4.0), ("a", 90_000, 1.0)]


@pytest.mark.parametrize("other_day", [False, True])
def test_two_writers(spark, tables, other_day):
    """A writer that is overtaken keeps what the other wrote, on its own days or others."""
    committed.merge_samples(tables, make(spark, [("a", at(0), 1.0, 1)]))
    second, calls = committed.CommittedTables(spark, tables.path), []

    def build(stored):
        old = stored("samples")
        if not calls:
            committed.merge_samples(second, make(spark, [("b", at(90_000 if other_day else 5), 2.0, 1)]))
        calls.append(1)
        fresh = make(spark, [("c", at(7), 3.0, 1)]).withColumn("day", F.to_date("ts"))
        return {"samples": old.select(fresh.columns).unionByName(fresh)}

    assert tables.commit(["2024-01-01"], build) == 3
    assert content(tables) == sorted([("a", 0, 1.0), ("b", 90_000 if other_day else 5, 2.0), ("c", 7, 3.0)]) and len(calls) == (1 if other_day else 2)


def test_a_number_held_by_a_dead_writer_is_freed(spark, tables):
    committed.merge_samples(tables, make(spark, [("a", at(0), 1.0, 1)]))
    tables._fs.create(tables._file(f"{tables.path}/manifests/_2.lock"), False).close()
    committed.merge_samples(tables, make(spark, [("a", at(1), 2.0, 1)]))
    assert content(tables) == [("a", 0, 1.0), ("a", 1, 2.0)]


def test_backfill_is_incremental_and_resumes(spark, tables):
    hours = [(loop, at(3600 * h), 1) for loop in ("a", "b") for h in (0, 1, 25, 49)]
    wanted = spark.createDataFrame(hours, "loop_id string, hour timestamp, version int")
    asked = []

    def compute(todo):
        asked.append(todo.count())
        return todo.where("loop_id = 'a'").select("loop_id", "hour", (F.col("version") * 1.5).alias("score"))

    stop = iter([False, False, True])
    assert committed.backfill(tables, wanted, compute, lambda: next(stop)) == ["2024-01-01", "2024-01-02"]
    assert tables.days("snapshots") == ["2024-01-01", "2024-01-02"] and asked == [4, 2]
    assert committed.backfill(tables, wanted, compute) == ["2024-01-03"] and asked == [4, 2, 2]
    before = tables.versions()
    assert committed.backfill(tables, wanted, compute) == [] and tables.versions() == before and asked == [4, 2, 2]
    newer = wanted.withColumn("version", F.when((F.col("loop_id") == "a") & (F.col("hour") == F.lit(at(3600))), 2).otherwise(F.col("version")))
    assert committed.backfill(tables, newer, compute) == ["2024-01-01"] and asked[-1] == 1
    got = sorted((r["hour"], r["score"]) for r in tables.read("snapshots").collect())
    assert got == [(at(0), 1.5), (at(3600), 3.0), (at(90_000), 1.5), (at(176_400), 1.5)] and tables.read("ledger").count() == 8

    def broken(todo):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        committed.backfill(tables, newer.withColumn("version", F.lit(9)), broken)
    assert tables.read("ledger").where("version = 9").count() == 0
