"""Alert state over micro-batches: the stream agrees with its batch twin, and timers forget loops."""

import datetime as dt
import random

import pytest

from plantwave.streaming import samples as stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROW = "loop_id long, rule_id string, ts timestamp, hit boolean"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def run(spark, batches, folder, name, **limits):
    """Each batch is a file, each file a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(str(folder / "in" / f"{i:03}"))
    paths = str(folder / "in" / "*")
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(paths)
    q = stream.alerts(source, **limits).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return sorted(tuple(r) for r in spark.sql(f"select * from {name}").collect())


def test_stream_equals_batch(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(loop, f"r{rule}", at(10 * i + loop), rng.random() < 0.7) for i in range(60) for loop in (1, 2) for rule in (0, 1)]
    limits = {"cool_down": 100, "debounce": 25, "throttle": 5}
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    got = run(rocks, batches, tmp_path, "fired", **limits)
    want = sorted(tuple(r) for r in stream.alerts(rocks.createDataFrame(rows, ROW), **limits).collect())
    assert got == want and len(got) > 8 and any(r[4] for r in got)


def test_timers_forget_quiet_loops(rocks, tmp_path):
    day = 86_400
    batches = [[(1, "r", at(0), True)], [(2, "r", at(20 * day), True)], [(2, "r", at(20 * day + 1000), True)], [(1, "r", at(20 * day + 2000), True), (2, "r", at(20 * day + 2000), True)]]
    got = run(rocks, batches, tmp_path, "forgotten", cool_down=500, throttle=5, forget_days=7)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, at(0), 1), (1, at(20 * day + 2000), 1), (2, at(20 * day), 1), (2, at(20 * day + 1000), 2), (2, at(20 * day + 2000), 3)]
