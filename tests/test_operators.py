"""DataFrame operators on small hand-made rows."""

import datetime as dt
import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plantwave.functions.masks import mask
from plantwave.functions.signals import grade, quality, score_grade
from plantwave.operators import diagnosis, identify, kpi, outliers, reports, rollup, rules, segments
from plantwave.plans import hourly
from plantwave.sources import tables
from plantwave.streaming import samples as stream

T0 = dt.datetime(2024, 1, 1)


def at(i):
    return T0 + dt.timedelta(seconds=i)


def test_masks(spark):
    df = spark.createDataFrame([(True, False), (True, True), (None, True)], "pv_valid boolean, sp_valid boolean")
    got = lambda text: [r[0] for r in df.select(mask(text, df.columns)).collect()]
    assert got("pv_valid && sp_valid") == [False, True, False]
    assert got("!(pv_valid && sp_valid) || op_valid") == [True, False, True]
    assert got("") == [True] * 3
    with pytest.raises(ValueError):
        mask("pv_valid; drop", df.columns)


def test_scalars(spark):
    df = spark.createDataFrame([(None, 0.96, None), (0, 0.8, 91.0), (192, 0.1, 59.0), (7, None, 60.0)], "q int, share double, score double")
    rows = df.select(quality("q"), grade("share"), score_grade("score")).collect()
    assert [tuple(r) for r in rows] == [("Good", "A", "INCONCLUSIVE"), ("Bad", "B", "EXCELLENT"), ("Good", "E", "BAD"), ("Unknown", None, "POOR")]


def test_detectors(spark):
    pv = [50.0, 50.0, 50.0, 50.0, 50.0, 50.0, 150.0, None, float("nan"), 10.0, 95.0, 10.0]
    df = spark.createDataFrame([(1, at(i), v, None) for i, v in enumerate(pv)], "loop_id int, ts timestamp, pv double, quality int")
    rows = outliers.detect(df, "pv", ["loop_id"], ["ts"], 0, 100, "FC", "quality").orderBy("ts").collect()
    reasons = [set(r["pv_reasons"]) for r in rows]
    assert all("FROZEN" in r for r in reasons[:6]) and reasons[6] == {"OUT_OF_RANGE", "JUMP"} and reasons[7] == {"NAN"} and reasons[8] == {"NAN"}
    assert reasons[10] == {"JUMP", "SPIKE"} and "JUMP" in reasons[11]
    assert [r["pv_valid"] for r in rows] == [True] * 6 + [False] * 3 + [True, False, False]


def test_islands_hold_and_as_of(spark):
    df = spark.createDataFrame([(1, at(i), f) for i, f in enumerate([True, True, False, True, True, True])], "k int, ts timestamp, ok boolean")
    runs = sorted((r["start"], r["end"], r["points"]) for r in segments.islands(df, "ok", ["k"], ["ts"], 3).collect())
    assert runs == [(4, 6, 3)]
    held = spark.createDataFrame([(1, at(0)), (1, at(2)), (1, at(5)), (2, at(9))], "k int, ts timestamp")
    assert sorted((r["k"], r["d"]) for r in held.withColumn("d", segments.hold("ts", ["k"], ["ts"])).collect()) == [(1, 2.0), (1, 3.0), (1, 3.0), (2, 0.0)]
    right = spark.createDataFrame([(1, at(1), "a"), (1, at(4), None)], "k int, ts timestamp, v string")
    assert [(r["ts"], r["v"]) for r in segments.as_of(held, right, ["k"], "ts", ["v"]).orderBy("k", "ts").collect()] == [(at(0), None), (at(2), "a"), (at(5), None), (at(9), None)]


def test_bounded_segments_keep_every_row(spark):
    df = spark.createDataFrame([(k, at(1700 * i), i) for k, n in ((1, 10), (2, 23), (None, 3)) for i in range(n)], "k int, ts timestamp, i int")
    got = {}
    for r in segments.bounded(df, ["k"], ["ts", "i"], 10).orderBy("k", "i").collect():
        got.setdefault((r["k"], r["segment"]), []).append(r["i"])
    assert got == {(1, 0): list(range(10)), (2, 0): list(range(8)), (2, 1): list(range(8, 16)), (2, 2): list(range(16, 23)), (None, 0): [0, 1, 2]}


@pytest.fixture(scope="module")
def moved_late(spark, tmp_path_factory):
    """Events of a loop whose output moves only after 3600 samples, and whose pv follows with gain 2 and a time constant of 15."""
    rng = np.random.default_rng(8)
    u = np.concatenate([np.full(3600, 50.0), np.repeat(rng.choice([40.0, 60.0], 360), 10)])
    y = 50 + identify.simulate({"a": np.array([-np.exp(-1 / 15)]), "b": np.array([2 * (1 - np.exp(-1 / 15))]), "delay": 3}, u - 50, np.zeros(len(u))) + rng.normal(0, 0.05, len(u))
    rows = [(i, at(i), 7, "view", float(5 * y[i]), json.dumps({"k": u[i]})) for i in range(len(u))]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_process_of_a_loop_that_moves_late(spark, moved_late):
    still, moved = entry.queries()["process_models"](spark, moved_late).orderBy("segment").collect()
    assert still["points"] == moved["points"] == 3600 and still["structure"] == "NONE"
    assert moved["gain"] == pytest.approx(2, rel=0.15) and moved["tau"] == pytest.approx(15, rel=0.25) and moved["grade"] in "ABC"


@pytest.mark.parametrize("name", ["noise_and_oscillation", "settling_times", "stiction_index", "bias_shifts", "diagnosis_findings"])
def test_kernels_see_bounded_segments(spark, moved_late, name):
    assert {r["segment"] for r in entry.queries()[name](spark, moved_late).collect()} == {0, 1}


def test_weighted_means(spark):
    df = spark.createDataFrame([(1, 10.0, None, 1, 0), (1, None, 3.0, 2, 4), (1, 20.0, 2.0, 3, 0), (2, None, 1.0, 1, 1)], "g int, v double, w double, level int, n int")
    rows = df.groupBy("g").agg(rollup.mean_all_rows("v", "w"), rollup.mean_level("v", "level"), rollup.mean_present("v", "n"), rollup.mean_filtered("v", "n")).orderBy("g").collect()
    assert tuple(rows[0])[1:] == (pytest.approx(50 / 6), 8.33, 15.0, None)
    assert tuple(rows[1])[1:] == (None, None, None, None)


def test_evidence(spark):
    df = spark.createDataFrame([([0.8, 0.6],), ([0.7],), ([],)], "c array<double>")
    assert [r[0] for r in df.select(diagnosis.fused(F.col("c"))).collect()] == [pytest.approx(0.48 / 0.56), 0.7, 0.0]


def test_evidence_by_sums(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.6), (1, None), (2, 0.7), (3, None), (4, 1.0), (4, 0.2), (5, 1.0), (5, 0.0), *[(6, 0.3)] * 900, *[(6, 0.7)] * 901], "k int, c double")
    got = {r["k"]: r["c"] for r in df.groupBy("k").agg(diagnosis.fusion(F.col("c")).alias("c")).collect()}
    assert got == {1: pytest.approx(0.48 / 0.56), 2: 0.7, 3: 0.0, 4: 1.0, 5: 0.0, 6: pytest.approx(0.7)}


def test_all_evidence_counts(spark, sf):
    sets = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_discount").collect():
        sets.setdefault((r[0], r[1] % 6), []).append(r[2] * 5 + 0.3)
    found = {(r["loop_id"], r["family"]): r for r in entry.queries()["evidence_fusion"](spark, sf).collect()}
    assert {k: r["hits"] for k, r in found.items()} == {k: len(c) for k, c in sets.items()}
    for k, c in sets.items():
        belief, doubt = math.prod(map(Fraction, c)), math.prod(1 - Fraction(x) for x in c)
        assert found[k]["confidence"] == pytest.approx(float(belief / (belief + doubt)), abs=1e-6)


def test_rules(spark):
    ok = json.dumps({"condition": {"type": "NOT", "conditions": [{"type": "threshold", "field": "x", "operator": ">", "value": 3}]}})
    assert rules.validate(ok) == []
    assert rules.validate("[") and rules.validate(json.dumps({"condition": {"type": "AND", "conditions": []}}))
    assert rules.validate(json.dumps({"condition": {"type": "confidence", "worseThan": "Z"}, "durationCount": 99}))
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert [r[0] for r in df.select(rules.compile_rule(ok)).collect()] == [True, False, True]


def wave(spark, loops=2, seconds=7200):
    df = spark.range(loops * seconds).select((F.col("id") % loops).alias("loop_id"), F.floor(F.col("id") / loops).alias("i"))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i"))
    pv = 50 + 5 * F.sin(F.col("i") / 30) * F.col("loop_id") + F.randn(7) * 0.01
    return df.select("loop_id", ts.alias("ts"), pv.alias("pv"), F.when(F.col("i") % 60 == 0, 50.0).alias("sp"), (50 + 10 * F.sin(F.col("i") / 30)).alias("op"), F.lit(1).alias("mode"), F.lit(192).alias("quality"))


def test_hourly_plan(spark):
    loops = spark.createDataFrame([(0, "FLOW", 7, 1), (1, "LEVEL", 7, 2)], "loop_id long, loop_type string, unit_id long, level int")
    out = hourly.hourly(wave(spark), loops)
    rows = {(r["loop_id"], r["hour"].hour): r for r in out.collect()}
    assert len(rows) == 4
    for r in rows.values():
        assert r["confidence"] == "A" and r["auto_mode_rate"] == 100.0 and 0 <= r["score"] <= 100 and r["status"] == "SUCCESS"
    assert rows[(1, 0)]["is_oscillating"] and rows[(1, 0)]["stability_rate"] < rows[(0, 0)]["stability_rate"]
    tree = spark.createDataFrame([(1, 7), (7, 7)], "root long, node long")
    assert {(r["root"], r["loop_count"]) for r in hourly.nodes(out, loops, tree).collect()} == {(1, 2), (7, 2)}


def test_constant_and_short_windows_raise_nothing(spark):
    rows = [(1, i, at(i), 50.0, 50.0, 0.0, 1) for i in range(5)] + [(2, 0, at(0), 50.0, 51.0, None, None)]
    df = spark.createDataFrame(rows, "loop_id int, event_id int, ts timestamp, pv double, sp double, op double, mode int").withColumns({"quality_status": F.lit("Good"), "faulty": F.lit(False), "d": segments.hold("ts", ["loop_id"], ["ts"])})
    df = kpi.with_moves(df, ["loop_id"], ["ts"])
    got = {r["loop_id"]: r for r in df.groupBy("loop_id").agg(*(v.alias(k) for k, v in kpi.aggregates().items())).collect()}
    assert got[1]["accuracy_rate"] == 100.0 and got[1]["valve_linearity"] == 0.0 and got[1]["saturation_rate"] == 100.0 and got[2]["auto_mode_rate"] is None
    swings = {r["loop_id"]: r for r in kpi.oscillation(df, ["loop_id"], ["ts"]).collect()}
    assert swings[1]["oscillation_rate"] == 0.0 and not swings[2]["is_oscillating"]
    flat = df.groupBy("loop_id").agg(*(c.alias(n) for c, n in zip(reports.regression(F.col("pv"), F.col("e")), ("slope", "cut"), strict=True)))
    assert {r["slope"] for r in flat.collect()} <= {None, 0.0}


def test_scan_prunes_days_and_columns(spark, tmp_path):
    path = str(tmp_path)
    tables.write_samples(wave(spark).withColumn("loop_id", F.col("loop_id").cast("string")), path)
    df = tables.scan(spark, f"{path}/by_day", "2024-01-01 00:00:00", "2024-01-01 00:59:59", ["1"], columns=["pv"])
    assert df.count() == 3600
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<loop_id:string,ts:timestamp,pv:double>" in plan


def test_imports(spark, tmp_path):
    (tmp_path / "long.csv").write_text("tag,ts,value\nA.PV,2024-01-01 00:00:00,1.5\nA.MODE,2024-01-01 00:00:00,2\nA.XX,2024-01-01 00:00:00,9\nA.OP,2024-01-01 00:00:00,bad\n")
    (tmp_path / "wide.csv").write_text("ts,B.PV,B.CV\n2024-01-01 00:00:00,3,4\n")
    (row,) = tables.import_csv(spark, str(tmp_path / "long.csv")).collect()
    assert (row["loop_id"], row["pv"], row["mode"], row["op"]) == ("A", 1.5, 2, None)
    (row,) = tables.import_csv(spark, str(tmp_path / "wide.csv"), "wide").collect()
    assert (row["loop_id"], row["pv"], row["op"]) == ("B", 3.0, 4.0)
    checked = tables.validated(spark.createDataFrame([("a", 5), ("", 50)], "tag string, level int"), ["tag"], {"level": F.col("level") < 10})
    assert [r["errors"] for r in checked.collect()] == [[], ["tag: empty", "level: wrong"]]
    payload = spark.createDataFrame([("A", [at(0), at(1)], [1.0, float("nan")], [2.0, 2.0], [3.0], [1, 2], [1, 5])], "loop_id string, ts array<timestamp>, pv array<double>, sp array<double>, op array<double>, mode array<int>, quality array<int>")
    assert [(r["pv"], r["op"], r["pv_quality"]) for r in tables.payload_rows(payload).collect()] == [(1.0, 3.0, 1), (None, None, None)]


def test_remote_history(spark, tmp_path):
    (tmp_path / "A-0.json").write_text(json.dumps([{"ts": "2024-01-01T00:00:00", "pv": 1.0, "mode": 1}]))
    spark.dataSource.register(tables.HistorySource)
    rows = spark.read.format("loop_history").option("url", f"file://{tmp_path}/{{loop}}-{{chunk}}.json").option("loops", "A").load().collect()
    assert [(r["loop_id"], r["pv"], r["sp"], r["mode"]) for r in rows] == [("A", 1.0, None, 1)]


def run_stream(spark, df, tmp_path, make, name, mode="append"):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.sql(f"select * from {name}").collect()


def test_stream_downsample_equals_batch(spark, tmp_path):
    df = wave(spark, 2, 600).select("loop_id", "ts", "pv")
    path = str(tmp_path / "raw")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    got = run_stream(spark, df, tmp_path, lambda s: stream.downsample(s, ["pv"]), "minutes", "complete")
    want = stream.downsample(df, ["pv"]).collect()
    key = lambda r: (r["loop_id"], r["ts"], r["pv_count"], round(r["pv_avg"], 6))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 20
    assert stream.consistency(df, stream.downsample(df, ["pv"]), "pv").count() == 0


def test_last_known_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, at(0), 1.0, 5.0), (1, at(1), 2.0, None), (2, at(0), None, None)], "loop_id long, ts timestamp, pv double, sp double")
    rows = run_stream(spark, df, tmp_path, lambda s: stream.last_known(s, ["pv", "sp"]), "known")
    assert sorted((r["loop_id"], r["ts"], r["sp"]) for r in rows if r["loop_id"] == 1) == [(1, at(0), 5.0), (1, at(1), 5.0)]


def test_alert_steps_by_hand():
    step = lambda rows, **kw: [(int(t), r, n) for t, r, n in stream.alert_steps(rows, {"rules": {}}, **{"cool_down": 100, "debounce": 0, "throttle": 5, **kw})]
    assert step([(0, "a", True), (0, "b", True), (3, "a", True), (6, "c", True)]) == [(0, "a", 1), (0, "b", 1), (6, "c", 1)]  # the throttle is the loop's
    assert step([(0, "a", True), (10, "a", False), (20, "a", True), (35, "a", True)], debounce=15) == [(35, "a", 1)]  # the break begins the debounce anew
    assert step([(0, "a", True), (50, "a", True), (100, "a", True)]) == [(0, "a", 1), (100, "a", 2)]
    state = {"rules": {}}
    assert stream.alert_steps([(0, "a", True)], state, 100, 10, 5) == [] and stream.alert_steps([(12, "a", True)], state, 100, 10, 5) == [(12, "a", 1)]


def test_late_rows_win(spark, tmp_path):
    store = {"rows": spark.createDataFrame([(1, at(0), 1, 1.0)], "loop_id long, ts timestamp, version int, pv double")}
    sink = stream.merge_late(lambda: store["rows"], lambda df: store.update(rows=spark.createDataFrame(df.collect(), df.schema)), ["loop_id", "ts"], "version")
    sink(spark.createDataFrame([(1, at(0), 3, 7.0), (1, at(0), 2, 5.0)], store["rows"].schema), 0)
    assert [(r["version"], r["pv"]) for r in store["rows"].collect()] == [(3, 7.0)]


def test_set_points_hold_over_hours(spark):
    rows = [(1, at(i), 50.0 if i == 5 else None, 1) for i in range(0, 7300, 100)] + [(2, at(3700), None, None)] + [(1, at(5), 50.0, 1)]
    df = spark.createDataFrame(rows, "loop_id int, ts timestamp, sp double, mode int").withColumn("hour", F.date_trunc("hour", "ts"))
    before = spark.createDataFrame([(2, 7.0, 3), (1, 1.0, 0)], "loop_id int, sp double, mode int")
    got = {(r["loop_id"], r["ts"]): (r["sp"], r["mode"]) for r in segments.carried_over(df, ["sp", "mode"], ["loop_id"], "hour", ["ts"], before).collect()}
    assert got[1, at(0)] == (1.0, 1) and got[1, at(100)] == (50.0, 1) and got[1, at(3700)] == (50.0, 1) and got[1, at(7200)] == (50.0, 1) and got[2, at(3700)] == (7.0, 3)
    assert len(got) == len(rows)


def test_frozen_runs_count_as_faults_only_while_the_output_moves(spark):
    rows = [(loop, at(i), 50.0, 40.0, float(i % 50) if loop == 1 else 20.0, 1, 192) for loop in (1, 2) for i in range(600)]
    df = spark.createDataFrame(rows, "loop_id long, ts timestamp, pv double, sp double, op double, mode int, quality int")
    got = {r["loop_id"]: r for r in hourly.indicators(hourly.prepare(df, spark.createDataFrame([(1,), (2,)], "loop_id long"))).collect()}
    assert got[1]["instrument_fault_rate"] == 100.0 and got[2]["instrument_fault_rate"] == 0.0 and got[1]["sp_mean"] == 40.0 and got[1]["points"] == 600


def test_stored_samples_keep_one_row_a_time(spark, tmp_path):
    path, schema = str(tmp_path), "loop_id string, ts timestamp, pv double, version long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted((r["loop_id"], r["ts"], r["pv"]) for r in spark.read.parquet(f"{path}/by_day").collect())
    tables.merge_samples(make([("a", at(0), 1.0, 1), ("b", at(0), 2.0, 1), ("a", at(90_000), 3.0, 1)]), path)
    tables.merge_samples(make([("a", at(0), 9.0, 3), ("a", at(0), 8.0, 2), ("a", at(1), 5.0, 2)]), path)
    assert read() == [("a", at(0), 9.0), ("a", at(1), 5.0), ("a", at(90_000), 3.0), ("b", at(0), 2.0)]
    tables.replace_range(make([("a", at(2), 7.0, 4)]), path, ["a"], str(at(0)), str(at(10)))
    assert read() == [("a", at(2), 7.0), ("a", at(90_000), 3.0), ("b", at(0), 2.0)]
    tables.replace_range(make([]), path, ["a"], str(at(80_000)), str(at(99_000)))
    assert read() == [("a", at(2), 7.0), ("b", at(0), 2.0)]


def test_hot_rows_serve_loops_that_they_cover(spark):
    hot = spark.createDataFrame([(1, at(s), "hot") for s in range(0, 3601, 30)] + [(2, at(s), "hot") for s in range(1800, 3601, 30)], "loop_id int, ts timestamp, store string")
    cold = spark.createDataFrame([(i, at(s), "cold") for i in (1, 2) for s in range(0, 3601, 60)], "loop_id int, ts timestamp, store string")
    out = tables.hot_or_cold(hot, cold, ["loop_id"], F.lit(at(30)), F.lit(at(3570)))
    assert {(r["loop_id"], r["store"]) for r in out.collect()} == {(1, "hot"), (2, "cold")}


def test_circuit_opens_after_failures_in_a_row():
    import urllib.error

    calls, pauses, plan = [], [], iter([OSError("a"), OSError("b"), b"x", OSError("c"), OSError("d"), OSError("e")])

    def ask():
        calls.append(1)
        out = next(plan)
        if isinstance(out, Exception):
            raise out
        return out

    breaker = tables.Breaker(2, 30.0, pauses.append)
    assert breaker.call(ask) == b"x" and pauses == [30.0] and len(calls) == 3
    with pytest.raises(OSError, match="e"):
        breaker.call(ask)
    assert len(calls) == 6 and pauses == [30.0, 30.0]

    def refuse():
        raise urllib.error.HTTPError("u", 404, "no", None, None)

    with pytest.raises(urllib.error.HTTPError):
        tables.Breaker(2, 30.0, pauses.append).call(refuse)
    assert [tables.reconnect_delay(n) for n in (0, 1, 3, 9)] == [1.0, 2.0, 8.0, 60.0]


def test_history_and_hub_sources(spark, tmp_path):
    import http.server
    import json
    import threading

    class Hub(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            part = self.path.rsplit("/", 1)[1]
            if "history" in self.path:
                body = [{"ts": f"2024-01-01T00:00:0{part}", "pv": 1.5, "mode": 1}]
            else:
                body = [{"offset": n, "loop": "L", "role": r, "ts": f"2024-01-01T00:00:0{n}", "value": str(n), "quality": "192", "flush": 1} for n, r in ((1, "SP"), (2, "PV"), (3, "OP")) if n > int(part)]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Hub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(tables.HistorySource)
        spark.dataSource.register(tables.HubSource)
        df = spark.read.format("loop_history").option("url", base + "/history/{loop}/{chunk}").option("loops", "a,b,c").option("chunks", "2").option("concurrency", "2").load()
        assert df.rdd.getNumPartitions() == 2 and sorted((r["loop_id"], r["ts"].second) for r in df.collect()) == [(i, s) for i in "abc" for s in (0, 1)]
        live = spark.readStream.format("loop_hub").option("url", base + "/live/{after}").load()
        query = live.writeStream.format("memory").queryName("hub").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(60) or not query.exception()
        (row,) = stream.live_rows(spark.table("hub"), ["loop_id", "flush"]).collect()
        assert (row["pv"], row["sp"], row["op"], row["ts"].second, row["pv_quality"], row["mode"]) == (2.0, 1.0, 3.0, 2, 192, None)
    finally:
        server.shutdown()


def test_exports_have_the_sheets_headings(spark, tmp_path):
    tables.export_csv(spark.createDataFrame([(1, None), (2, "x,y")], "loop_id int, tag string"), str(tmp_path / "out"), {"loop_id": "Loop", "tag": "Tag name"})
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["Loop", "Tag name"] and sorted(map(tuple, back.collect())) == [("1", None), ("2", "x,y")]


def test_poor_data_speak_for_no_cause(spark):
    families = spark.createDataFrame([(1, "sensor", 1, 0.9), (2, "sensor", 1, 0.9)], "loop_id int, family string, hits int, confidence double")
    windows = spark.createDataFrame([(1, False, True, 1.0), (2, True, True, 1.0)], "loop_id int, passed boolean, linked boolean, auto_rate double")
    got = {r["loop_id"]: r for r in diagnosis.classify(families, windows, ["loop_id"]).withColumn("s", diagnosis.severity(F.lit(10.0), F.col("confidence"), F.col("primary"))).collect()}
    assert (got[1]["primary"], got[1]["confidence"], got[1]["secondary"], got[1]["pending"], got[1]["s"]) == ("DATA_INSUFFICIENT", 0.0, [], [], None)
    assert got[2]["primary"] == "INSTRUMENT" and got[2]["s"] == "HIGH"


def test_half_cycles_equal_the_plan(spark):
    import numpy as np

    from plantwave.operators import kernels

    rng = np.random.default_rng(4)
    waves = [10 * np.sin(np.arange(400) / 8), rng.normal(size=300), np.round(rng.normal(size=200)), np.zeros(20), np.concatenate([np.zeros(5), np.sin(np.arange(90) / 5)])]
    df = spark.createDataFrame([(n, i, float(v)) for n, w in enumerate(waves) for i, v in enumerate(w)], "loop_id int, i int, e double")
    for r in kpi.oscillation(df, ["loop_id"], ["i"]).collect():
        crossings, half, above, below = kernels.half_cycles(waves[r["loop_id"]])
        assert crossings == r["crossings"] and (half or None) == pytest.approx(r["half_cycle"]) and above == pytest.approx(r["s_a"]) and below == pytest.approx(r["s_b"])
    cycles = {r["loop_id"]: r["is_cycle"] for r in kpi.limit_cycle(df, ["loop_id"], ["i"], "e").collect()}
    assert cycles == {n: kernels.limit_cycle(w) for n, w in enumerate(waves)} and cycles[0] and not cycles[1]
