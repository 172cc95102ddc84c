"""The hourly job by contract: masks by indicator, limits by loop, settling and swings from sums of one grouping."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwave.operators import kpi, moments
from plantwave.plans import hourly

ROW = "loop_id long, ts timestamp, pv double, sp double, op double, mode int, quality int"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def job(spark, rows, loops=None):
    df = spark.createDataFrame(rows, ROW)
    return {r["loop_id"]: r for r in hourly.hourly(df, loops if loops is not None else spark.createDataFrame([(1,)], "loop_id long")).collect()}


def test_a_missing_output_costs_only_what_reads_it(spark):
    noise = random.Random(1)
    rows = [(loop, at(i), 50 + noise.gauss(0, 1), 50.0, None if loop == 1 else 30.0 + i % 2, None if loop == 2 else 1, 192) for loop in (1, 2) for i in range(600)]
    got = job(spark, rows)
    assert got[1]["points"] == 0 and got[1]["auto_mode_rate"] == 100.0 and got[1]["pv_mean"] == pytest.approx(50, abs=0.3) and got[1]["accuracy_rate"] > 0
    assert got[1]["op_mean"] is None and got[1]["saturation_rate"] is None and got[1]["effective_auto_rate"] is None and got[1]["output_trip_index"] is None
    assert got[2]["auto_mode_rate"] is None and got[2]["output_trip_index"] == pytest.approx(0.01) and got[2]["op_mean"] == 30.5
    assert got[1]["status"] == "INCONCLUSIVE" and got[1]["score"] is None


def test_limits_and_ranges_of_each_loop(spark):
    """A jump by half the range is one for a level, none for a flow; the same values lie in one range and outside another."""
    rows = [(loop, at(i), 10.0 if i < 300 else 60.0, 30.0, 40.0 + i % 3, 1, 192) for loop in (1, 2, 3) for i in range(600)]
    loops = spark.createDataFrame([(1, "FLOW", 0.0, 100.0), (2, "LEVEL", 0.0, 100.0), (3, "FLOW", 0.0, 50.0)], "loop_id long, loop_type string, pv_low double, pv_high double")
    df = spark.createDataFrame(rows, ROW)
    faults = {r["loop_id"]: r["n"] for r in hourly.prepare(df, loops).where(F.arrays_overlap("pv_reasons", F.array(F.lit("JUMP"), F.lit("OUT_OF_RANGE")))).groupBy("loop_id").agg(F.count("*").alias("n")).collect()}
    assert faults == {2: 1, 3: 300}


def test_trips_need_runs_of_the_type(spark):
    """Outputs in runs shorter than the type's segment do not move; moves are taken within the mask only."""
    rows = [(loop, at(i), 50.0, 50.0, None if i % (16 if loop == 1 else 40) == 15 else float(i % 2) + 10, 1, 192) for loop in (1, 2) for i in range(600)]
    loops = spark.createDataFrame([(1, "FLOW"), (2, "FLOW")], "loop_id long, loop_type string")
    got = job(spark, rows, loops)
    assert got[1]["output_trip_index"] is None and got[2]["output_trip_index"] > 0


def autoregressive(tau, n, seed=3):
    rng, x, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x = math.exp(-1 / tau) * x + rng.gauss(0, 1)
        out.append(x)
    return out


def solved(spark, series, interval=1.0, least=100):
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    df = moments.lagged(spark.createDataFrame(rows, "k string, i int, e double"), "e", ["k"], ["i"], 10)
    df = df.groupBy("k").agg(*(c.alias(n) for n, c in moments.sums("e", 10).items()))
    df = moments.time_constant(moments.settling(df, "e", F.lit(interval), least), "e", F.lit(interval), least).withColumn("harris", moments.harris("e", 10))
    return {r["k"]: r for r in df.collect()}


def test_settling_of_known_models(spark):
    """Lags of first order settle after tau ln 20; gaps, constants and short windows have outcomes of their own."""
    series = {"30": autoregressive(30, 7200), "60": autoregressive(60, 7200), "flat": [5.0] * 200, "short": [1.0, 2.0] * 10, "sine": [math.sin(i / 5) for i in range(3600)], "noise": autoregressive(0.01, 5000)}
    got = solved(spark, series)
    for tau in (30, 60):
        assert got[str(tau)]["settling_time"] == pytest.approx(tau * math.log(20), rel=0.3) and got[str(tau)]["time_constant"] == pytest.approx(tau, rel=0.3)
        assert got[str(tau)]["harris"] == pytest.approx(1 / (1 - math.exp(-2 / tau)), rel=0.3)
    assert got["flat"]["settling_outcome"] == "ALREADY_STABLE" and got["flat"]["settling_time"] == 0.0 and got["flat"]["time_constant"] is None
    assert got["short"]["settling_outcome"] == "IDENTIFICATION_FAILED" and got["short"]["settling_time"] is None
    assert got["sine"]["settling_time"] > 100 and got["noise"]["settling_time"] <= 3 and got["noise"]["harris"] == pytest.approx(1, abs=0.05)


def test_moments_equal_numpy_and_add_up(spark):
    """Autocovariances are those of the samples; parts with the end of the part before as halo add up to the whole."""
    x = np.array(autoregressive(10, 500))
    y = x - x.mean()
    got = solved(spark, {"x": x.tolist()})["x"]
    for k in range(11):
        assert got[f"e_r{k}"] == pytest.approx(float(y[: len(y) - k] @ y[k:]) / len(y), rel=1e-9)
    a = np.linalg.solve(np.array([[got["e_r0"], got["e_r1"]], [got["e_r1"], got["e_r0"]]]), -np.array([got["e_r1"], got["e_r2"]]))
    one = spark.createDataFrame([tuple(got[c] for c in ("e_r0", "e_r1", "e_r2"))], "e_r0 double, e_r1 double, e_r2 double").select(*(c.alias(n) for n, c in zip("ab", moments.second_order("e"), strict=True))).first()
    assert (one["a"], one["b"]) == pytest.approx(tuple(a))
    mean_free = [(int(i >= 200), int(i), float(v), False) for i, v in enumerate(y)] + [(1, int(i), float(y[i]), True) for i in (198, 199)]
    df = spark.createDataFrame(mean_free, "part int, i int, e double, halo boolean")
    df = df.withColumns({f"e_{k}": F.when(~F.col("halo"), F.col("e") * F.lag("e", k).over(Window.partitionBy("part").orderBy("i"))) for k in (1, 2)})
    both = df.groupBy("part").agg(F.sum("e_1").alias("a"), F.sum("e_2").alias("b")).agg(F.sum("a"), F.sum("b")).first()
    assert tuple(both) == pytest.approx((float(y[:-1] @ y[1:]), float(y[:-2] @ y[2:])))


def test_swings_equal_the_windowed_form(spark):
    rng = random.Random(2)
    rows = [(k, i, 0.0 if rng.random() < 0.05 else math.sin(i / (4 + k)) + rng.gauss(0, 0.3 * k)) for k in range(6) for i in range(300)] + [(9, 0, 1.0), (8, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, e double")
    want = {r["k"]: r for r in kpi.oscillation(df, ["k"], ["i"]).collect()}
    got = {r["k"]: r for r in moments.swings(moments.edges(df, "e", ["k"], ["i"]).groupBy("k").agg(moments.edge_list().alias("edges"))).collect()}
    assert set(got) == {*want, 8}
    for k, r in want.items():
        for c in ("crossings", "s_a", "s_b", "half_cycle", "oscillation_rate", "is_oscillating", "period"):
            assert got[k][c] == (pytest.approx(r[c], rel=1e-6) if isinstance(r[c], float) else r[c]), (k, c)


def test_the_prepared_samples_are_grouped_once(spark):
    df = spark.createDataFrame([(1, at(i), 50.0, 50.0, 40.0, 1, 192) for i in range(10)], ROW)
    plan = hourly.hourly(df, spark.createDataFrame([(1, "FLOW")], "loop_id long, loop_type string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "EvalPython" not in plan and plan.count("Aggregate [") == 2  # what holds from hour to hour, and the indicators
