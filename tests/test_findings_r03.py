"""What a review found: steps whose work grew faster than their input, and results that depended on the order of rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantwave.operators import diagnosis, identify, kpi, moments, tuning


def test_half_cycles_are_measured_once_under_a_filter(spark):
    df = spark.createDataFrame([(k, i, float((-1) ** i * (2 + i % k))) for k in (1, 3) for i in range(600)], "k int, i int, e double")
    made = moments.swings(moments.edges(df, "e", ["k"], ["i"]).groupBy("k").agg(moments.edge_list().alias("edges")))
    found = made.where("is_oscillating and half_cycle >= 1")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") < 60
    assert {(r["k"], r["crossings"], r["half_cycle"]) for r in found.collect()} == {(1, 599, 1.0), (3, 599, 1.0)}


def test_families_of_operators_that_found_something(spark):
    rows = [(1, "sensor", True, 0.8), (1, "slow", False, 0.9), (2, "stiction_ellipse", True, 0.8), (2, "stiction_higher_order", False, 0.9), (2, "stiction_statistical", True, 0.6)]
    found = diagnosis.fuse_families(spark.createDataFrame(rows, "k int, operator string, detected boolean, confidence double"), ["k"])
    got = {(r["k"], r["family"], r["hits"], r["confidence"]) for r in found.withColumn("confidence", F.round("confidence", 6)).collect()}
    assert got == {(1, "sensor", 1, 0.8), (2, "stiction", 2, round(0.48 / 0.56, 6))}


def test_equal_distances_from_the_mean_take_the_earliest(spark):
    first, last = 74.53, 88.33
    mean = (first + last) / 2
    assert abs(last - mean) < abs(first - mean)  # by the last bit only
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate([-1.0, first, -5.0, last, -5.0, 1.0])], "k int, i int, e double")
    assert kpi.oscillation(df, ["k"], ["i"]).collect()[0]["s_a"] == pytest.approx(1 - (mean - first) / first)


def test_values_at_the_mean_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, i, x) for i, x in enumerate([216.39, 72.05, 91.02, 293.36, 144.29, 177.51, 4.43, 125.15, 174.41])]
    found = [kpi.limit_cycle(spark.createDataFrame(r, "k int, i int, pv double").coalesce(1), ["k"], ["i"]).collect()[0]["crossings"] for r in (rows, rows[::-1])]
    assert found == [4, 4]


def test_loops_go_through_time_together(spark):
    k, tau, theta = np.array([1.0, 0.5, 2.0, 1.0]), np.array([10.0, 3.0, 30.0, 0.5]), np.array([1.0, 4.0, 1.0, 2.0])
    args = k, tau, theta, tau / (k * (tau + theta)), tau, np.array([0.0, 0.5, 0.0, 0.1])
    t, y = tuning.closed_loops(*args, 100)
    made = tuning.responses_metrics(t, y)
    for i in range(4):
        one = tuning.closed_loop(*(x[i] for x in args), 100)[1]
        assert (one == y[:, i]).all()
        assert tuning.response_metrics(t, one) == {name: x[i] for name, x in made.items()}


def test_extended_least_squares_makes_its_matrix_once(monkeypatch):
    rng, made = np.random.default_rng(4), []
    u = np.repeat(rng.choice([-1.0, 1.0], 40), 5)
    y = identify.simulate({"a": np.array([-0.8]), "b": np.array([0.4]), "delay": 1}, u, np.zeros(200)) + rng.normal(0, 0.01, 200)
    plain = identify.regressors
    monkeypatch.setattr(identify, "regressors", lambda *args: made.append(1) or plain(*args))
    model = identify.fit_armax(y, u, 1, 1, 1, 1)
    assert len(made) == 2  # the first fit's and its own, not one for each round
    assert model["a"][0] == pytest.approx(-0.8, abs=0.02) and model["b"][0] == pytest.approx(0.4, abs=0.02) and len(model["c"]) == 1


def test_findings_of_plain_columns():
    t = np.arange(200)
    columns = {"pv": 10 + np.sin(t / 5), "sp": np.full(200, 10.0), "op": 50 + np.cos(t / 5)}
    assert diagnosis.findings(columns) == diagnosis.findings(pd.DataFrame(columns))
