"""Rules on windows: quality codes, sensors, gates, labels, disturbances, level shifts, triangles, risks; against plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from plantwave.operators import diagnosis, events, folds, reports, sensors


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def frame(spark, series, columns="x double"):
    rows = [(k, at(i), *(v if isinstance(v, tuple) else (v,))) for k, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, f"k string, ts timestamp, {columns}")


G, B, U = "Good", "Bad", "Unknown"


def test_quality_rules_by_runs(spark):
    series = {"twelve": [G] * 200 + [B] * 12, "six": [G] * 200 + [B] * 6 + [G], "many": [G, B, G, G] * 20, "unsure": [G, G, U] * 20, "few": [G] * 200 + [B] * 3 + [G], "none": [G] * 50, "one": [B], "minute": [B] * 70, "long": [B] * 700}
    got = {r["k"]: (r["rule"], r["longest"], r["confidence"]) for r in sensors.quality_rules(frame(spark, series, "quality_status string"), ["k"], ["ts"]).collect()}
    assert got == {"twelve": ("Q001", 12, 0.6), "six": ("Q004", 6, 0.8), "many": ("Q002", 1, 0.6), "unsure": ("Q003", 0, 0.6), "few": ("Q005", 3, 0.4), "none": ("NORMAL", 0, 0.0), "one": ("Q002", 1, 0.6), "minute": ("Q001", 70, 0.75), "long": ("Q001", 700, 0.9)}


def test_sensor_faults(spark):
    rng = random.Random(6)
    noise = lambda n, s=1.0: [rng.gauss(50, s) for _ in range(n)]
    ramp = [50 + i / 10 + rng.gauss(0, 0.5) for i in range(1000)]
    series = {"frozen": noise(400) + [50.0] * 600, "short freeze": noise(900) + [50.0] * 310, "noisy": noise(500, 0.1) + noise(500, 2.0), "drift": ramp, "led": ramp, "sound": noise(1000), "flat then noise": [50.0] * 50 + noise(50), "few": noise(20), "constant": [50.0] * 100, "gaps": [None if i % 5 == 0 else x for i, x in enumerate(noise(200))]}
    sp = {"led": [i / 10 for i in range(1000)]}
    rows = {k: [(x, sp.get(k, [0.0] * len(xs))[i]) for i, x in enumerate(xs)] for k, xs in series.items()}
    got = {r["k"]: r for r in sensors.sensor_faults(frame(spark, rows, "x double, sp double"), "x", "sp", ["k"], ["ts"]).collect()}
    assert {k: r["subtype"] for k, r in got.items()} == {"frozen": "frozen", "short freeze": "noisy" if got["short freeze"]["noise_ratio"] > 3 else "frozen", "noisy": "noisy", "drift": "drift", "led": None, "sound": None, "flat then noise": "noisy", "few": None, "constant": None, "gaps": None}
    assert got["frozen"]["frozen_segment"] == 600 and got["flat then noise"]["noise_ratio"] == 999.0 and got["constant"]["noise_ratio"] == 1.0 and got["gaps"]["points"] == 160
    assert got["drift"]["drift"] == pytest.approx(80, abs=1) and got["noisy"]["noise_ratio"] == pytest.approx(20, rel=0.3)


def test_missing_rows_fail_the_gate(spark):
    rows = [("whole", at(i), True) for i in range(100)] + [("gaps", at(2 * i), True) for i in range(100)] + [("few", at(i), True) for i in range(20)] + [("bad", at(i), i % 10 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, pv_valid boolean")
    got = {r["k"]: (r["passed"], round(r["gaps"], 3)) for r in diagnosis.gate(df, ["k"], diagnosis.expected_points("ts", 1.0)).collect()}
    assert got == {"whole": (True, 0.0), "gaps": (False, round(1 - 100 / 199, 3)), "few": (False, 0.0), "bad": (False, 0.0)}


def test_labels_keep_their_evidence(spark):
    rows = [(1, "STICTION", 0.6, {"a": 1.0}, "x"), (1, "OSCILLATION", 0.9, {"b": 2.0}, "y"), (1, "OSCILLATION", 0.7, {"b": 3.0, "c": 4.0}, "z"), (1, "OSCILLATION", 0.7, {"d": 5.0}, "a"), (2, "SLOW", 0.5, {}, "q")]
    df = spark.createDataFrame(rows, "k int, label string, confidence double, features map<string,double>, source string")
    got = {(r["k"], r["label"]): r for r in diagnosis.distinct_labels(df, ["k"], "source").collect()}
    assert set(got) == {(1, "STICTION"), (1, "OSCILLATION"), (2, "SLOW")}
    best = got[1, "OSCILLATION"]
    odds = 0.9 / 0.1 * (0.7 / 0.3) ** 2
    assert best["confidence"] == 0.9 and best["features"] == {"b": 2.0, "c": 4.0, "d": 5.0} and [o["source"] for o in best["others"]] == ["z", "a"] and best["fused"] == pytest.approx(odds / (1 + odds))
    assert got[2, "SLOW"]["fused"] == 0.5 and got[2, "SLOW"]["others"] == []


def plain_disturbances(pv, sp, ideal, band=2.0, recovery=5, sigma=3.0, least=3.0):
    """Rows one second apart."""
    n = len(pv)
    dev = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
    e, moves = [p - s for p, s in zip(pv, sp, strict=True)], [b - a for a, b in zip(sp, sp[1:], strict=False)]
    limit, sd = band * dev(e), dev(moves)
    tracked = {j for i, m in enumerate(moves) if sd > 0 and abs(m) > sigma * sd for j in range(i + 1, min(n, i + 1 + max(5, int(ideal))))}
    out = [i for i in range(n) if i not in tracked and abs(e[i]) > limit] if dev(e) > 0 else []
    runs = []
    for i in out:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    found = set()
    for a, b in runs:
        if b - a + 1 < least:
            continue
        back = next((i for i in range(b + recovery, n) if all(abs(e[j]) <= limit for j in range(i - recovery + 1, i + 1))), None)
        last = n - 1 if back is None else back
        found.add((a, b, last, float(last - a + 1), back is None))
    return found


def test_disturbances(spark):
    rng = random.Random(8)
    series, want = {}, {}
    for k in range(6):
        sp = [50.0] * 150 + [60.0] * 150
        pv = [s + rng.gauss(0, 0.3) for s in sp]
        for i in range(150, 150 + 12):
            pv[i] -= 10 * math.exp(-(i - 150) / 4)
        for start, length in ((30, 2), (60, 8), (71, 4), (200 + k, 20), (296, 4)):
            for i in range(start, start + length):
                pv[i] += 5
        series[str(k)] = list(zip(pv, sp, strict=True))
        want[str(k)] = plain_disturbances(pv, sp, 30 if k % 2 else 8)
    series["flat"] = [(50.0, 50.0)] * 40
    df = frame(spark, series, "pv double, sp double")
    ideal = F.when(F.col("k").isin("1", "3", "5"), 30.0).otherwise(8.0)
    got = {}
    for r in events.disturbances(df, ["k"], ["ts"], ideal).collect():
        got.setdefault(r["k"], set()).add((r["start"], r["end"], r["recovered"], round(r["seconds"], 6), r["censored"]))
    assert got == {k: v for k, v in want.items() if v} and any(c for v in want.values() for *_, c in v) and len(got) == 6


def plain_shifts(x, window, k=0.5, h=5.0):
    mean = sum(x) / len(x)
    y = [v - mean for v in x]
    sd = math.sqrt(sum(v * v for v in y) / len(y))
    if len(x) < 16 or sd < 1e-9:
        return []
    up = down = 0.0
    out = []
    for i in range(1, len(y)):
        up, down = max(0.0, up + y[i] - k * sd), min(0.0, down + y[i] + k * sd)
        if up > h * sd or -down > h * sd:
            side = 1 if up > h * sd else -1
            before, after = y[max(0, i - window) : i], y[i : i + window]
            if min(len(before), len(after)) >= 5 and (sum(after) / len(after) - sum(before) / len(before)) * side > sd:
                out.append(i)
            up = down = 0.0
    return out


def test_bias_shifts(spark):
    rng = random.Random(9)
    series = {str(k): [rng.gauss(0, 1) + 8 * (i // 150 % 2) for i in range(300 + 100 * k)] for k in range(4)}
    series |= {"flat": [1.0] * 50, "short": [0.0, 9.0] * 5, "noise": [rng.gauss(0, 1) for _ in range(200)]}
    got = {r["k"]: r for r in folds.bias_shifts(frame(spark, series), "x", ["k"], ["ts"]).collect()}
    assert {k: r["places"] for k, r in got.items()} == {k: plain_shifts(x, 30) for k, x in series.items()}
    assert sum(r["shift_count"] for r in got.values()) >= 4 and got["0"]["detected"] and 0 < got["0"]["confidence"] <= 0.95 and not got["flat"]["detected"]


def plain_triangles(t, ys, target, scaled):
    n = len(t)
    size = (n - 2) / (target - 2)
    unit = [(max(y) - min(y) or 1.0) if scaled else 1.0 for y in ys]
    kept = [0]
    for i in range(target - 2):
        a, b, c = int((i + 1) * size) + 1, min(int((i + 2) * size) + 1, n), min(int((i + 3) * size) + 1, n)
        mean = lambda v, b=b, c=c: sum(v[b:c]) / (c - b) if c > b else 0.0
        last, mx = kept[-1], mean(t)
        area = lambda j, last=last, mx=mx, mean=mean: max(abs((t[last] - mx) * (y[j] - y[last]) - (t[last] - t[j]) * (mean(y) - y[last])) / 2 / u for y, u in zip(ys, unit, strict=True))
        kept.append(max(range(a, b), key=lambda j: (area(j), -j)) if b > a else a)
    return [*kept, n - 1]


def test_triangles(spark):
    rng = random.Random(10)
    series = {str(n): [(rng.gauss(0, 1) + math.sin(i / 9), 100 * rng.random()) for i in range(n)] for n in (5, 60, 61, 250, 1000)}
    df = frame(spark, series, "x double, y double")
    for names in (["x"], ["x", "y"]):
        got = {}
        for r in folds.largest_triangles(df, names, ["k"], ["ts"], [], threshold=60, target=25).orderBy("k", "place").collect():
            got.setdefault(r["k"], []).append(int((r["ts"] - at(0)).total_seconds()))
        base = at(0).replace(tzinfo=dt.UTC).timestamp()
        want = {k: plain_triangles([base + i for i in range(len(v))], [[p[c] for p in v] for c in range(len(names))], 25, len(names) > 1) if len(v) > 60 else list(range(len(v))) for k, v in series.items()}
        assert got == want


def test_risk_by_the_last_value(spark):
    df = spark.createDataFrame([(-0.5, 50.0), (-0.5, 60.0), (-0.5, None), (0.5, 50.0), (-5.0, 10.0)], "s double, v double")
    assert [r[0] for r in df.select(reports.contribution("score", F.col("s"), F.col("v"))).collect()] == [15.0, 10.0, 10.0, 0.0, 35.0]
