"""Diagnosis of a loop's window: data gate, kernels by loop and window, evidence fusion, cause classification."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds, kernels, moments, sensors
from .segments import seconds

# Causes, and the causes that each makes doubtful.
FAMILIES = {"oscillation_fft": "oscillation", "oscillation_iae": "oscillation", "stiction_ellipse": "stiction", "stiction_higher_order": "stiction", "stiction_statistical": "stiction", "sensor": "sensor", "saturation": "saturation", "overshoot": "overshoot", "slow": "slow", "bias_shift": "bias_shift"}
CONTAMINATES = {"COMMUNICATION": ("INSTRUMENT", "VALVE", "PROCESS", "TUNING"), "INSTRUMENT": ("VALVE", "PROCESS", "TUNING"), "VALVE": ("TUNING",), "PROCESS": ("TUNING",)}

FINDINGS = "operator string, detected boolean, confidence double, value double"


def findings(window: Mapping[str, np.ndarray] | pd.DataFrame, interval: float = 1.0, span: float = 100.0, loop_type: str = "OTHER") -> list[tuple[str, bool, float, float | None]]:
    """What needs a spectrum, a lag search or the shape of a response, on one window of one loop, ordered in time."""
    pv, sp, op = (kernels.filled(np.asarray(window[c], float)) for c in ("pv", "sp", "op"))
    moves = np.diff(op)
    out: list[tuple[str, bool, float, float | None]] = []
    found, frequency, _, index = kernels.spectrum_oscillation(pv, interval)
    out.append(("oscillation_fft", found, min(1.0, index * 1.5) if found else 0.0, frequency))
    outcome, minor, fit = kernels.stiction_fit(op, pv, interval)
    stuck = outcome == "CYCLE" and fit >= 0.5 and minor > 30
    out.append(("stiction_ellipse", bool(stuck), min(1.0, (fit + minor / 100) / 2) if stuck else 0.0, minor))
    shape, pairs = kernels.gaussianity(moves), kernels.bicoherence(op)
    stuck = shape > 1 and pairs > 0.01
    out.append(("stiction_higher_order", bool(stuck), min(1.0, pairs * 10) if stuck else 0.0, pairs))
    runs = _monotone(op)
    stiff = [abs(op[b] - op[a]) < 0.05 * span and abs(pv[b] - pv[a]) > 0.2 * span for a, b in runs]
    share = float(np.mean(stiff)) if stiff else 0.0
    out.append(("stiction_statistical", share > 0.6, share if share > 0.6 else 0.0, share))
    steps = kernels.step_response(pv, sp, span)
    worst = max(steps, default=(0.0, 0.0, 0.0))
    poor = sum((worst[0] > 0.25, worst[1] > 0.25, worst[2] > 0.05)) >= 2
    out.append(("overshoot", bool(poor), min(1.0, worst[0]) if poor else 0.0, worst[0]))
    slow, sure, tau = kernels.slow_response(np.arange(len(pv)) * interval, pv, sp, loop_type)
    out.append(("slow", slow, sure, tau))
    return out


def _monotone(x: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Runs in which x moves one way."""
    sign = np.sign(np.diff(x))
    cuts = np.flatnonzero(np.diff(sign) != 0) + 1
    edges = [0, *cuts.tolist(), len(sign)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a >= least and sign[a] != 0]


def swinging(df: DataFrame, keys: list[str], by: list[str], interval: float = 1.0, threshold: float = 0.4, least_half: float = 8) -> DataFrame:
    """oscillation_iae: half cycles of the error of like areas, long enough."""
    made = moments.edges(df.withColumn("_e", F.col("pv") - F.col("sp")), "_e", keys, by).groupBy(*keys).agg(moments.edge_list().alias("edges"))
    out = moments.swings(made, threshold)
    alike = F.when(F.col("crossings") >= 4, F.coalesce(F.least("s_a", "s_b"), F.lit(0.0))).otherwise(0.0)
    found = F.coalesce(F.col("is_oscillating") & (F.col("half_cycle") >= least_half), F.lit(False))
    return out.select(*keys, F.lit("oscillation_iae").alias("operator"), found.alias("detected"), F.when(found, F.least(F.lit(1.0), 1.5 * alike)).otherwise(0.0).alias("confidence"), F.when(alike > 0, 2 * F.col("half_cycle") * interval).otherwise(0.0).alias("value"))


def saturated(df: DataFrame, keys: list[str], margin: float = 2.0, least: float = 0.2) -> DataFrame:
    """saturation: the share of samples in automatic whose output is at a limit."""
    share = F.avg(F.coalesce((F.col("mode") > 0) & ((F.col("op") >= 100 - margin) | (F.col("op") <= margin)), F.lit(False)).cast("double"))
    out = df.groupBy(*keys).agg(share.alias("value"))
    found = F.col("value") > least
    return out.select(*keys, F.lit("saturation").alias("operator"), found.alias("detected"), F.when(found, F.col("value")).otherwise(0.0).alias("confidence"), "value")


def run_operators(df: DataFrame, keys: list[str], by: list[str], interval: float = 1.0, span: float = 100.0) -> DataFrame:
    """(keys, operator, detected, confidence, value); the keys bound a group in time, such as loop and hour.

    Half cycles, saturation, sensor faults and level shifts are windows, groupings and folds in Spark; findings() sees the rest, as Arrow columns: loops have few samples, and a group of few costs more as a pandas frame than in its kernels."""
    types = dict(df.dtypes)

    def run(key: tuple[pa.Scalar, ...], window: pa.Table) -> pa.Table:
        ordered = window.sort_by([(c, "ascending") for c in by])
        operator, detected, confidence, value = zip(*findings({c: ordered[c].to_numpy() for c in ("pv", "sp", "op")}, interval, span), strict=True)
        own = {name: pa.array([k.as_py()] * len(operator), k.type) for name, k in zip(keys, key, strict=True)}
        return pa.table(own | {"operator": pa.array(operator, pa.string()), "detected": pa.array(map(bool, detected), pa.bool_()), "confidence": pa.array(confidence, pa.float64()), "value": pa.array(value, pa.float64())})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + FINDINGS
    shaped = df.select(*keys, *by, "pv", "sp", "op").groupBy(*keys).applyInArrow(run, schema)
    faults = sensors.sensor_faults(df, "pv", "sp", keys, by).select(*keys, F.lit("sensor").alias("operator"), F.col("subtype").isNotNull().alias("detected"), "confidence", F.col("frozen_share").alias("value"))
    shifts = folds.bias_shifts(df.withColumn("_e", F.col("pv") - F.col("sp")), "_e", keys, by).select(*keys, F.lit("bias_shift").alias("operator"), "detected", "confidence", F.col("shift_count").cast("double").alias("value"))
    return shaped.unionByName(swinging(df, keys, by, interval)).unionByName(saturated(df, keys)).unionByName(faults).unionByName(shifts)


def gate(df: DataFrame, keys: list[str], expected: Column, least: int = 32) -> DataFrame:
    """(keys, points, valid, gaps, passed): enough points, a valid share of 0.20, and at most 30 % of the expected points
    missing; expected: an aggregate, such as the window's length over the sampling interval."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.avg(F.col("pv_valid").cast("double")).alias("valid"), expected.alias("_expected"))
    gaps = F.when(F.col("_expected") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("points") / F.col("_expected")))).otherwise(1.0)
    out = out.withColumn("gaps", gaps).drop("_expected")
    return out.withColumn("passed", (F.col("points") >= least) & (F.col("valid") >= 0.20) & (F.col("gaps") <= 0.30))


def expected_points(ts: str, interval: float) -> Column:
    """Aggregate: the points that a window's span and interval let expect."""
    return F.floor((F.max(seconds(ts)) - F.min(seconds(ts))) / interval) + 1


def fused(confidences: Column) -> Column:
    """Evidence of an array of confidences: product of beliefs over that plus the product of doubts; one alone is unchanged."""
    belief = F.aggregate(confidences, F.lit(1.0), lambda a, x: a * x)
    doubt = F.aggregate(confidences, F.lit(1.0), lambda a, x: a * (1 - x))
    return F.when(F.size(confidences) == 0, 0.0).when(F.size(confidences) == 1, F.element_at(confidences, 1)).when(belief + doubt > 0, belief / (belief + doubt)).otherwise(0.0)


def fusion(confidence: Column) -> Column:
    """fused() as an aggregate over rows: sums of log odds, so that no group is collected and no product underflows."""
    inner = (confidence > 0) & (confidence < 1)
    odds = F.coalesce(F.sum(F.when(inner, F.ln(confidence) - F.ln(1 - confidence))), F.lit(0.0))
    sure, never = F.coalesce(F.max(confidence >= 1), F.lit(False)), F.coalesce(F.max(confidence <= 0), F.lit(False))
    return F.when((F.count(confidence) == 0) | never, 0.0).when(sure, 1.0).when(F.count(confidence) == 1, F.max(confidence)).otherwise(1 / (1 + F.exp(-odds)))


def fuse_families(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, hits, confidence) of the operators that detected something.

    A filter before the grouping would have every operator's folds done once more, within the filter."""
    family = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))[F.col("operator")]
    sure = F.when(F.col("detected"), F.col("confidence"))
    out = found.groupBy(*keys, family.alias("family")).agg(F.count(sure).cast("int").alias("hits"), fusion(sure).alias("confidence"), F.max("detected").alias("_any"))
    return out.where("_any").drop("_any")


def classify(families: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, primary, confidence, secondary, pending): an ordered table of causes, the first that applies leads.

    windows: (keys, passed, linked, auto_rate). Causes that a stronger one makes doubtful are pending review."""
    wide = families.groupBy(*keys).pivot("family", ["oscillation", "stiction", "sensor", "saturation", "overshoot", "slow", "bias_shift"]).agg(F.max(F.struct("confidence", "hits")))
    df = windows.join(wide, keys, "left")
    conf = lambda f: F.coalesce(F.col(f)["confidence"], F.lit(0.0))
    case = lambda name, test, c: F.when(test, F.struct(F.lit(name).alias("cause"), c.alias("confidence")))
    stuck = (conf("stiction") >= 0.7) | (F.coalesce(F.col("stiction")["hits"], F.lit(0)) >= 2)
    swings = F.col("oscillation").isNotNull() & F.col("stiction").isNull() & F.col("overshoot").isNull()
    causes = F.array_compact(
        F.array(
            case("COMMUNICATION", ~F.col("linked"), F.lit(0.9)),
            case("INSTRUMENT", F.col("sensor").isNotNull(), conf("sensor")),
            case("VALVE", stuck, conf("stiction")),
            case("VALVE", conf("saturation") > 0.8, conf("saturation")),
            case("PROCESS", F.col("bias_shift").isNotNull(), conf("bias_shift")),
            case("PROCESS", swings, F.lit(0.5)),
            case("TUNING", F.col("overshoot").isNotNull() | F.col("slow").isNotNull(), F.greatest(conf("overshoot"), conf("slow"))),
            case("UTILIZATION", (F.col("auto_rate") > 0) & (F.col("auto_rate") < 0.5), F.lit(0.8)),
        )
    )
    causes = F.when(F.col("passed"), causes).otherwise(F.slice(causes, 1, 0))  # poor data speak for no cause
    first = F.when(F.size("causes") > 0, F.element_at("causes", 1)).otherwise(F.struct(F.lit("DATA_INSUFFICIENT").alias("cause"), F.lit(0.0).alias("confidence")))
    doubtful = F.create_map(*(x for k, v in CONTAMINATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    df = df.withColumn("causes", causes).withColumn("first", first)
    rest = F.filter("causes", lambda c: c["cause"] != F.col("first.cause"))
    touched = lambda c: F.coalesce(F.array_contains(doubtful[F.col("first.cause")], c["cause"]), F.lit(False))
    sure = F.filter(rest, lambda c: ~touched(c) & (c["confidence"] >= 0.6))
    return df.select(
        *keys,
        F.col("first.cause").alias("primary"),
        F.col("first.confidence").alias("confidence"),
        F.slice(F.array_distinct(F.transform(sure, lambda c: c["cause"])), 1, 2).alias("secondary"),
        F.array_distinct(F.transform(F.filter(rest, touched), lambda c: c["cause"])).alias("pending"),
    )


def severity(score: Column, confidence: Column, primary: Column | None = None) -> Column:
    """Null for windows without enough data."""
    poor = F.lit(False) if primary is None else primary == "DATA_INSUFFICIENT"
    return F.when(poor, None).when((score < 40) & (confidence >= 0.8), "HIGH").when((score < 60) | (confidence >= 0.6), "MEDIUM").otherwise("LOW")


def merged_thresholds(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """(keys, name, value): of global, type, unit and loop settings the closest one."""
    rank = F.when(F.col("scope") == "LOOP", 3).when(F.col("scope") == "UNIT", 2).when(F.col("scope") == "TYPE", 1).otherwise(0)
    return rows.groupBy(*keys, name).agg(F.max_by("value", rank).alias("value"))


def distinct_labels(found: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """(keys, label, confidence, fused, features, others) of findings (keys, label, confidence, features map, tie): one record a label.

    The surest finding leads (ties: the larger `tie`); features that it lacks come from the next surer one that has them; the
    other findings stay as evidence, surest first; fused joins all confidences of the label. A label's findings are
    as many as there are operators."""
    by_rank = lambda a, b: F.when(F.struct(a["confidence"], a["tie"]) > F.struct(b["confidence"], b["tie"]), -1).when(F.struct(a["confidence"], a["tie"]) < F.struct(b["confidence"], b["tie"]), 1).otherwise(0)
    out = found.groupBy(*keys, "label").agg(F.collect_list(F.struct(F.col("confidence"), F.col(tie).alias("tie"), F.map_keys("features").alias("k"), F.map_values("features").alias("v"))).alias("_all"), fusion(F.col("confidence")).alias("fused"))
    out = out.withColumn("_all", F.array_sort("_all", by_rank))
    empty = F.map_from_arrays(F.get("_all", F.lit(0))["k"], F.get("_all", F.lit(0))["v"])
    merged = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), empty, lambda m, x: F.map_zip_with(m, F.map_from_arrays(x["k"], x["v"]), lambda k, a, b: F.coalesce(a, b)))
    first = F.get("_all", F.lit(0))
    others = F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda x: F.struct(x["confidence"].alias("confidence"), x["tie"].alias(tie)))
    return out.select(*keys, "label", first["confidence"].alias("confidence"), "fused", merged.alias("features"), others.alias("others"))


# Order of labels in a report.
LABELS = ("QUALITY_ABNORMAL", "VALVE_STICTION", "OVERAGGRESSIVE", "OVERCONSERVATIVE", "OUTPUT_SATURATION", "OSCILLATION", "EXTERNAL_DISTURBANCE")


def expert_rules(found: DataFrame, keys: list[str], bad_rate: str = "bad_rate") -> DataFrame:
    """(keys, label, confidence, place) of findings (keys, label, confidence, bad_rate) after the rules between labels.

    Mostly bad data leave only their own label; a stiction (surer than 0.5), or too aggressive settings without stiction,
    explain an oscillation; of too aggressive and too conservative the surer stays; unsure findings ask for a review."""
    sets = found.groupBy(*keys).agg(F.collect_list(F.struct("label", "confidence")).alias("all"), F.max(F.when(F.col("label") == "QUALITY_ABNORMAL", F.col(bad_rate))).alias("bad"))
    conf = lambda name: F.array_max(F.transform(F.filter("all", lambda x: x["label"] == name), lambda x: x["confidence"]))
    sets = sets.withColumns({"stuck": conf("VALVE_STICTION"), "hot": conf("OVERAGGRESSIVE"), "slow": conf("OVERCONSERVATIVE")})
    explained = F.coalesce(F.col("stuck") > 0.5, F.lit(False)) | (F.col("hot").isNotNull() & F.col("stuck").isNull())
    loser = F.when(F.col("hot").isNotNull() & F.col("slow").isNotNull(), F.when(F.col("hot") >= F.col("slow"), "OVERCONSERVATIVE").otherwise("OVERAGGRESSIVE"))
    left = F.filter("all", lambda x: ~((x["label"] == "OSCILLATION") & explained) & ~x["label"].eqNullSafe(loser))
    left = F.when(F.col("bad") > 0.5, F.filter("all", lambda x: x["label"] == "QUALITY_ABNORMAL")).otherwise(left)
    sets = sets.withColumn("left", left)
    review = F.forall("left", lambda x: x["confidence"] < 0.5) & ~F.coalesce(F.col("bad") > 0.5, F.lit(False))
    extra = F.array(F.struct(F.lit("MANUAL_REVIEW").alias("label"), F.lit(0.5).cast("double").alias("confidence")))
    out = sets.select(*keys, F.inline(F.when(review, F.concat("left", extra)).otherwise(F.col("left"))))
    place = F.lit(99)
    for i, name in enumerate(LABELS):
        place = F.when(F.col("label") == name, i + 1).otherwise(place)
    return out.withColumn("place", place)
