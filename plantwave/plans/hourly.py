"""The hourly job as one plan: samples → flags → indicators by loop and hour → score, confidence and status → plant nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import control_type, grade, score_grade
from ..operators import contracts, events, kpi, moments, outliers, rollup, segments

#: Windows are loop and hour, so one hash partitioning serves every window and the one grouping.
KEYS = ["loop_id", "hour"]


#: Signals that are stored on change.
ON_CHANGE = ["sp", "mode"]

#: What a loop may bring along, and what holds where it does not: type, ranges, output limits, ideal settling or model, weights.
LOOP = {"loop_type": ("string", None), "pv_low": ("double", 0.0), "pv_high": ("double", 100.0), "op_low": ("double", 0.0), "op_high": ("double", 100.0)}
SCORING = {"ideal_settling": "double", "tau": "double", "theta": "double", "weight_accuracy": "double", "weight_fast": "double", "weight_steady": "double"}


def dimensions(loops: DataFrame) -> DataFrame:
    """loop_id, control, ranges and output limits of the loops, defaults filled in."""
    has = set(loops.columns)
    made = {c: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in has else F.lit(default).cast(kind) for c, (kind, default) in LOOP.items()}
    return loops.select("loop_id", *(v.alias(k) for k, v in made.items())).withColumn("control", control_type("loop_type")).drop("loop_type")


def prepare(samples: DataFrame, loops: DataFrame, before: DataFrame | None = None, ties: tuple[str, ...] = (), frozen_minutes: float = 5.0) -> DataFrame:
    """Samples (loop_id, ts, pv, sp, op, mode, quality) with flags, the contracts' masks and what indicators take from neighbours.

    Every loop is judged by its own range and the limits of its control type (loops without a row: flow, 0 to 100), in one
    pass. Set point and mode hold until they change, over the hours and from `before` (loop_id, sp, mode) on. Freezes count as
    faults where they last for frozen_minutes while the output moves. ties: columns that order samples of one time."""
    by = ["ts", *ties]
    df = samples.withColumn("hour", F.date_trunc("hour", "ts"))
    df = segments.carried_over(df, ON_CHANGE, ["loop_id"], "hour", by, before)
    df = df.join(dimensions(loops), "loop_id", "left").fillna({"control": "FC"} | {c: d for c, (_, d) in LOOP.items() if d is not None}).repartition(*KEYS)
    control = F.col("control")
    df = outliers.preprocess(df, KEYS, by, (F.col("pv_low"), F.col("pv_high")), control=control)
    df = df.withColumn("_frozen", F.array_contains("pv_reasons", "FROZEN"))
    df = events.confirmed_frozen(df, KEYS, by, "_frozen", "op", frozen_minutes, outliers.threshold(control, "frozen") * 100, outliers.threshold(control, "interval"))
    faulty = F.arrays_overlap("pv_reasons", F.array(F.lit("JUMP"), F.lit("OUT_OF_RANGE"))) | F.col("confirmed")
    df = contracts.consecutive(df.withColumn("faulty", faulty), "op_valid", KEYS, by, outliers.threshold(control, "segment"))
    return contracts.with_masks(df, KEYS, by)


def indicators(df: DataFrame) -> DataFrame:
    """Every indicator by loop and hour under the mask of its contract, the share of valid samples, moments and edges of the
    error, from one grouping."""
    made = contracts.aggregates(F.col("op_low"), F.col("op_high"))
    return df.groupBy(*KEYS).agg(*(v.alias(k) for k, v in made.items()), F.max("control").alias("control"))


def responses(df: DataFrame) -> DataFrame:
    """Adds settling and oscillation to rows of indicators; null where less than a fifth of the samples have an error."""
    df = moments.settling(df, "_e", interval(F.col("control")))
    df = moments.swings(df).drop("_e_n", *(f"_e_r{k}" for k in range(moments.LAGS + 1)))
    known = F.coalesce(F.col("base_share") >= kpi.LEAST_SHARE, F.lit(False))
    return df.withColumns({c: F.when(known, F.col(c)) for c in ("settling_time", "oscillation_rate", "period", "half_cycle")} | {"is_oscillating": known & F.col("is_oscillating")})


def interval(control: Column) -> Column:
    """Seconds between the samples of a control type."""
    return outliers.threshold(control, "interval")


def hourly(samples: DataFrame, loops: DataFrame, before: DataFrame | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """One snapshot a loop and hour. loops: (loop_id, and what LOOP and SCORING name, as far as there is any) is small
    against samples; Spark broadcasts it if its size allows."""
    out = responses(indicators(prepare(samples, loops, before, ties)))
    rounded = {"output_trip_index": 6}
    measured = [c for c in (*contracts.CONTRACTS, "settling_time") if c in out.columns and dict(out.dtypes)[c] == "double"]
    out = out.withColumns({c: F.bround(c, rounded.get(c, 2)) for c in measured if c != "stability_base"})
    own = loops.select("loop_id", (F.col("loop_type") if "loop_type" in loops.columns else F.lit(None).cast("string")).alias("loop_type"), *((F.col(c) if c in loops.columns else F.lit(None)).cast(kind).alias(c) for c, kind in SCORING.items()))
    out = out.join(own, "loop_id", "left")
    ideal = kpi.ideal_settling(F.col("ideal_settling"), F.col("tau"), F.col("theta"), F.col("control"))
    steady = F.when(F.col("oscillation_rate") >= 100, 0.0).otherwise(kpi.stability(F.col("stability_base"), F.col("oscillation_rate")))
    out = out.withColumns({"ideal_settling_time": ideal, "fast_rate": F.when(F.col("settling_time").isNotNull(), F.bround(kpi.fast_rate(F.col("settling_time"), ideal), 2)), "stability_rate": F.bround(F.when(F.col("stability_base").isNotNull(), steady), 2)})
    metric = F.col("weight_accuracy"), F.col("weight_fast"), F.col("weight_steady")
    inconclusive = F.col("valid_rate") < kpi.LEAST_SHARE
    score = kpi.composite(F.col("accuracy_rate"), F.col("fast_rate"), F.col("stability_rate"), F.col("effective_auto_rate"), kpi.weights(metric, F.col("loop_type")))
    out = out.withColumn("score", F.when(~inconclusive, F.bround(score, 2)))
    out = out.withColumns({"confidence": grade("valid_rate"), "score_grade": score_grade("score"), "status": kpi.status(F.col("score"), F.col("good_value_rate"), F.col("auto_mode_rate"), F.col("stability_rate")), "trip_level": kpi.trip_level(F.col("output_trip_index"))})
    return out.drop("stability_base", "base_share", "control", *SCORING)


def nodes(snapshots: DataFrame, loops: DataFrame, tree: DataFrame) -> DataFrame:
    """Snapshots of plant nodes by hour: level-weighted scores of the loops below each. tree: (root, node) pairs."""
    df = snapshots.join(loops.select("loop_id", "unit_id", "level"), "loop_id").join(tree.withColumnRenamed("node", "unit_id"), "unit_id")
    return df.groupBy("root", "hour").agg(rollup.mean_level("score", "level").alias("score"), F.count(F.lit(1)).alias("loop_count"), rollup.worst("confidence").alias("confidence"))
