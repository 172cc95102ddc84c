"""Loop indicators: aggregates of one grouping, oscillation by islands and medoids, composite score and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import AUTO_MODES, DEFAULT_WEIGHTS, SCORE_TYPES, TYPE_WEIGHTS, clamp, grade, missing, score_type

#: Share of valid points below which an indicator is inconclusive.
LEAST_SHARE = 0.20
#: Distances of areas from their mean are told apart to this share of the mean.
NEAR = 1e-9


def ratio(part: Column, whole: Column, factor: float = 100.0) -> Column:
    return F.when(whole != 0, part / whole * factor)


def aggregates(span: float = 100.0, op_low: float = 0.0, op_high: float = 100.0, margin: float = 2.0, e_limit: float | None = None) -> dict[str, Column]:
    """Aggregate indicators over samples with pv, sp, op, mode, quality_status, d (hold seconds), e (pv - sp), move (|op change|).

    All of them share one scan, one shuffle and one partial aggregation."""
    e, d, op = F.abs("e"), F.col("d"), F.col("op")
    auto = F.col("mode").isin(*AUTO_MODES)
    high, low = op >= op_high - margin, op <= op_low + margin
    mean, spread = F.avg(e), F.max(e) - F.avg(e)
    r = F.try_divide(mean, spread)
    limit = F.lit(e_limit if e_limit is not None else 0.05 * span)
    pv_, op_ = F.when(op.isNotNull(), F.col("pv")), F.when(F.col("pv").isNotNull(), op)  # corr() itself divides by a variance of zero
    corr = F.coalesce(F.abs(F.try_divide(F.covar_pop("pv", "op"), F.stddev_pop(pv_) * F.stddev_pop(op_))), F.when(F.count("pv") > 0, 0.0))
    deviation = F.stddev_samp("e")
    return {
        "points": F.count(F.lit(1)),
        "accuracy_rate": F.when(spread > 0, clamp(100 * (1 - r * (1 - F.exp(-r))), 0, 100)).when(mean > 0, clamp(100 * (1 - mean / (0.05 * span)), 0, 100)).when(mean == 0, 100.0),
        "stability_base": 100 * F.exp(-deviation / (0.05 * span)),
        "good_value_rate": F.avg((F.col("quality_status") == "Good").cast("double")) * 100,
        "auto_mode_rate": ratio(F.sum(F.when(auto, d).otherwise(0.0)), F.sum(d)),
        "effective_auto_rate": ratio(F.sum(F.when(auto & (op > op_low + margin) & (op < op_high - margin) & (e < limit), d).otherwise(0.0)), F.sum(d)),
        "saturation_rate": ratio(F.sum(F.when(auto & (high | low), d).otherwise(0.0)), F.sum(d)),
        "saturation_type": F.when(F.max((auto & high).cast("int")) + F.max((auto & low & ~high).cast("int")) == 2, "BOTH").when(F.max((auto & high).cast("int")) == 1, "HIGH").when(F.max((auto & low).cast("int")) == 1, "LOW").otherwise("NONE"),
        "output_trip_index": ratio(F.sum("move"), F.sum(d) * (op_high - op_low), 1.0),
        **{f"{s}_mean": F.avg(s) for s in ("pv", "sp", "op")},
        **{f"{s}_std": F.stddev_pop(s) for s in ("pv", "sp", "op")},
        "error_mean": F.avg("e"),
        "error_std": F.stddev_pop("e"),
        "valve_linearity": corr,
        "valve_nonlinearity": 1 - corr,
        "valve_operating_range": F.max("op") - F.min("op"),
        "setpoint_crossing_count": F.sum(F.col("crossed").cast("long")),
        "oscillation_amplitude": F.avg(e),
        "instrument_fault_rate": F.avg(F.col("faulty").cast("double")) * 100,
    }


def stability(base: Column, oscillation_rate: Column) -> Column:
    """Steadiness less the share of oscillation."""
    return base * (1 - F.coalesce(oscillation_rate, F.lit(0.0)) / 100)


def trip_level(x: Column) -> Column:
    return F.when(x < 0.01, "INACTIVE").when(x < 0.1, "NORMAL").when(x < 1, "FREQUENT").when(x.isNotNull(), "EXCESSIVE")


def stiction_level(x: Column) -> Column:
    return F.when(x < 5, "NONE").when(x < 15, "MILD").when(x < 30, "MODERATE").when(x.isNotNull(), "SEVERE")


def oscillation(df: DataFrame, keys: list[str], by: list[str], e: str = "e", threshold: float = 0.4, low: float = 0.05, high: float = 15.0, least_crossings: int = 4) -> DataFrame:
    """(keys, crossings, s_a, s_b, half_cycle, oscillation_rate, is_oscillating, period) of the error between set-point crossings.

    Zeros take the sign before them; half cycles cut off by the window's ends do not count. The medoid of the half
    cycles' areas is the value nearest their mean, the earliest of equals: distances that differ by less than NEAR of the
    mean are equal, since the last bits of a mean depend on the order of its sum."""
    w = Window.partitionBy(*keys).orderBy(*by)
    sign = F.last(F.when(F.col(e) != 0, F.signum(e)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.where(~missing(e)).withColumn("_sign", sign)
    df = df.withColumn("_cross", F.coalesce((F.col("_sign") * F.lag("_sign").over(w) < 0).cast("int"), F.lit(0)))
    df = df.withColumn("_part", F.sum("_cross").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = df.groupBy(*keys, "_part").agg(F.sum(F.abs(e)).alias("area"), F.count(F.lit(1)).alias("length"), F.when(F.avg(e) > 0, 1).otherwise(-1).alias("side"))
    whole = Window.partitionBy(*keys)
    parts = parts.withColumn("crossings", F.max("_part").over(whole))
    halves = parts.where((F.col("_part") > 0) & (F.col("_part") < F.col("crossings")))
    side = Window.partitionBy(*keys, "side")
    halves = halves.withColumns({"_mean": F.avg("area").over(side), "_n": F.count(F.lit(1)).over(side)})
    far = F.round(F.try_divide(F.abs(F.col("area") - F.col("_mean")), F.col("_mean") * NEAR))
    halves = halves.withColumn("_medoid", F.min_by("area", F.struct(far, "_part")).over(side))
    near = F.try_divide("area", "_medoid").between(low, high)
    sides = halves.groupBy(*keys, "side", "_medoid", "_n").agg(F.avg(F.when(near, F.col("area"))).alias("_kept"), F.sum("length").alias("_length"))
    alike = F.when((F.col("_n") < 2) | (F.abs("_medoid") < 1e-12), 0.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.abs(F.col("_kept") - F.col("_medoid")), F.abs("_medoid")))), F.lit(0.0)))
    per = sides.groupBy(*keys).agg(
        F.max(F.when(F.col("side") > 0, alike)).alias("s_a"), F.max(F.when(F.col("side") < 0, alike)).alias("s_b"), (F.sum("_length") / F.sum("_n")).alias("_half")
    )
    counted = parts.groupBy(*keys).agg(F.max("crossings").alias("crossings"))
    out = counted.join(per, keys, "left")
    enough = (F.col("crossings") >= least_crossings) & F.col("s_a").isNotNull() & F.col("s_b").isNotNull()
    both = enough & (F.col("s_a") >= threshold) & (F.col("s_b") >= threshold)
    return out.select(
        *keys,
        "crossings",
        "s_a",
        "s_b",
        F.col("_half").alias("half_cycle"),
        F.when(enough, F.least("s_a", "s_b") * 100).otherwise(0.0).alias("oscillation_rate"),
        F.coalesce(both, F.lit(False)).alias("is_oscillating"),
        F.when(both, 2 * F.col("_half")).otherwise(0.0).alias("period"),
    )


#: Least half cycle in samples of a real oscillation, least likeness of the half cycles of a limit cycle.
HALF_CYCLE, ALIKE = 8, 0.6


def limit_cycle(df: DataFrame, keys: list[str], by: list[str], x: str = "pv", least_half: float = HALF_CYCLE) -> DataFrame:
    """(keys, crossings, half_cycle, s_a, s_b, is_cycle): whether x swings about its mean in alike, long enough half cycles."""
    whole = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centred = df.withColumn("_x", F.col(x) - F.avg(x).over(whole))  # summed in order, so that values at the mean fall on the same side each time
    found = oscillation(centred, keys, by, "_x")
    cycle = (F.col("crossings") >= 4) & (F.col("half_cycle") >= least_half) & (F.col("s_a") >= ALIKE) & (F.col("s_b") >= ALIKE)
    return found.select(*keys, "crossings", "half_cycle", "s_a", "s_b", F.coalesce(cycle, F.lit(False)).alias("is_cycle"))


def oscillation_by_error(df: DataFrame, keys: list[str], by: list[str], e: str = "e", threshold: float = 0.4, least_half: float = HALF_CYCLE) -> DataFrame:
    """(keys, detected, confidence, similarity, crossings, mean_period) by the likeness of integrated errors of half cycles."""
    found = oscillation(df, keys, by, e, threshold)
    alike = F.when(F.col("crossings") >= 4, F.least("s_a", "s_b"))
    known = F.col("s_a").isNotNull() & F.col("s_b").isNotNull() & (F.col("crossings") >= 4)
    detected = F.coalesce(F.col("is_oscillating") & (F.col("half_cycle") >= least_half), F.lit(False))
    zero = F.lit(0.0)
    return found.select(*keys, detected.alias("detected"), F.when(detected, F.least(F.lit(1.0), alike * 1.5)).otherwise(zero).alias("confidence"), F.when(known, alike).otherwise(zero).alias("similarity"), "crossings", F.when(known, 2 * F.col("half_cycle")).otherwise(zero).alias("mean_period"))


def with_moves(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """e, |op change| and strict set-point crossings, from one window."""
    w = Window.partitionBy(*keys).orderBy(*by)
    df = df.withColumn("e", F.col("pv") - F.col("sp"))
    return df.withColumns({"move": F.coalesce(F.abs(F.col("op") - F.lag("op").over(w)), F.lit(0.0)), "crossed": F.coalesce(F.col("e") * F.lag("e").over(w) < 0, F.lit(False))})


def fast_rate(actual: Column, ideal: Column, ratio_: float = 1.0, tolerance: float = 0.0) -> Column:
    """100 while the settling time is within the ideal one, then an exponential loss."""
    return F.when(actual <= ideal * ratio_ * (1 + tolerance), 100.0).otherwise(100 * F.exp(-(actual - ideal) / ideal))


def ideal_settling(manual: Column, tau: Column, theta: Column, control: Column, alpha: float = 3.0) -> Column:
    """Manual value, else alpha (tau + theta), else the type's default in seconds."""
    default = F.when(control == "FC", 30.0).when(control == "PC", 60.0).when(control == "TC", 180.0).when(control == "LC", 600.0).when(control == "CC", 300.0).otherwise(120.0)
    return F.coalesce(F.when(manual > 0, manual), F.when(tau + theta > 0, alpha * (tau + theta)), default)


def weights(metric: tuple[Column, Column, Column], loop_type: Column) -> tuple[Column, Column, Column]:
    """Own weights if all three are above zero (normalised), else those of the score type, else the defaults."""
    own = (metric[0] > 0) & (metric[1] > 0) & (metric[2] > 0)
    total = metric[0] + metric[1] + metric[2]
    kind = score_type(loop_type)
    out = []
    for i in range(3):
        by_type = F.lit(DEFAULT_WEIGHTS[i])
        for name in {*SCORE_TYPES.values(), "LOGIC"}:
            by_type = F.when(kind == name, TYPE_WEIGHTS[name][i]).otherwise(by_type)
        out.append(F.when(own, metric[i] / total).otherwise(by_type))
    return tuple(out)


def composite(accuracy: Column, fast: Column, steady: Column, auto: Column, w: tuple[Column, Column, Column]) -> Column:
    """Weighted core indicators times the share in automatic; null if one that has weight, or the share, is missing."""
    total = w[0] + w[1] + w[2]
    lost = ((w[0] > 0) & accuracy.isNull()) | ((w[1] > 0) & fast.isNull()) | ((w[2] > 0) & steady.isNull()) | auto.isNull() | (total <= 0)
    zero = F.lit(0.0)
    return F.when(~lost, (w[0] * F.coalesce(accuracy, zero) + w[1] * F.coalesce(fast, zero) + w[2] * F.coalesce(steady, zero)) / total * auto / 100)


def status(score: Column, good: Column, auto: Column, steady: Column) -> Column:
    return F.when(score.isNull(), "INCONCLUSIVE").when(good.isNull() | auto.isNull() | steady.isNull(), "PARTIAL").otherwise("SUCCESS")


def confidence(valid: str, keys: list[str]) -> Column:
    return grade(F.avg(F.col(valid).cast("double")).over(Window.partitionBy(*keys)))
