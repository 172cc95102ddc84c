"""Events within a window: disturbances, confirmed freezes, segments fit for identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import adjacent, hold, seconds


def disturbances(df: DataFrame, keys: list[str], by: list[str], ideal: Column | None = None, interval: Column | float = 1.0, band: float = 2.0, recovery: int = 5, step_sigma: float = 3.0, least_seconds: float = 3.0) -> DataFrame:
    """(keys, start, end, recovered, seconds, censored) of runs of rows, counted from 0, in which the error pv - sp is beyond
    `band` of its deviations and no step of the set point explains it.

    A set point that moves by more than step_sigma deviations of its moves is tracked for the ideal settling time
    (five rows at least, 60 where none is known). A run counts if it holds for least_seconds; it has recovered at the last
    of the first `recovery` rows in a row within the band after it, or else is censored at the window's end. seconds: from
    the run's first row to the recovery."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*by)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.where(F.col("pv").isNotNull() & F.col("sp").isNotNull())
    df = df.withColumns({"_e": F.abs(F.col("pv") - F.col("sp")), "_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole), "_move": F.col("sp") - F.lag("sp").over(w), "_d": hold(by[0], keys, by)})
    df = df.withColumns({"_sd": F.stddev_pop(F.col("pv") - F.col("sp")).over(whole), "_moves": F.stddev_pop("_move").over(whole), "_spent": F.sum("_d").over(running)})
    stepped = (F.col("_moves") > 0) & (F.abs("_move") > step_sigma * F.col("_moves"))
    length = F.lit(60) if ideal is None else F.when((ideal > 0) & (F.lit(1) * interval > 0), F.greatest(F.lit(5), F.floor(ideal / interval))).otherwise(60)
    df = df.withColumns({"_step": F.max(F.when(stepped, F.col("_i"))).over(running), "_beyond": (F.col("_sd") > 0) & (F.col("_e") > band * F.col("_sd"))})
    df = df.withColumns({"_out": F.col("_beyond") & F.coalesce(F.col("_i") - F.col("_step") >= length, F.lit(True)), "_last": F.max(F.when(F.col("_beyond"), F.col("_i"))).over(running)})
    settled = F.when(~F.col("_beyond") & (F.col("_i") - F.coalesce("_last", F.lit(-1)) >= recovery), F.struct("_i", "_spent"))
    df = df.withColumns({"_settled": settled, "_fresh": (F.col("_out") & ~F.coalesce(F.lag("_out").over(w), F.lit(False))).cast("int"), "_total": F.sum("_d").over(whole)})
    df = df.withColumns({"_event": F.sum("_fresh").over(running), "_next": adjacent("_settled", keys, by, 1)}).where((F.col("_out")) & (F.col("_n") >= 3))
    out = df.groupBy(*keys, "_event").agg(F.min("_i").alias("start"), F.max("_i").alias("end"), F.sum("_d").alias("_held"), F.min(F.col("_spent") - F.col("_d")).alias("_before"), F.max_by("_next", "_i").alias("_next"), F.max("_n").alias("_n"), F.max("_total").alias("_total"))
    out = out.where(F.col("_held") >= least_seconds)
    return out.select(*keys, "start", "end", F.coalesce(F.col("_next._i"), F.col("_n") - 1).alias("recovered"), (F.coalesce(F.col("_next._spent"), F.col("_total")) - F.col("_before")).alias("seconds"), F.col("_next").isNull().alias("censored"))


def confirmed_frozen(df: DataFrame, keys: list[str], by: list[str], frozen: str, op: str, minutes: float, op_sigma: Column | float, interval: Column | float = 0.0) -> DataFrame:
    """Adds confirmed: a frozen run that lasts for the minutes (its last sample for an interval) while the output moves by more than the deviation."""
    w = Window.partitionBy(*keys).orderBy(*by)
    flagged = Window.partitionBy(*keys, frozen).orderBy(*by)
    df = df.withColumn("_run", F.row_number().over(w) - F.row_number().over(flagged))
    run = Window.partitionBy(*keys, frozen, "_run")
    lasts = (F.max(seconds(by[0])).over(run) - F.min(seconds(by[0])).over(run)) + interval >= 60 * minutes
    moves = F.stddev_pop(op).over(run) > op_sigma
    return df.withColumn("confirmed", F.col(frozen) & lasts & F.coalesce(moves, F.lit(False))).drop("_run")


def identification_segments(df: DataFrame, keys: list[str], by: list[str], gap_seconds: float, op_low: float = 2.0, op_high: float = 98.0) -> DataFrame:
    """(keys, start, end, points, mode, ended_by): runs of one mode without gap and saturation, with the reason of their end."""
    w = Window.partitionBy(*keys).orderBy(*by)
    gap = F.coalesce(seconds(by[0]) - F.lag(seconds(by[0])).over(w) > gap_seconds, F.lit(False))
    saturated = (F.col("op") <= op_low) | (F.col("op") >= op_high) | F.col("op").isNull()
    df = df.withColumns({"_n": F.row_number().over(w), "_gap": gap, "_saturated": saturated})
    changed = F.coalesce(F.col("mode") != F.lag("mode").over(w), F.lit(False))
    left = F.coalesce(F.lag("_saturated").over(w), F.lit(False))
    df = df.withColumns({"_changed": changed, "_cut": (changed | F.col("_gap") | (F.col("_saturated") != left)).cast("int")})
    df = df.withColumn("_part", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nxt = F.when(F.lead("_saturated").over(w), "saturation").when(F.lead("_gap").over(w), "gap").when(F.lead("_changed").over(w), "mode").otherwise("end")
    df = df.withColumn("_next", nxt).where(~F.col("_saturated"))
    return df.groupBy(*keys, "_part").agg(F.min("_n").alias("start"), F.max("_n").alias("end"), F.count(F.lit(1)).alias("points"), F.max("mode").alias("mode"), F.max_by("_next", "_n").alias("ended_by")).drop("_part")


def best_segment(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The longest segment of each loop, the earlier of equals."""
    return segments.groupBy(*keys).agg(F.max_by(F.struct("start", "end", "points", "mode"), F.struct("points", -F.col("start"))).alias("s")).select(*keys, "s.*")


def similar_cases(cases: DataFrame, label: Column, kind: Column, limit: int) -> DataFrame:
    """Cases of the label or the type, verified ones first (unknown before known), then by improvement."""
    return cases.where((F.col("label") == label) | (F.col("kind") == kind)).orderBy(F.desc_nulls_first("verified"), F.desc_nulls_first("improved"), "case_id").limit(limit)
