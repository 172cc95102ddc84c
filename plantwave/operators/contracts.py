"""Metric contracts: every indicator names the mask that its samples pass; all of them come from one grouping.

Masks are texts over validity flags, compiled to columns. What depends on neighbours (hold times, moves, crossings) is
taken between samples that pass the indicator's mask, so a missing output costs no indicator that does not read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import mask
from ..functions.signals import AUTO_MODES, clamp, present
from . import moments
from .kpi import LEAST_SHARE, ratio
from .segments import adjacent, seconds

#: The mask of each indicator; no mask keeps all samples.
CONTRACTS = {
    "accuracy_rate": "pv_valid && sp_valid",
    "stability_base": "pv_valid && sp_valid",
    "effective_auto_rate": "mode_valid && op_valid",
    "good_value_rate": None,
    "oscillation_rate": "pv_valid && sp_valid",
    "saturation_rate": "mode_valid && op_valid",
    "output_trip_index": "op_valid && consecutive_valid",
    "auto_mode_rate": "mode_valid",
    "settling_time": "pv_valid && sp_valid",
    "instrument_fault_rate": "pv_valid",
    "pv_mean": "pv_valid",
    "pv_std": "pv_valid",
    "sp_mean": "sp_valid",
    "sp_std": "sp_valid",
    "op_mean": "op_valid",
    "op_std": "op_valid",
    "error_mean": "pv_valid && sp_valid",
    "error_std": "pv_valid && sp_valid",
    "valve_linearity": "pv_valid && op_valid",
    "valve_nonlinearity": "pv_valid && op_valid",
    "valve_operating_range": "op_valid",
    "setpoint_crossing_count": "pv_valid && sp_valid",
    "oscillation_amplitude": "pv_valid && sp_valid",
}
FLAGS = ["pv_valid", "sp_valid", "op_valid", "mode_valid", "consecutive_valid"]
_NAMES = {text: f"_mask{i}" for i, text in enumerate(dict.fromkeys(filter(None, CONTRACTS.values())))}


def masked(metric: str, x: Column | str | None = None) -> Column:
    """x (true without one) where the indicator's mask holds, else null."""
    value = F.lit(True) if x is None else F.col(x) if isinstance(x, str) else x
    return value if CONTRACTS[metric] is None else F.when(F.col(_NAMES[CONTRACTS[metric]]), value)


def consecutive(df: DataFrame, flag: str, keys: list[str], by: list[str], least: Column) -> DataFrame:
    """Adds consecutive_valid: the row is in a run of at least `least` rows whose flag is true. Runs end at the next other row."""
    w = Window.partitionBy(*keys).orderBy(*by)
    df = df.withColumn("_n", F.row_number().over(w))
    df = df.withColumn("_bad", F.when(~F.col(flag), F.col("_n")))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    length = F.coalesce(adjacent("_bad", keys, by, 1), total + 1) - F.coalesce(adjacent("_bad", keys, by, -1), F.lit(0)) - 1
    return df.withColumn("consecutive_valid", F.col(flag) & (length >= least)).drop("_n", "_bad")


def with_masks(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Samples with the contracts' masks, and what their indicators take from neighbours under the same mask."""
    df = df.withColumns({name: mask(text, FLAGS) for text, name in _NAMES.items()})
    df = df.withColumns({"_at": seconds(by[0]), "_e": masked("accuracy_rate", present("pv") - present("sp"))})
    held = {"auto_mode_rate": "_mode_at", "saturation_rate": "_both_at"}
    df = df.withColumns({name: masked(metric, "_at") for metric, name in held.items()} | {"_out": masked("output_trip_index", "op")})
    made = {f"{name}_d": F.coalesce(adjacent(name, keys, by, 1) - F.col(name), F.col(name) - adjacent(name, keys, by, -1), F.lit(0.0)) for name in held.values()}
    df = df.withColumns({n: F.when(F.col(n.removesuffix("_d")).isNotNull(), c) for n, c in made.items()})
    df = df.withColumns({"_move": F.abs(F.col("_out") - adjacent("_out", keys, by, -1)), "_crossed": F.col("_e") * adjacent("_e", keys, by, -1) < 0})
    return moments.lagged(moments.edges(df, "_e", keys, by), "_e", keys, by)


def aggregates(op_low: Column, op_high: Column, margin: float = 2.0, span: float = 100.0) -> dict[str, Column]:
    """Every indicator over the samples of its mask; null where they are less than a fifth of all samples."""
    e, op, d, held = F.abs("_e"), F.col("op"), F.col("_both_at_d"), F.col("_mode_at_d")
    auto = F.col("mode").isin(*AUTO_MODES)
    high, low = auto & (op >= op_high - margin), auto & (op <= op_low + margin) & ~(op >= op_high - margin)
    inside = auto & (op > op_low + margin) & (op < op_high - margin)
    mean, spread = F.avg(e), F.max(e) - F.avg(e)
    r = F.try_divide(mean, spread)
    both = {s: masked("valve_linearity", s) for s in ("pv", "op")}
    corr = F.coalesce(F.abs(F.try_divide(F.covar_pop(both["pv"], both["op"]), F.stddev_pop(both["pv"]) * F.stddev_pop(both["op"]))), F.when(F.count(both["pv"]) > 0, 0.0))
    spent = lambda flag, d, metric: ratio(F.sum(masked(metric, F.when(flag, d).otherwise(0.0))), F.sum(masked(metric, d)))
    any_of = lambda flag: F.coalesce(F.max(masked("saturation_rate", flag)), F.lit(False))
    trip_at = masked("output_trip_index", "_at")
    made = {
        "accuracy_rate": F.when(spread > 0, clamp(100 * (1 - r * (1 - F.exp(-r))), 0, 100)).when(mean > 0, clamp(100 * (1 - mean / (0.05 * span)), 0, 100)).when(mean == 0, 100.0),
        "stability_base": 100 * F.exp(-F.stddev_samp("_e") / (0.05 * span)),
        "good_value_rate": F.avg((F.col("quality_status") == "Good").cast("double")) * 100,
        "auto_mode_rate": spent(auto, held, "auto_mode_rate"),
        "effective_auto_rate": spent(inside, d, "effective_auto_rate"),
        "saturation_rate": spent(high | low, d, "saturation_rate"),
        "output_trip_index": F.try_divide(F.coalesce(F.sum("_move"), F.lit(0.0)), F.nullif(F.max(trip_at) - F.min(trip_at), F.lit(0.0)) * span),
        **{f"{s}_mean": F.avg(masked(f"{s}_mean", s)) for s in ("pv", "sp", "op")},
        **{f"{s}_std": F.stddev_pop(masked(f"{s}_std", s)) for s in ("pv", "sp", "op")},
        "error_mean": F.avg("_e"),
        "error_std": F.stddev_pop("_e"),
        "valve_linearity": corr,
        "valve_nonlinearity": 1 - corr,
        "valve_operating_range": F.max(masked("valve_operating_range", "op")) - F.min(masked("valve_operating_range", "op")),
        "setpoint_crossing_count": F.when(F.count("_e") > 0, F.count_if("_crossed")),
        "oscillation_amplitude": mean,
        "instrument_fault_rate": F.avg(F.col("faulty").cast("double")) * 100,
    }
    n = F.count(F.lit(1))
    share = {metric: F.count(masked(metric)) >= LEAST_SHARE * n for metric in CONTRACTS if CONTRACTS[metric]}
    share["good_value_rate"] = made["good_value_rate"] >= LEAST_SHARE * 100
    shown = {metric: F.when(share[metric], value) for metric, value in made.items()}
    kind = F.when(any_of(high) & any_of(low), "BOTH").when(any_of(high), "HIGH").when(any_of(low), "LOW").otherwise("NONE")
    return shown | {
        "saturation_type": kind,
        "points": F.count_if("all_valid"),
        "samples": n,
        "valid_rate": F.avg(F.col("all_valid").cast("double")),
        "base_share": F.count("_e") / n,
        **moments.sums("_e"),
        "edges": moments.edge_list(),
    }
