"""Faults of a sensor from its own signal and of its link from quality codes, as windows and groupings in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def sensor_faults(df: DataFrame, x: str, sp: str | None, keys: list[str], by: list[str], frozen_window: int = 300, frozen_eps: float = 1e-4, frozen_ratio: float = 0.2, noise_ratio: float = 3.0, drift_k: float = 2.0, parts: int = 5, least: int = 32) -> DataFrame:
    """(keys, points, frozen_segment, frozen_share, noise_ratio, drift, subtype, confidence) of the known values of x.

    frozen: the longest run of full windows of frozen_window samples whose deviation stays below frozen_eps covers more than
    frozen_ratio of the samples. noisy: the medians of rolling deviations of the two halves differ by more than noise_ratio
    (999 where one of them is zero). drift: the means of the parts go one way by more than drift_k deviations
    while the set point does not go half as far with them. The surest kind counts: 0.85, 0.70, 0.65."""
    w, whole = Window.partitionBy(*keys).orderBy(*by), Window.partitionBy(*keys)
    running, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, frozen_window - 1)
    df = df.where(F.col(x).isNotNull())
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_all": F.count(F.lit(1)).over(whole), "_y": F.col(x) - F.avg(x).over(whole)})
    df = df.withColumn("_still", (F.count(F.lit(1)).over(ahead) == frozen_window) & (F.stddev_pop("_y").over(ahead) < frozen_eps))
    df = df.withColumns({"_other": F.max(F.when(~F.col("_still"), F.col("_i"))).over(running), "_c1": F.sum("_y").over(running), "_c2": F.sum(F.col("_y") * F.col("_y")).over(running)})
    part = F.floor(F.col("_i") / F.floor(F.col("_all") / parts))
    means = {f"_{name}{k}": F.avg(F.when(part == k, F.col(c))) for name, c in (("x", x), *((("s", sp),) if sp else ())) for k in range(parts)}
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.max(F.when(F.col("_still"), F.col("_i") - F.coalesce("_other", F.lit(-1)))).alias("_run"),
        F.stddev_pop("_y").alias("_sd"),
        F.sort_array(F.collect_list(F.struct("_i", "_c1", "_c2"))).alias("_sums"),
        *(c.alias(n) for n, c in means.items()),
    )
    n, split = F.col("points"), F.floor(F.col("points") / 2).cast("int")
    out = out.withColumns({"frozen_segment": F.when(F.col("_run") > 0, F.col("_run") + frozen_window - 1).otherwise(0), "_win": F.greatest(F.lit(10), F.least(F.lit(30), F.floor(split / 4), F.floor((n - split) / 4))).cast("int")})

    def rolling(begin: Column, end: Column) -> Column:
        at = lambda j, c: F.when(j < 0, 0.0).otherwise(F.get(F.col("_sums"), j)[c])
        total = lambda j, c: at(j, c) - at(j - F.col("_win"), c)
        variance = lambda j: total(j, "_c2") / F.col("_win") - F.pow(total(j, "_c1") / F.col("_win"), F.lit(2.0))
        rounding = 1e-12 * F.pow("_sd", F.lit(2.0))
        return F.when(end - begin >= F.col("_win"), F.transform(F.sequence(begin + F.col("_win") - 1, end - 1), lambda j: F.when(variance(j) > rounding, F.sqrt(variance(j))).otherwise(0.0)))

    halves = (split >= 16) & (n - split >= 16)
    out = out.withColumns({"_m1": F.when(halves, median(rolling(F.lit(0), split))), "_m2": F.when(halves, median(rolling(split, n.cast("int"))))})
    low, high = F.least("_m1", "_m2"), F.greatest("_m1", "_m2")
    noise = F.when(F.col("_m1").isNull() | F.col("_m2").isNull(), 1.0).when(low > 1e-12, high / low).when(high > 1e-12, 999.0).otherwise(1.0)
    drift = F.when(F.floor(n / parts) >= 4, F.col(f"_x{parts - 1}") - F.col("_x0")).otherwise(0.0)
    step = lambda k: F.col(f"_x{k + 1}") - F.col(f"_x{k}")
    one_way = F.least(*(step(k) for k in range(parts - 1))), F.greatest(*(step(k) for k in range(parts - 1)))
    monotone = (one_way[0] > 0) | (one_way[1] < 0)
    moved = F.coalesce(F.col(f"_s{parts - 1}") - F.col("_s0"), F.lit(0.0)) if sp else F.lit(0.0)
    out = out.withColumns({"frozen_share": F.col("frozen_segment") / n, "noise_ratio": noise, "drift": drift})
    synced = (moved * F.col("drift") > 0) & (F.abs(moved) >= 0.5 * F.abs("drift"))
    subtype = (
        F.when(n < least, None)
        .when(F.col("frozen_share") > frozen_ratio, "frozen")
        .when(F.col("noise_ratio") > noise_ratio, "noisy")
        .when(F.coalesce(monotone, F.lit(False)) & (F.floor(n / parts) >= 4) & (F.abs("drift") > drift_k * F.col("_sd")) & ~synced, "drift")
    )
    out = out.withColumn("subtype", subtype)
    sure = F.when(F.col("subtype") == "frozen", 0.85).when(F.col("subtype") == "noisy", 0.70).when(F.col("subtype") == "drift", 0.65).otherwise(0.0)
    return out.select(*keys, "points", "frozen_segment", "frozen_share", "noise_ratio", "drift", "subtype", sure.alias("confidence"))


def quality_rules(df: DataFrame, keys: list[str], by: list[str], status: str = "quality_status", interval: float = 1.0, long_run: int = 10, bad_share: float = 0.1, uncertain_share: float = 0.2, run: int = 5, short: tuple[int, int] = (3, 10)) -> DataFrame:
    """(keys, points, bad, longest, bad_share, uncertain_share, rule, confidence) by runs of Bad codes in time order.

    Q001: a run above long_run; Q004: one above `run`; Q002: the share of Bad; Q003: the share of codes neither
    Good nor Bad; Q005: a run within `short`; else NORMAL. The first that applies counts, in this order. Q001 is
    the surer the longer the run lasts: 0.6, above a minute 0.75, above ten 0.9."""
    w = Window.partitionBy(*keys).orderBy(*by)
    bad = F.col(status) == "Bad"
    df = df.withColumn("_i", F.row_number().over(w))
    df = df.withColumns({"_other": F.max(F.when(~bad, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_ends": bad & F.coalesce(F.lead(status).over(w) != "Bad", F.lit(True))})
    length = F.when(F.col("_ends"), F.col("_i") - F.coalesce("_other", F.lit(0)))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(bad).alias("bad"),
        F.coalesce(F.max(length), F.lit(0)).alias("longest"),
        (F.count_if(~bad & (F.col(status) != "Good")) / F.count(F.lit(1))).alias("uncertain_share"),
        F.coalesce(F.max(length.between(*short)), F.lit(False)).alias("_short"),
    )
    out = out.withColumn("bad_share", F.col("bad") / F.col("points"))
    rule = F.when(F.col("longest") > long_run, "Q001").when(F.col("longest") > run, "Q004").when(F.col("bad_share") > bad_share, "Q002").when(F.col("uncertain_share") > uncertain_share, "Q003").when(F.col("_short"), "Q005").otherwise("NORMAL")
    out = out.withColumn("rule", rule)
    lasting = F.col("longest") * max(interval, 0.001)
    sure = F.when(F.col("rule") == "Q001", F.when(lasting > 600, 0.9).when(lasting > 60, 0.75).otherwise(0.6)).when(F.col("rule") == "Q004", 0.8).when(F.col("rule").isin("Q002", "Q003"), 0.6).when(F.col("rule") == "Q005", 0.4).otherwise(0.0)
    return out.select(*keys, "points", "bad", "longest", "bad_share", "uncertain_share", "rule", sure.alias("confidence"))
