"""Autoregression, settling and half cycles from sums that one grouping makes of ordered samples.

A window's autocovariances are sums of products of neighbours, so a group needs its moments and never its samples in
Python; moments of parts of a window add up when each part takes its last lags from the part before it. The equations of a
second-order model are solved in closed form and its impulse response runs in an `aggregate` with three numbers as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import adjacent

#: Lags of the moments, steps of the impulse response for settling and for the time constant, its threshold.
LAGS, STEPS, TAU_STEPS, THRESHOLD = 2, 1000, 500, 0.05


def lagged(df: DataFrame, x: str, keys: list[str], by: list[str], lags: int = LAGS, halo: str | None = None) -> DataFrame:
    """Adds <x>_0, the value less its key's mean, and <x>_k, its product with the k-th known value before it.

    halo: a flag of rows that only serve as neighbours (the end of the part before); their own products are null."""
    own = F.col(x) if halo is None else F.when(~F.col(halo), F.col(x))
    df = df.withColumn("_y", F.col(x) - F.avg(own).over(Window.partitionBy(*keys)))
    made = {f"{x}_{k}": F.col("_y") * adjacent("_y", keys, by, -k) for k in range(1, lags + 1)}
    df = df.withColumns({f"{x}_0": F.col("_y") * F.col("_y")} | made)
    if halo is not None:
        df = df.withColumns({f"{x}_{k}": F.when(~F.col(halo), F.col(f"{x}_{k}")) for k in range(lags + 1)})
    return df.drop("_y")


def sums(x: str, lags: int = LAGS) -> dict[str, Column]:
    """Aggregates of lagged(): <x>_n, and the autocovariances <x>_r0, <x>_r1, ... as sums over n."""
    n = F.count(x)
    return {f"{x}_n": n} | {f"{x}_r{k}": F.try_divide(F.coalesce(F.sum(f"{x}_{k}"), F.lit(0.0)), n) for k in range(lags + 1)}


def second_order(x: str) -> tuple[Column, Column]:
    """a1, a2 of x(t) + a1 x(t-1) + a2 x(t-2) = noise from the moments (Yule-Walker); such a model is always stable.

    Where the equations are singular the one of the first order stands in."""
    r0, r1, r2 = (F.col(f"{x}_r{k}") for k in range(3))
    det = r0 * r0 - r1 * r1
    solid = det > 1e-12 * r0 * r0
    return F.when(solid, F.try_divide(r1 * (r2 - r0), det)).otherwise(F.try_divide(-r1, r0)), F.when(solid, F.try_divide(r1 * r1 - r0 * r2, det)).otherwise(F.lit(0.0))


def settling(df: DataFrame, x: str, interval: Column, least: int = 100) -> DataFrame:
    """Adds settling_outcome and settling_time (seconds) to rows of moments.

    Settled is where the impulse response stays below THRESHOLD for ten seconds, three samples at least; a response
    that never does counts the window of STEPS samples."""
    a1, a2 = second_order(x)
    run = F.greatest(F.lit(3), F.floor(F.lit(10.0) / interval).cast("int"))
    start = F.struct(F.lit(1.0).alias("g"), F.lit(0.0).alias("h"), F.lit(0).alias("low"), F.lit(-1).alias("at"))

    def step(s: Column, k: Column) -> Column:
        g = -F.col("_a1") * s["g"] - F.col("_a2") * s["h"]
        low = F.when(F.abs(g) < THRESHOLD, s["low"] + 1).otherwise(F.lit(0))
        return F.struct(g.alias("g"), s["g"].alias("h"), low.alias("low"), F.when((s["at"] < 0) & (low >= F.col("_run")), k - F.col("_run") + 1).otherwise(s["at"]).alias("at"))

    df = df.withColumns({"_a1": a1, "_a2": a2, "_run": run})
    fit = (F.col(f"{x}_n") >= least) & (F.sqrt(f"{x}_r0") >= 1e-9)
    at = F.when(fit, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), start, step, lambda s: s["at"]))
    outcome = F.when(F.col(f"{x}_n") < least, "IDENTIFICATION_FAILED").when(F.sqrt(f"{x}_r0") < 1e-9, "ALREADY_STABLE").when(F.col("_at") > 0, "SETTLED").otherwise("NEVER_SETTLES")
    df = df.withColumn("_at", at).withColumn("settling_outcome", outcome)
    seconds = F.when(F.col("settling_outcome") == "SETTLED", F.col("_at") * interval).when(F.col("settling_outcome") == "ALREADY_STABLE", 0.0).when(F.col("settling_outcome") == "NEVER_SETTLES", STEPS * interval)
    return df.withColumn("settling_time", seconds).drop("_a1", "_a2", "_run", "_at")


def time_constant(df: DataFrame, x: str, interval: Column, least: int = 100) -> DataFrame:
    """Adds time_constant: the centroid of the size of the impulse response, in seconds; null for constant or short windows."""
    a1, a2 = second_order(x)
    zero = F.lit(0.0)
    start = F.struct(F.lit(1.0).alias("g"), zero.alias("h"), F.lit(1.0).alias("all"), zero.alias("moment"))

    def step(s: Column, k: Column) -> Column:
        g = -F.col("_a1") * s["g"] - F.col("_a2") * s["h"]
        return F.struct(g.alias("g"), s["g"].alias("h"), (s["all"] + F.abs(g)).alias("all"), (s["moment"] + k * F.abs(g)).alias("moment"))

    df = df.withColumns({"_a1": a1, "_a2": a2})
    fit = (F.col(f"{x}_n") >= least) & (F.sqrt(f"{x}_r0") >= 1e-9)
    centre = F.when(fit, F.aggregate(F.sequence(F.lit(1), F.lit(TAU_STEPS - 1)), start, step, lambda s: s["moment"] / s["all"]))
    return df.withColumn("time_constant", centre * interval).drop("_a1", "_a2")


def harris(x: str, order: int) -> Column:
    """Variance over that of the residual of the model of this order: by Levinson's recursion on the moments, unrolled."""
    r = [F.col(f"{x}_r{k}") for k in range(order + 1)]
    state = F.struct(F.array(F.lit(1.0)).alias("a"), r[0].alias("v"))

    def step(s: Column, k: Column) -> Column:
        dot = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda t, i: t + F.get(s["a"], i) * F.get(F.array(*r), k - i))
        turn = -F.try_divide(dot, s["v"])
        longer = F.concat(s["a"], F.array(F.lit(0.0)))
        a = F.zip_with(longer, F.reverse(longer), lambda p, q: p + turn * q)
        return F.struct(a.alias("a"), (s["v"] * (1 - turn * turn)).alias("v"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), state, step, lambda s: F.when(s["v"] > 0, r[0] / s["v"]))


def edges(df: DataFrame, x: str, keys: list[str], by: list[str]) -> DataFrame:
    """Adds _edge at the rows where known values change their side of zero: (values before it, their area, their sum).

    Zeros take the side before them."""
    w = Window.partitionBy(*keys).orderBy(*by)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_side", F.last(F.when(F.col(x) != 0, F.signum(x)), ignorenulls=True).over(running))
    df = df.withColumns({"_turn": F.col(x).isNotNull() & (F.col("_side") * F.lag("_side").over(w) < 0), "_count": F.count(x).over(running), "_area": F.sum(F.abs(x)).over(running), "_sum": F.sum(x).over(running)})
    edge = F.struct((F.col("_count") - 1).alias("n"), (F.col("_area") - F.abs(x)).alias("area"), (F.col("_sum") - F.col(x)).alias("sum"))
    return df.withColumn("_edge", F.when(F.col("_turn"), edge)).drop("_side", "_turn", "_count", "_area", "_sum")


def edge_list() -> Column:
    """Aggregate: the edges in order."""
    return F.sort_array(F.collect_list("_edge"))


def swings(df: DataFrame, threshold: float = 0.4, low: float = 0.05, high: float = 15.0, least_crossings: int = 4) -> DataFrame:
    """Adds crossings, half_cycle (samples), oscillation_rate, is_oscillating, period to rows with edges; edges go.

    The likeness of a side's half cycles is how near the mean of their areas lies to the medoid, the area nearest the mean;
    areas far from the medoid do not count. One expression makes them all, so that no optimiser repeats a part of it for
    every half cycle, as it does with columns of columns under a filter."""
    between = lambda e, i, part: e[i + 1][part] - e[i][part]
    cycle = lambda e, i: F.struct(between(e, i, "area").alias("area"), between(e, i, "n").alias("n"), (between(e, i, "sum") > 0).alias("above"))
    cycles = lambda e: F.when(F.size(e) > 1, F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: cycle(e, i)))

    def measured(c: Column) -> Column:
        side = lambda of_side: once(F.transform(F.filter(c, of_side), lambda x: x["area"]), lambda a: _likeness(a, low, high))
        half = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["n"]) / F.size(c)
        return F.struct(half.alias("half_cycle"), side(lambda x: x["above"]).alias("s_a"), side(lambda x: ~x["above"]).alias("s_b"))

    df = df.withColumns({"crossings": F.size("edges"), "_swing": once(F.col("edges"), lambda e: once(cycles(e), measured))}).drop("edges")
    df = df.select("*", "_swing.*").drop("_swing")
    enough = (F.col("crossings") >= least_crossings) & F.col("s_a").isNotNull() & F.col("s_b").isNotNull()
    both = F.coalesce(enough & (F.col("s_a") >= threshold) & (F.col("s_b") >= threshold), F.lit(False))
    df = df.withColumns({"oscillation_rate": F.when(enough, F.least("s_a", "s_b") * 100).otherwise(0.0), "is_oscillating": both})
    return df.withColumn("period", F.when(F.col("is_oscillating"), 2 * F.col("half_cycle")).otherwise(0.0))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _likeness(areas: Column, low: float, high: float) -> Column:
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)

    def about(medoid: Column) -> Column:
        near = once(F.filter(areas, lambda a: F.try_divide(a, medoid).between(low, high)), lambda c: F.when(F.size(c) > 0, mean(c)))
        alike = F.coalesce(clamp01(1 - F.try_divide(F.abs(near - medoid), F.abs(medoid))), F.lit(0.0))
        return F.when((F.size(areas) < 2) | (F.abs(medoid) < 1e-12), 0.0).otherwise(alike)

    nearest = lambda centre: F.array_min(F.transform(areas, lambda a, i: F.struct(F.abs(a - centre).alias("far"), i.alias("i"), a.alias("area"))))["area"]
    return F.when(F.size(areas) > 0, once(once(mean(areas), nearest), about))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
