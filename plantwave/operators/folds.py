"""Folds over the ordered samples of a bounded window, inside Spark's generated and interpreted expressions: no sample
leaves the JVM. A window's samples are one array (a segment or a request bounds it) and the state of a fold is a struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import seconds


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def bias_shifts(df: DataFrame, x: str, keys: list[str], by: list[str], window: int = 30, k: float = 0.5, h: float = 5.0, amplitude: float = 1.0, least: int = 16, frequent: float = 5.0) -> DataFrame:
    """(keys, shift_count, places, shift_magnitude, shift_frequency an hour, detected, confidence) of level shifts of x.

    A two-sided cumulative sum of the deviations, k and h standard deviations its slack and limit, restarts at every alarm;
    the means of up to `window` values before and from the alarm on (five at least) must differ the alarm's way by more
    than `amplitude` deviations."""
    known = F.when(F.col(x).isNotNull(), F.struct(*by, F.col(x).cast("double").alias("_x")))
    df = df.groupBy(*keys).agg(F.sort_array(F.collect_list(known)).alias("_s"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"), (F.max(seconds(by[0])) - F.min(seconds(by[0]))).alias("_span"))
    sd, values = F.col("_sd"), F.col("_v")
    df = df.withColumn("_v", F.transform("_s", lambda s: s["_x"] - F.col("_mean"))).drop("_s")
    zero, none = F.lit(0.0), F.array().cast("array<struct<at:int,change:double>>")

    def step(s: Column, i: Column) -> Column:
        now = F.get(values, i)
        up, down = F.greatest(zero, s["up"] + now - k * sd), F.least(zero, s["down"] + now + k * sd)
        alarm = (up > h * sd) | (-down > h * sd)
        side = F.when(up > h * sd, 1.0).otherwise(-1.0)
        before, after = F.slice(values, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))), F.slice(values, i + 1, F.lit(window))
        change = mean(after) - mean(before)
        enough = alarm & (F.size(before) >= 5) & (F.size(after) >= 5)
        sure = F.when(enough, change * side > amplitude * sd).otherwise(False)
        found = F.when(sure, F.concat(s["found"], F.array(F.struct(i.alias("at"), change.alias("change"))))).otherwise(s["found"])
        return F.struct(F.when(alarm, zero).otherwise(up).alias("up"), F.when(alarm, zero).otherwise(down).alias("down"), found.alias("found"))

    start = F.struct(zero.alias("up"), zero.alias("down"), none.alias("found"))
    fit = (F.size("_v") >= least) & (sd >= 1e-9)
    df = df.withColumn("_found", F.when(fit, F.aggregate(F.sequence(F.lit(1), F.size("_v") - 1), start, step, lambda s: s["found"])).otherwise(none))
    count = F.size("_found")
    rate = F.when(fit, count / F.when(F.col("_span") > 0, F.col("_span") / 3600).otherwise(1.0)).otherwise(0.0)
    df = df.withColumns({"shift_count": count, "places": F.col("_found.at"), "shift_magnitude": F.when(count > 0, mean(F.transform("_found", lambda f: F.abs(f["change"])))).otherwise(0.0), "shift_frequency": rate})
    detected = fit & (F.col("shift_frequency") >= frequent)
    return df.select(*keys, "shift_count", "places", "shift_magnitude", "shift_frequency", detected.alias("detected"), F.when(detected, F.least(F.lit(0.95), F.col("shift_frequency") / 20)).otherwise(0.0).alias("confidence"))


def largest_triangles(df: DataFrame, value: str | list[str], keys: list[str], by: list[str], carry: list[str], threshold: int = 10_000, target: int = 2_000) -> DataFrame:
    """(keys, place, by, carry, values) of the samples kept of windows of more than `threshold`: the ends and, of each bucket
    between, the sample whose triangle with the last kept one and the mean of the next bucket is largest, the first of equals.

    Bucket i of target - 2 spans from int((i + 1) size) + 1 to int((i + 2) size) + 1. Missing values count as zero. Of
    several values on one axis, each scaled to its spread, the largest triangle counts. A last bucket at the very end
    keeps the end twice."""
    names = [value] if isinstance(value, str) else value
    row = F.struct(*(F.col(b) for b in by), *(F.col(c) for c in carry if c not in by), *(F.col(v) for v in names if v not in by and v not in carry))
    df = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    x = F.transform("_rows", lambda r: seconds(r[by[0]]))
    spread = lambda v: F.array_max(v) - F.array_min(v)
    df = df.withColumns({"_n": F.size("_rows"), "_x": x} | {f"_y{i}": _values(v) for i, v in enumerate(names)})
    scale = {f"_u{i}": F.when(spread(F.col(f"_y{i}")) > 0, spread(F.col(f"_y{i}"))).otherwise(1.0) if len(names) > 1 else F.lit(1.0) for i in range(len(names))}
    df = df.withColumns(scale)
    size, n = (F.col("_n") - 2) / F.lit(target - 2), F.col("_n")
    edge = lambda i: F.floor(i * size).cast("int") + 1
    part = lambda c, a, b: F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))
    centre = lambda c, a, b: F.when(b > a, mean(part(c, a, b))).otherwise(0.0)

    def step(s: Column, i: Column) -> Column:
        begin, end = edge(i + 1), F.least(edge(i + 2), n)
        after = F.least(edge(i + 3), n)
        last, mx = s["last"], centre(F.col("_x"), end, after)
        ax = F.get(F.col("_x"), last)
        series = [(F.col(f"_y{k}"), F.col(f"_u{k}")) for k in range(len(names))]
        around = F.struct(mx.alias("mx"), ax.alias("ax"), *(c.alias(f"{name}{k}") for k, (y, _) in enumerate(series) for name, c in (("my", centre(y, end, after)), ("ay", F.get(y, last)))))

        def best(f: Column) -> Column:
            def area(j: Column) -> Column:
                areas = [F.abs((f["ax"] - f["mx"]) * (F.get(y, j) - f[f"ay{k}"]) - (f["ax"] - F.get(F.col("_x"), j)) * (f[f"my{k}"] - f[f"ay{k}"])) * 0.5 / u for k, (y, u) in enumerate(series)]
                return F.struct((F.greatest(*areas) if len(areas) > 1 else areas[0]).alias("area"), (-j).alias("back"))

            return -F.array_max(F.transform(F.sequence(begin, end - 1), area))["back"]

        chosen = F.when(end > begin, F.get(F.transform(F.array(around), best), F.lit(0))).otherwise(begin)  # what a bucket shares is made once
        return F.struct(chosen.alias("last"), F.concat(s["kept"], F.array(chosen)).alias("kept"))

    start = F.struct(F.lit(0).alias("last"), F.array(F.lit(0)).alias("kept"))
    inner = F.aggregate(F.sequence(F.lit(0), F.lit(target - 3)), start, step, lambda s: F.concat(s["kept"], F.array(n - 1)))
    kept = F.when(n <= threshold, F.sequence(F.lit(0), n - 1)).when(n > 2, inner).otherwise(F.array(F.lit(0), n - 1))
    out = df.select(*keys, F.posexplode(F.transform(kept, lambda j: F.get(F.col("_rows"), j))).alias("place", "_r"))
    return out.select(*keys, "place", *(F.col(f"_r.{c}").alias(c) for c in dict.fromkeys([*by, *carry, *names])))


def _values(name: str) -> Column:
    return F.transform("_rows", lambda r: F.coalesce(r[name].cast("double"), F.lit(0.0)))
