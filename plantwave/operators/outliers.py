"""Outlier detectors and validity of samples, as window expressions on one hash partitioning of the loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.signals import THRESHOLDS, lookup, missing, normalise, present, quality

#: Reasons that mark a sample without making it invalid.
MARK_ONLY = ("TS_ANOMALY", "HF_NOISE", "FROZEN")


def order(keys: list[str], by: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def out_of_range(x: Column, low: float, high: float) -> Column:
    return ~missing(x) & ((x < low) | (x > high))


def threshold(control: str | Column, name: str) -> Column:
    """A limit of a control type, which may be a column: one pass serves loops of all types."""
    if isinstance(control, str):
        return F.lit(THRESHOLDS[control][name])
    return lookup(control, {k: t[name] for k, t in THRESHOLDS.items()}, THRESHOLDS["FC"][name])


def jump(x: Column, w: WindowSpec, limit: Column | float) -> Column:
    """The later of two neighbours that differ by more than the limit."""
    return F.coalesce(F.abs(x - F.lag(x).over(w)) > limit, F.lit(False))


def spike(x: Column, w: WindowSpec, limit: Column | float) -> Column:
    """Both neighbours differ by more than the limit."""
    return F.coalesce((F.abs(x - F.lag(x).over(w)) > limit) & (F.abs(x - F.lead(x).over(w)) > limit), F.lit(False))


def with_frozen(df: DataFrame, x: str, keys: list[str], by: list[str], points: int, limit: Column | float, out: str) -> DataFrame:
    """A sample is frozen if any full window of `points` samples over it has a population deviation below the limit."""
    w = order(keys, by)
    ahead = w.rowsBetween(0, points - 1)
    full, valid = F.count(F.lit(1)).over(ahead) == points, F.count(F.when(~missing(x), F.col(x))).over(ahead) >= 2
    still = F.stddev_pop(F.when(~missing(x), F.col(x))).over(ahead) < limit
    df = df.withColumn("_still", F.coalesce(full & valid & still, F.lit(False)))
    return df.withColumn(out, F.max("_still").over(w.rowsBetween(-(points - 1), 0))).drop("_still")


def ts_anomaly(ts: str, keys: list[str], by: list[str], interval: Column | float) -> Column:
    """Duplicate times, and gaps of more than twice the interval."""
    w = order(keys, by)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    step = (micros - F.lag(micros).over(w)) / 1e6
    return F.coalesce((step <= 0) | (step > interval * 2), F.lit(False)) | (F.count(F.lit(1)).over(Window.partitionBy(*keys, ts)) > 1)


def frozen(df: DataFrame, x: str, keys: list[str], by: list[str], span: float, control: str | Column, out: str) -> DataFrame:
    """with_frozen by control type: each window size that some type has, and of them the row's own."""
    if isinstance(control, str):
        return with_frozen(df, x, keys, by, THRESHOLDS[control]["frozen_window"], THRESHOLDS[control]["frozen"] * span, out)
    sizes = sorted({t["frozen_window"] for t in THRESHOLDS.values()})
    for n in sizes:
        df = with_frozen(df, x, keys, by, n, threshold(control, "frozen") * span, f"_frozen{n}")
    return df.withColumn(out, lookup(threshold(control, "frozen_window"), {n: F.col(f"_frozen{n}") for n in sizes}, False)).drop(*(f"_frozen{n}" for n in sizes))


def detect(df: DataFrame, signal: str, keys: list[str], by: list[str], low: float, high: float, control: str | Column = "FC", quality_code: str | None = None, ts: str | None = None, interval: float | None = None, freezes: bool = True) -> DataFrame:
    """Adds <signal>_reasons and <signal>_valid; reasons in fixed order. All windows share keys and order, so one shuffle and one sort.

    The control type may be a column; freezes: whether the signal is checked for standing still."""
    span = high - low
    w, x = order(keys, by), present(signal)  # NaN is above every number in comparisons
    df = frozen(df, signal, keys, by, span, control, "_frozen") if freezes else df.withColumn("_frozen", F.lit(False))
    named = [
        ("NAN", x.isNull()),
        ("OUT_OF_RANGE", out_of_range(x, low, high)),
        ("FROZEN", F.col("_frozen") & x.isNotNull()),
        ("JUMP", jump(x, w, threshold(control, "jump") * span)),
        ("SPIKE", spike(x, w, threshold(control, "spike") * span)),
    ]
    if ts:
        named.append(("TS_ANOMALY", ts_anomaly(ts, keys, by, threshold(control, "interval") if interval is None else interval)))
    if quality_code:
        named.append(("QC_BAD", quality(quality_code) != "Good"))
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in named)))
    df = df.withColumn(f"{signal}_reasons", reasons).drop("_frozen")
    hard = F.filter(f"{signal}_reasons", lambda r: ~r.isin(*MARK_ONLY))
    return df.withColumn(f"{signal}_valid", F.size(hard) == 0)


def preprocess(df: DataFrame, keys: list[str], by: list[str], pv_range: tuple, op_range: tuple = (0, 100), control: str | Column = "FC", ts: str = "ts") -> DataFrame:
    """quality → normalise → detect → validity, in that order, for pv, sp and op. Ranges and control type may be columns; only pv is checked for standing still."""
    df = df.withColumns({"quality_status": quality("quality"), "pv": normalise("pv", *pv_range), "sp": normalise("sp", *pv_range), "op": normalise("op", *op_range)})
    df = detect(df, "pv", keys, by, 0, 100, control, "quality", ts)
    for signal in ("sp", "op"):
        df = detect(df, signal, keys, by, 0, 100, control, freezes=False)
    return df.withColumns({"mode_valid": F.col("mode").isNotNull(), "all_valid": F.col("pv_valid") & F.col("sp_valid") & F.col("op_valid") & F.col("mode").isNotNull()})


def repair_spikes(df: DataFrame, signal: str, flag: str, keys: list[str], by: list[str]) -> Column:
    """Flagged samples take the last value that was not flagged."""
    return F.last(F.when(~F.col(flag), F.col(signal)), ignorenulls=True).over(order(keys, by).rowsBetween(Window.unboundedPreceding, 0))


def spike_runs(df: DataFrame, signal: str, keys: list[str], by: list[str], limit: float, longest: int = 5) -> DataFrame:
    """Adds spike: rows between an abrupt change and an abrupt return at most `longest` rows later.

    Abrupt changes that follow each other that closely form a cluster; within it odd ones leave and even ones return."""
    w = order(keys, by)
    x = present(signal)
    df = df.withColumns({"_n": F.row_number().over(w), "_abrupt": F.coalesce(F.abs(x - F.lag(x).over(w)) > limit, F.lit(False))})
    at = F.when(F.col("_abrupt"), F.col("_n"))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumns({"_fresh": (F.col("_abrupt") & F.coalesce(F.col("_n") - before > longest, F.lit(True))).cast("int"), "_ahead": ahead})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_cluster", F.sum("_fresh").over(running))
    inside = Window.partitionBy(*keys, "_cluster").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    count, since = F.sum(F.col("_abrupt").cast("int")).over(inside), F.last(at, ignorenulls=True).over(inside)
    df = df.withColumn("spike", F.coalesce((count % 2 == 1) & (F.col("_ahead") - since <= longest), F.lit(False)))
    return df.drop("_n", "_abrupt", "_fresh", "_ahead", "_cluster")


def quality_summary(df: DataFrame, keys: list[str], signal: str, ts: str, interval: float) -> DataFrame:
    """Counts and rates against the samples that the span and interval let expect."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    span = seconds(F.max(ts)) - seconds(F.min(ts))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col(f"{signal}_valid")).alias("valid"),
        F.count_if(missing(signal)).alias("absent"),
        (F.floor(span / interval) + 1).alias("expected"),
    )
    rate = lambda c: F.bround(F.col(c) / F.col("points"), 4)
    return out.withColumns({"valid_rate": rate("valid"), "missing_rate": rate("absent"), "bad_rate": F.bround(1 - F.col("valid") / F.col("points"), 4)})
