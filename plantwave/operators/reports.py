"""Report building blocks: latest rows, rankings, distributions, trends on a dense axis, attention, handling, integrity, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import SEVERITIES, lookup, score_grade

# Priority of an alert by severity, limits of a score's fall, order of stages.
PRIORITIES = ("URGENT", "HIGH", "MEDIUM", "LOW")
SEVERITY_PRIORITY = {"CRITICAL": "URGENT", "ERROR": "HIGH", "WARN": "MEDIUM", "INFO": "LOW"}
FALLS = ((-10, "HIGH"), (-5, "MEDIUM"), (-2, "LOW"))
STAGES = {"OPEN": 0, "OVERDUE": 1, "IN_PROGRESS": 2, "VERIFYING": 2, "ACKNOWLEDGED": 3, "SUPPRESSED": 4}
RISKS = {"score": (-1, 35, 60), "oscillation": (1, 25, 20), "saturation": (1, 15, 20), "steady": (-1, 25, 80)}


def latest(df: DataFrame, keys: list[str], *by: Column) -> DataFrame:
    """First row of each key in an order; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_conclusive(snapshots: DataFrame) -> DataFrame:
    """A loop's newest snapshot, conclusive ones before others."""
    return latest(snapshots, ["loop_id"], F.when(F.col("status") == "INCONCLUSIVE", 1).otherwise(0), F.desc("ts"), F.desc("snapshot_id"))


def grade_distribution(snapshots: DataFrame) -> DataFrame:
    return latest_conclusive(snapshots).groupBy(score_grade("score").alias("grade")).agg(F.count(F.lit(1)).alias("loops"))


def ranking(snapshots: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The worst loops by their latest conclusive score; loops without one last."""
    return latest_conclusive(snapshots).orderBy(F.asc_nulls_last("score"), "loop_id").offset(offset).limit(limit)


def dense_trend(df: DataFrame, ts: str, start: str, days: int, values: dict[str, Column]) -> DataFrame:
    """Aggregates by day on an axis without gaps; days without rows are null."""
    first = F.to_date(F.lit(start))
    axis = df.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("day"))
    made = df.where((F.col(ts) >= first) & (F.col(ts) < F.date_add(first, days))).groupBy(F.to_date(ts).alias("day")).agg(*(v.alias(k) for k, v in values.items()))
    return axis.join(F.broadcast(made), "day", "left")  # a row a day


def priority(severity: Column | str) -> Column:
    return lookup(severity, SEVERITY_PRIORITY, "LOW")


def fall_priority(change: Column | str) -> Column:
    x = F.col(change) if isinstance(change, str) else change
    out = F.lit(None).cast("string")
    for limit, name in reversed(FALLS):
        out = F.when(x <= limit, name).otherwise(out)
    return out


def attention(sources: list[DataFrame], page: int, size: int = 500) -> DataFrame:
    """Items (loop_id, priority, stage, ts, kind) of all sources as one queue entry a loop, the most urgent first."""
    items = sources[0]
    for s in sources[1:]:
        items = items.unionByName(s)
    position = lambda x: lookup(x, {p: i for i, p in enumerate(PRIORITIES)}, 9)
    grouped = items.groupBy("loop_id").agg(F.min(position("priority")).alias("urgency"), F.min(lookup("stage", STAGES, 9)).alias("stage"), F.max("ts").alias("newest"), F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return grouped.orderBy("urgency", "stage", F.desc("newest"), "loop_id").offset(page * size).limit(size)


def escalated(severity: Column | str, repeats: Column | str, after: int = 3) -> Column:
    """One severity higher from `after` repeats on."""
    x = F.col(severity) if isinstance(severity, str) else severity
    up = lookup(x, {s: SEVERITIES[min(i + 1, len(SEVERITIES) - 1)] for i, s in enumerate(SEVERITIES)})
    return F.when((F.col(repeats) if isinstance(repeats, str) else repeats) >= after, up).otherwise(x)


def downgraded(severity: Column | str) -> Column:
    """One severity lower; null (skipped) below INFO."""
    return lookup(severity, {s: SEVERITIES[i - 1] for i, s in enumerate(SEVERITIES) if i})


def completeness(counts: DataFrame, expected: Column) -> DataFrame:
    """Share of expected rows, at most 1, and its band."""
    share = F.least(F.lit(1.0), F.try_divide(F.col("rows"), expected))
    return counts.withColumn("completeness", F.coalesce(share, F.lit(0.0))).withColumn("band", F.when(F.col("completeness") >= 0.95, "COMPLETE").when(F.col("completeness") >= 0.20, "PARTIAL").otherwise("MISSING"))


def next_action() -> Column:
    """The one next step of a loop by the first rule that applies, over columns complete, has_data, assessed,
    worsened, diagnosed, tunable, tracked, tuning (status), order_state."""
    c = F.col
    return (
        F.when(~c("complete"), "FIX_TAG_CONFIG")
        .when(~c("has_data"), "IMPORT_DATA")
        .when(~c("assessed") | c("worsened"), "RUN_ASSESSMENT")
        .when(~c("diagnosed"), "RUN_DIAGNOSIS")
        .when(~c("tunable") & ~c("tracked"), "CREATE_TRACKER")
        .when(c("tunable") & (c("tuning").isNull() | c("tuning").isin("NOT_REQUIRED", "NOT_STARTED", "INCONCLUSIVE", "BLOCKED")), "RUN_TUNING")
        .when(c("tuning").isin("COMPLETED", "SIMULATED") & c("order_state").isin("OPEN", "IN_PROGRESS"), "RECORD_IMPLEMENTATION")
        .when(c("order_state") == "VERIFYING", "VERIFY_EFFECT")
        .otherwise("KEEP_MONITORING")
    )


def hour_buckets(spark, start: str, end: str, interval: float = 1.0) -> DataFrame:
    """(hour, expected) of a range: the first and last hour expect only the rows of their real seconds."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    hours = spark.range(1).select(F.explode(F.sequence(F.date_trunc("hour", a), F.date_trunc("hour", b - F.expr("interval 1 microsecond")), F.expr("interval 1 hour"))).alias("hour"))
    inside = F.unix_micros(F.least(F.col("hour") + F.expr("interval 1 hour"), b)) - F.unix_micros(F.greatest(F.col("hour"), a))
    return hours.select("hour", F.ceil(inside / 1e6 / interval).alias("expected"))


def regression(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of y over x, null below three points."""
    paired = F.when(y.isNotNull(), x)
    slope = F.when(F.count(paired) >= 3, F.try_divide(F.covar_pop(x, y), F.var_pop(paired)))
    return slope, F.avg(F.when(x.isNotNull(), y)) - slope * F.avg(paired)


def contribution(name: str, slope: Column, current: Column) -> Column:
    """Share of a trend in the risk score: slope times how near the last known value is to the limit, capped.

    Beyond the limit counts 1.5; a trend without a known value counts 1."""
    sign, cap, limit = RISKS[name]
    past = current < limit if sign < 0 else current > limit
    to_limit = {"score": F.greatest(F.lit(0.5), 100 - current) / 40, "steady": F.greatest(F.lit(0.5), (100 - current) / 20)}.get(name, F.greatest(F.lit(0.5), current / limit))
    near = F.when(current.isNull(), 1.0).when(past, 1.5).otherwise(to_limit)
    return F.when(slope * sign > 0.01, F.least(F.lit(float(cap)), F.abs(slope) * 20 * near)).otherwise(0.0)


def snapshot_filter(start: str | None = None, end: str | None = None, least: float | None = None, most: float | None = None, confidences: list[str] | None = None, statuses: list[str] | None = None, loop_types: list[str] | None = None, units: list[int] | None = None, active: bool | None = None) -> Column:
    """The filters of snapshot lists as one predicate; absent ones let everything pass. Times are [start, end)."""
    c = F.col
    tests = [
        start is not None and (c("ts") >= F.lit(start).cast("timestamp_ntz")),
        end is not None and (c("ts") < F.lit(end).cast("timestamp_ntz")),
        least is not None and (c("score") >= least),
        most is not None and (c("score") <= most),
        *(wanted is not None and c(name).isin(wanted) for name, wanted in (("confidence", confidences), ("status", statuses), ("loop_type", loop_types), ("unit_id", units))),
        active is not None and (c("is_active") == active),
    ]
    out = F.lit(True)
    for test in tests:
        out = out if test is False else out & test
    return out


def metric_summary(kpis: DataFrame, found: DataFrame, keys: list[str], rates: dict[str, str]) -> DataFrame:
    """Indicator means of a window; a rate without one comes from the operators' shares (times 100). rates: column → name of its <name>_source."""
    both = kpis.alias("k").join(found.alias("f"), keys, "full")
    own = [F.col(f"k.{c}").alias(c) for c in kpis.columns if c not in keys and c not in rates]
    shown = [x for c, n in rates.items() for x in (F.coalesce(F.col(f"k.{c}"), F.col(f"f.{c}") * 100).alias(c), F.when(F.col(f"k.{c}").isNotNull(), "kpi").when(F.col(f"f.{c}").isNotNull(), "operator").otherwise("none").alias(f"{n}_source"))]
    return both.select(*keys, *own, *shown)


def before_after(df: DataFrame, keys: list[str], ts: str, at, days: int, values: list[str]) -> DataFrame:
    """Means of the windows before and after a time, and their difference."""
    span = F.expr(f"interval {days} days")
    before = (F.col(ts) >= at - span) & (F.col(ts) < at)
    after = (F.col(ts) >= at) & (F.col(ts) <= at + span)
    out = df.groupBy(*keys).agg(*(F.avg(F.when(part, F.col(v))).alias(f"{v}_{name}") for v in values for name, part in (("before", before), ("after", after))))
    return out.withColumns({f"{v}_change": F.col(f"{v}_after") - F.col(f"{v}_before") for v in values})


def label_changes(before: DataFrame, after: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """Labels added, removed, or of changed confidence between two sets (keys, confidence)."""
    both = before.withColumnRenamed("confidence", "was").join(after.withColumnRenamed("confidence", "now"), keys, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.abs(F.col("now") - F.col("was")) > least, "changed")
    return both.withColumn("change", change).where("change is not null")
