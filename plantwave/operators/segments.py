"""Gaps and islands, carried-forward values, hold durations, nearest and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, flag: str, keys: list[str], by: list[str], least: int = 1) -> DataFrame:
    """Runs of rows whose flag is true: (keys, start, end, points), runs below `least` dropped.

    Row number among all less row number among flagged is constant within a run."""
    w, flagged = Window.partitionBy(*keys).orderBy(*by), Window.partitionBy(*keys, flag).orderBy(*by)
    numbered = df.withColumns({"_n": F.row_number().over(w), "_run": F.row_number().over(w) - F.row_number().over(flagged)})
    runs = numbered.where(F.col(flag)).groupBy(*keys, "_run").agg(F.min("_n").alias("start"), F.max("_n").alias("end"), F.count(F.lit(1)).alias("points"))
    return runs.where(F.col("points") >= least).drop("_run")


def bounded(df: DataFrame, keys: list[str], by: list[str], most: int) -> DataFrame:
    """Adds segment: the rows of a key in order, in equal shares of at most `most` rows; by[0] is a time.

    Rows are numbered within their hour and hours are counted before, so no task needs the whole history of a key."""
    hours = df.withColumn("_hour", F.date_trunc("hour", by[0]))
    w = Window.partitionBy(*keys)
    counts = hours.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate([*keys, "_hour"])), before.alias("_before"), F.sum("_n").over(w).alias("_all"))
    numbered = hours.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_hour").orderBy(*by)))
    out = numbered.join(counts, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate([*keys, "_hour"])])
    return out.withColumn("segment", F.expr(f"((_before + _n - 1) * ((_all + {most - 1}) div {most})) div _all")).select(*df.columns, "segment")


def carried(x: str, keys: list[str], by: list[str]) -> Column:
    """The last value that is not null, for signals stored on change."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))


def adjacent(x: str, keys: list[str], by: list[str], step: int) -> Column:
    """The step-th known value of a column after the row (before it, if negative); Spark walks the window once."""
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    return F.expr(f"{'lead' if step > 0 else 'lag'}(`{x}`, {abs(step)}) ignore nulls over (partition by {quoted(keys)} order by {quoted(by)})")


def seeded(rows: DataFrame, before: DataFrame, signals: list[str], keys: list[str], ts: str) -> DataFrame:
    """Carries signals forward in rows from the last values before their window (a table keys, ts, signals)."""
    both = rows.withColumn("_seed", F.lit(False)).unionByName(before.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    return both.withColumns({s: carried(s, keys, [ts]) for s in signals}).where(~F.col("_seed")).drop("_seed")


def carried_over(df: DataFrame, signals: list[str], keys: list[str], part: str, by: list[str], before: DataFrame | None = None) -> DataFrame:
    """Carries signals stored on change forward from part to part (hours) of a key, first from values before them (keys, signals).

    Within a part a window carries; from part to part only the last value of each part moves, so no task sees a key's
    whole history."""
    order = F.struct(*by)
    lasts = df.groupBy(*keys, part).agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), order)).alias(f"_{s}") for s in signals))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    seeds = lasts.select(*keys, part, *(F.last(f"_{s}", ignorenulls=True).over(earlier).alias(f"_{s}") for s in signals))
    if before is not None:
        seeds = seeds.join(before.select(*keys, *(F.col(s).alias(f"_before_{s}") for s in signals)), keys, "left").select(*keys, part, *(F.coalesce(f"_{s}", f"_before_{s}").alias(f"_{s}") for s in signals))
    out = df.join(seeds, [*keys, part], "left")
    return out.withColumns({s: F.coalesce(carried(s, [*keys, part], by), F.col(f"_{s}")) for s in signals}).drop(*(f"_{s}" for s in signals))


def last_before(df: DataFrame, keys: list[str], ts: str, signals: list[str], at) -> DataFrame:
    """The latest value of every signal before a time, each taken where it is not null."""
    return df.where(F.col(ts) < at).groupBy(*keys).agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col(ts))).alias(s) for s in signals))


def seconds(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def hold(ts: str, keys: list[str], by: list[str]) -> Column:
    """Seconds a sample holds: until the next one; the last as long as the one before; a single one 0."""
    w = Window.partitionBy(*keys).orderBy(*by)
    at = seconds(ts)
    return F.coalesce(F.lead(at).over(w) - at, at - F.lag(at).over(w), F.lit(0.0))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Each row of left with the values of the last row of right at or before it: a union and one window, no range join."""
    a = left.withColumn("_left", F.lit(1))
    b = right.select(*keys, ts, *(F.col(v).alias(f"_{v}") for v in values)).withColumn("_left", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    # values come from one row: the last one of right, whether null or not
    row = F.last(F.when(F.col("_left") == 0, F.struct(*(f"_{v}" for v in values))), ignorenulls=True).over(w)
    return both.withColumn("_row", row).where("_left = 1").select(*left.columns, *(F.col(f"_row._{v}").alias(v) for v in values))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, tolerance: float, unique: list[str]) -> DataFrame:
    """The value of right nearest in time within the tolerance; the earlier one of two as near.

    Times are dealt into buckets of the tolerance, so only rows of neighbouring buckets meet in an equi-join."""
    a = left.withColumn("_bucket", F.floor(seconds(ts) / tolerance))
    b = right.select(*keys, F.col(ts).alias("_ts"), F.col(value).alias("_value"), F.explode(F.array(*(F.floor(seconds(ts) / tolerance) + i for i in (-1, 0, 1)))).alias("_bucket"))
    apart = F.abs(seconds("_ts") - seconds(ts))
    met = a.join(b, [*keys, "_bucket"]).where(apart <= tolerance).groupBy(*keys, *unique).agg(F.min_by("_value", F.struct(apart, "_ts", "_value")).alias(value))
    return left.join(met, [*keys, *unique], "left")


def aligned(df: DataFrame, keys: list[str], ts: str, role: str, value: str, roles: list[str]) -> DataFrame:
    """Single-tag rows as one wide row a time; roles without a sample are null."""
    return df.groupBy(*keys, ts).pivot(role, roles).agg(F.first(value, ignorenulls=True))


def last_write(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row a key, the one last written."""
    w = Window.partitionBy(*keys).orderBy(*version)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table with changed rows replaced and new ones added; of several changes the latest counts."""
    latest = last_write(changes, keys, [F.desc(version)])
    return table.join(latest, keys, "left_anti").unionByName(latest)


def dense(start: Column, end: Column, step: str) -> Column:
    return F.explode(F.sequence(start, end, F.expr(f"interval {step}")))
