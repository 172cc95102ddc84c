"""Streams of samples: down-sampling, last-known merge, alert state, late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.segments import upsert

#: Rows that the last-hour buffer of a loop holds.
BUFFER_ROWS = 4500


def minute_aggregates(signals: list[str]) -> list[Column]:
    return [f(s).alias(f"{s}_{n}") for s in signals for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("count", F.count))]


def downsample(df: DataFrame, signals: list[str], width: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """Tumbling windows a loop; the same plan serves streams (with a watermark) and their batch twin."""
    if df.isStreaming and late:
        df = df.withWatermark("ts", late)
    out = df.groupBy("loop_id", F.window("ts", width).alias("w")).agg(*minute_aggregates(signals))
    return out.select("loop_id", F.col("w.start").alias("ts"), *(f"{s}_{n}" for s in signals for n in ("avg", "min", "max", "count")))


def hours_of_minutes(minutes: DataFrame, signals: list[str], weighted: bool = False) -> DataFrame:
    """Hours from minutes: mean of means as the store keeps it, or weighted by counts."""
    mean = lambda s: F.try_divide(F.sum(F.col(f"{s}_avg") * F.col(f"{s}_count")), F.sum(f"{s}_count")) if weighted else F.avg(f"{s}_avg")
    return minutes.groupBy("loop_id", F.date_trunc("hour", "ts").alias("ts")).agg(*(c for s in signals for c in (mean(s).alias(f"{s}_avg"), F.min(f"{s}_min").alias(f"{s}_min"), F.max(f"{s}_max").alias(f"{s}_max"), F.sum(f"{s}_count").alias(f"{s}_count"))))


def consistency(raw: DataFrame, minutes: DataFrame, signal: str) -> DataFrame:
    """Minutes whose stored aggregates differ from the samples."""
    fresh = downsample(raw, [signal], late=None)
    both = fresh.alias("a").join(minutes.alias("b"), ["loop_id", "ts"], "full")
    return both.where(~F.col(f"a.{signal}_count").eqNullSafe(F.col(f"b.{signal}_count")) | (F.abs(F.col(f"a.{signal}_avg") - F.col(f"b.{signal}_avg")) > 1e-6)).select("loop_id", "ts")


def last_known(stream: DataFrame, signals: list[str]) -> DataFrame:
    """Wide rows with signals that came earlier carried into later rows; one small state a loop."""
    schema = "loop_id long, ts timestamp, " + ", ".join(f"{s} double" for s in signals)

    def merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get) if state.exists else [None] * len(signals)
        for part in parts:
            part = part.sort_values("ts")
            seed = pd.DataFrame([known], columns=signals, dtype=float)
            full = pd.concat([seed, part[signals]], ignore_index=True).ffill().iloc[1:]
            known = [None if pd.isna(x) else float(x) for x in full.iloc[-1]] if len(full) else known
            yield pd.DataFrame({"loop_id": key[0], "ts": part["ts"].to_numpy(), **{s: full[s].to_numpy() for s in signals}})
        state.update(tuple(known))

    return stream.groupBy("loop_id").applyInPandasWithState(merge, schema, ", ".join(f"{s} double" for s in signals), "append", GroupStateTimeout.NoTimeout)


def alert_steps(rows: list[tuple[float, str, bool]], known: dict, cool_down: float, debounce: float, throttle: float) -> list[tuple[float, str, int]]:
    """(time, rule, repeats) of the alerts from a loop's evaluations (time, rule, hit) in order; `known` is its state.

    A loop is evaluated at most once in the throttle's time, all rules of one moment together. A hit must last for the
    debounce time, and the condition's break begins it anew; after an alert its rule is quiet for the cool-down."""
    out = []
    for at, rule, hit in rows:
        open_ = known.get("open")
        if open_ is not None and open_ != at and at - open_ < throttle:
            continue
        known["open"] = at
        first, last, repeats = known["rules"].get(rule, (None, None, 0))
        if not hit:
            first = None
        else:
            first = at if first is None else first
            if at - first >= debounce and (last is None or at - last >= cool_down):
                repeats, last = repeats + 1, at
                out.append((at, rule, repeats))
        known["rules"][rule] = (first, last, repeats)
    return out


ALERT = "loop_id long, rule_id string, ts timestamp, repeats int, escalated boolean"


class AlertState(StatefulProcessor):
    """A loop's state: a value (when it was last evaluated) and a map (of each rule first hit, last alert, repeats), so a
    batch reads and writes the rules it has rows of. An event-time timer forgets a loop that has had no row for a time."""

    def __init__(self, cool_down: float, debounce: float, throttle: float, escalate_after: int, forget: float) -> None:
        self.limits, self.escalate_after, self.forget = (cool_down, debounce, throttle), escalate_after, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at double")
        self.rules = handle.getMapState("rules", "rule_id string", "first double, last double, repeats int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = evaluations_of(rows)
        asked = {rule for _, rule, _ in found}
        before = {rule: tuple(self.rules.getValue((rule,))) for rule in asked if self.rules.containsKey((rule,))}
        known = {"open": self.open.get()[0] if self.open.exists() else None, "rules": dict(before)}
        fired = alert_steps(found, known, *self.limits)
        for rule, state in known["rules"].items():
            if state != before.get(rule):
                self.rules.updateValue((rule,), state)
        if known["open"] is not None:
            self.open.update((known["open"],))
        if found:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((max(at for at, _, _ in found) + self.forget) * 1000))
        yield alert_rows(key[0], fired, self.escalate_after)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.open.clear()
        self.rules.clear()
        yield alert_rows(key[0], [], self.escalate_after)

    def close(self) -> None:
        pass


def evaluations_of(parts: Iterable[pd.DataFrame]) -> list[tuple[float, str, bool]]:
    return sorted((t.timestamp(), rule, bool(hit)) for part in parts for t, rule, hit in zip(part["ts"], part["rule_id"], part["hit"], strict=True))


def alert_rows(loop, fired: list[tuple[float, str, int]], escalate_after: int) -> pd.DataFrame:
    return pd.DataFrame([(loop, rule, pd.Timestamp(at, unit="s"), n, n >= escalate_after) for at, rule, n in fired], columns=["loop_id", "rule_id", "ts", "repeats", "escalated"])


def alerts(evaluations: DataFrame, cool_down: float = 3600, debounce: float = 0, throttle: float = 5, escalate_after: int = 3, forget_days: int = 7, late: str = "10 minutes") -> DataFrame:
    """Evaluations (loop_id, rule_id, ts, hit) → alerts (loop_id, rule_id, ts, repeats, escalated).

    A stream keeps its state in RocksDB (the session's spark.sql.streaming.stateStore.providerClass names that provider),
    takes rows up to `late` behind the newest, and forgets a loop forget_days of event time after its last row. A table is
    folded a loop and group of evaluations at a time: it serves windows, whose evaluations of one loop fit a task."""
    if evaluations.isStreaming:
        state = AlertState(cool_down, debounce, throttle, escalate_after, forget_days * 86_400.0)
        return evaluations.withWatermark("ts", late).groupBy("loop_id").transformWithStateInPandas(statefulProcessor=state, outputStructType=ALERT, outputMode="Append", timeMode="EventTime")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return alert_rows(key[0], alert_steps(evaluations_of([part]), {"rules": {}}, cool_down, debounce, throttle), escalate_after)

    return evaluations.groupBy("loop_id").applyInPandas(run, ALERT)


def live_rows(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages (keys, role, ts, value, quality) of one flush each as wide rows: the time is the process value's, else any role's.

    Of several messages of a role the latest counts."""
    roles = ("PV", "SP", "OP", "MODE", "PID_P", "PID_I", "PID_D")
    latest = lambda role, x: F.max_by(x, F.when(F.col("role") == role, F.col("ts")))
    value = lambda role: F.expr("try_cast(value as double)") if role != "MODE" else F.expr("try_cast(try_cast(value as double) as int)")
    ts = F.coalesce(F.max(F.when(F.col("role") == "PV", F.col("ts"))), F.max("ts"))
    return messages.groupBy(*keys).agg(ts.alias("ts"), *(latest(r, value(r)).alias(r.lower()) for r in roles), latest("PV", F.expr("try_cast(quality as int)")).alias("pv_quality")).where("ts is not null")


def merge_late(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink in which the last write of a key wins, as late and repeated rows need."""

    def sink(batch: DataFrame, epoch: int) -> None:
        write(upsert(read(), batch, keys, version))

    return sink


def last_hour(df: DataFrame, now: Column, span: str = "1 hour", most: int = BUFFER_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows of the last hour, at most BUFFER_ROWS a loop, newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("loop_id").orderBy(F.desc("ts"), *map(F.desc, ties))
    recent = df.where(F.col("ts") > now - F.expr(f"interval {span}"))
    return recent.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def gaps(df: DataFrame, checkpoint: DataFrame, margin: float = 2.0, cap_hours: float = 24.0) -> DataFrame:
    """Spans to fetch again: from each loop's checkpoint (loop_id, ts) to its first row, if that lies later than the margin, capped."""
    first = df.groupBy("loop_id").agg(F.min("ts").alias("until"))
    joined = checkpoint.withColumnRenamed("ts", "since").join(first, "loop_id")
    apart = F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    since = F.greatest("since", F.col("until") - F.make_dt_interval(F.lit(0), F.lit(int(cap_hours))))
    return joined.where(apart > margin * 1e6).select("loop_id", since.alias("since"), "until")
