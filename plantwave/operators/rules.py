"""Alert rules: a JSON language compiled to columns, suppression over batches of hits, state machines."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import rank_of
from .rollup import GRADES
from .segments import seconds

# Limits of the language, and the moves that states allow.
MAX_TEXT, MAX_DEPTH = 4000, 3
WINDOW, CHECK, BREACHES = (300, 86_400), (5, 1440), (1, 10)
TRACKER_MOVES = {"PENDING": ("IN_PROGRESS", "IMPLEMENTED", "IGNORED"), "IN_PROGRESS": ("VERIFYING", "IMPLEMENTED", "IGNORED", "IN_PROGRESS"), "VERIFYING": ("CLOSED", "REOPENED", "VERIFYING", "IGNORED"), "REOPENED": ("IN_PROGRESS", "IMPLEMENTED", "IGNORED"), "IMPLEMENTED": ("CLOSED", "REOPENED", "VERIFYING", "IGNORED"), "CLOSED": (), "IGNORED": ()}
OPERATORS = {">", ">=", "<", "<=", "==", "!=", "IN", "NOT_IN"}
ORDER_MOVES = {"OPEN": ("ACKNOWLEDGED", "CANCELLED"), "ACKNOWLEDGED": ("IN_PROGRESS", "CANCELLED"), "IN_PROGRESS": ("VERIFYING", "CANCELLED"), "VERIFYING": ("CLOSED", "IN_PROGRESS"), "CLOSED": (), "CANCELLED": ()}


def validate(text: str) -> list[str]:
    """Errors by field; an empty list for a sound rule."""
    if len(text) > MAX_TEXT:
        return ["rule: too long"]
    try:
        rule = json.loads(text)
    except ValueError as e:
        return [f"rule: {e}"]
    if not isinstance(rule, dict):
        return ["rule: not an object"]
    errors = _validate(rule.get("condition"), "condition", 1)
    for field, (low, high) in (("windowSeconds", WINDOW), ("checkMinutes", CHECK), ("durationCount", BREACHES)):
        if field in rule and not (isinstance(rule[field], int) and low <= rule[field] <= high):
            errors.append(f"{field}: not within {low} and {high}")
    return errors


def _validate(node, path: str, depth: int) -> list[str]:
    if not isinstance(node, dict):
        return [f"{path}: not an object"]
    if depth > MAX_DEPTH:
        return [f"{path}: too deep"]
    kind = node.get("type")
    if kind == "threshold":
        return [f"{path}.{f}: wrong" for f, ok in (("field", isinstance(node.get("field"), str)), ("operator", node.get("operator") in OPERATORS), ("value", "value" in node and (isinstance(node["value"], list) == (node.get("operator") in ("IN", "NOT_IN"))))) if not ok]
    if kind == "confidence":
        return [] if node.get("worseThan") in GRADES else [f"{path}.worseThan: wrong"]
    if kind in ("AND", "OR", "NOT"):
        parts = node.get("conditions")
        if not isinstance(parts, list) or not parts:
            return [f"{path}.conditions: empty"]
        return [e for i, p in enumerate(parts) for e in _validate(p, f"{path}.conditions[{i}]", depth + 1)]
    return [f"{path}.type: unknown"]


def compile_rule(text: str) -> Column:
    """The rule's condition as a boolean column; null values fit nothing."""
    errors = validate(text)
    if errors:
        raise ValueError("; ".join(errors))
    return F.coalesce(_compile(json.loads(text)["condition"]), F.lit(False))


def _compile(node: dict) -> Column:
    kind = node["type"]
    if kind == "threshold":
        x, op, v = F.col(node["field"]), node["operator"], node["value"]
        return {">": lambda: x > v, ">=": lambda: x >= v, "<": lambda: x < v, "<=": lambda: x <= v, "==": lambda: x == v, "!=": lambda: x != v, "IN": lambda: x.isin(v), "NOT_IN": lambda: ~x.isin(v)}[op]()
    if kind == "confidence":
        return rank_of("confidence", GRADES) > GRADES.index(node["worseThan"])
    parts = [F.coalesce(_compile(p), F.lit(False)) for p in node["conditions"]]
    return ~parts[0] if kind == "NOT" else reduce(lambda a, b: a & b if kind == "AND" else a | b, parts)


def in_hours(ts: Column, start: int, end: int, zone: str = "Asia/Shanghai") -> Column:
    """Whether the plant's hour lies in [start, end)."""
    hour = F.hour(F.from_utc_timestamp(ts.cast("timestamp"), zone))
    return (hour >= start) & (hour < end)


def in_window(ts: Column, cron: str) -> Column:
    """Whether the plant's hour fits the hour field of a cron text: *, a-b as [a, b), a list, or one hour; short texts fit always."""
    parts = cron.split()
    if len(parts) < 2 or parts[1] == "*":
        return F.lit(True)
    if "-" in parts[1]:
        start, end = map(int, parts[1].split("-"))
        return in_hours(ts, start, end)
    return reduce(lambda a, b: a | b, (in_hours(ts, h, h + 1) for h in map(int, parts[1].split(","))))


def consecutive(df: DataFrame, hit: str, keys: list[str], by: list[str], count: int) -> DataFrame:
    """Adds breaches (length of the run of hits that ends here) and fired (the run reaches the count here)."""
    w = Window.partitionBy(*keys).orderBy(*by)
    misses = F.sum((~F.col(hit)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_miss", misses)
    run = F.sum(F.col(hit).cast("int")).over(Window.partitionBy(*keys, "_miss").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("breaches", run).withColumn("fired", F.col(hit) & (F.col("breaches") == count)).drop("_miss")


def gated(severity: Column, confidence: Column, policy: Column) -> Column:
    """Severity after the confidence gate: poor data suppress (null) or lower the alert."""
    from .reports import downgraded

    poor = confidence.isin("D", "E")
    return F.when(poor & (policy == "SUPPRESS"), None).when(poor & (policy == "DOWNGRADE"), downgraded(severity)).otherwise(severity)


def subscriptions(rules: DataFrame, loops: DataFrame) -> DataFrame:
    """(rule_id, loop_id) of rules (rule_id, scope ALL|LOOP|PLANT|CONTROL_TYPE, target): each scope is an equi-join of its own."""
    every = rules.where("scope = 'ALL'").select("rule_id", F.lit(1).alias("_one")).join(loops.select("loop_id", F.lit(1).alias("_one")), "_one").select("rule_id", "loop_id")
    by = lambda scope, column: rules.where(F.col("scope") == scope).join(loops, rules["target"] == loops[column].cast("string")).select("rule_id", "loop_id")
    return every.unionByName(by("LOOP", "loop_id")).unionByName(by("PLANT", "unit_id")).unionByName(by("CONTROL_TYPE", "loop_type")).distinct()


def allowed_moves(orders: DataFrame, state: str, to: str, moves: dict[str, tuple[str, ...]] = ORDER_MOVES) -> Column:
    """Whether an order may move from one state to the other."""
    pairs = [f"{a}>{b}" for a, bs in moves.items() for b in bs]
    return F.concat_ws(">", state, to).isin(pairs)


def tracker_error(state: str, to: str, moc: Column, pid: Column, reason: Column) -> Column:
    """Why a tracker may not move: no such move, no change record or controller settings to verify, no reason to reopen; else null."""
    wrong = ~allowed_moves(None, state, to, TRACKER_MOVES)
    verifying, reopened = F.col(to) == "VERIFYING", F.col(to) == "REOPENED"
    return F.when(wrong, "INVALID_TRANSITION").when(verifying & moc.isNull(), "MOC_REQUIRED").when(verifying & pid.isNull(), "PID_REQUIRED").when(reopened & reason.isNull(), "REASON_REQUIRED")


def stale(ts: Column, now: Column, interval: float) -> Column:
    """Values older than twice their interval, two hours at least, are no basis for an alert."""
    return seconds(now) - seconds(ts) > max(2 * interval, 7200)
