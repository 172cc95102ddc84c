"""Scalar rules on samples: missing values, quality codes, ranges, grades, weights, controller parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard modes in which a loop counts as automatic; alarm severities; confidence grades' limits.
AUTO_MODES = (1, 2, 3, 4)
REALTIME_AUTO_MODES = (1, 2, 3)
SEVERITIES = ("INFO", "WARN", "ERROR", "CRITICAL")
GRADE_LIMITS = (("A", 0.95), ("B", 0.80), ("C", 0.60), ("D", 0.20))
SCORE_LIMITS = (("EXCELLENT", 90), ("GOOD", 80), ("FAIR", 70), ("POOR", 60))

# Detector thresholds by control type.
THRESHOLDS = {
    "FC": {"interval": 1, "frozen_window": 5, "frozen": 0.001, "jump": 0.8, "spike": 0.5, "cutoff": 0.2, "segment": 30},
    "PC": {"interval": 2, "frozen_window": 5, "frozen": 0.001, "jump": 0.5, "spike": 0.3, "cutoff": 0.1, "segment": 20},
    "TC": {"interval": 5, "frozen_window": 6, "frozen": 0.0005, "jump": 0.3, "spike": 0.2, "cutoff": 0.05, "segment": 15},
    "LC": {"interval": 5, "frozen_window": 6, "frozen": 0.001, "jump": 0.3, "spike": 0.2, "cutoff": 0.05, "segment": 15},
    "CC": {"interval": 10, "frozen_window": 6, "frozen": 0.0005, "jump": 0.2, "spike": 0.1, "cutoff": 0.02, "segment": 10},
}
CONTROL_TYPES = {"FLOW": "FC", "PRESSURE": "PC", "TEMPERATURE": "TC", "LEVEL": "LC", "ANALYSIS": "CC"}
SCORE_TYPES = {"TEMPERATURE": "STABLE", "PRESSURE": "STABLE", "LEVEL": "SLOW", "ANALYSIS": "SLOW", "FLOW": "FAST", "SPEED": "FAST"}
#: accuracy, fast, steady by score type.
TYPE_WEIGHTS = {"STABLE": (0.2, 0.3, 0.5), "SLOW": (0.3, 0.1, 0.6), "FAST": (0.2, 0.5, 0.3), "LOGIC": (0.0, 0.5, 0.6)}
LEVEL_WEIGHTS = {1: 3.0, 2: 2.0, 3: 1.0}
DEFAULT_WEIGHTS = (0.2, 0.3, 0.5)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x: Column | str) -> Column:
    """Null, NaN and infinite values alike."""
    x = col(x).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def present(x: Column | str) -> Column:
    """The value, or null where it is missing."""
    return F.when(~missing(x), col(x).cast("double"))


def quality(code: Column | str) -> Column:
    """Null, 1, 2, 3 and 192 are Good, 0 is Bad, other codes Unknown."""
    code = col(code)
    return F.when(code.isNull() | code.isin(1, 2, 3, 192), "Good").when(code == 0, "Bad").otherwise("Unknown")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def normalise(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """Engineering range to 0..100; a range without span leaves the value, as does one that is not known."""
    if isinstance(low, Column) or isinstance(high, Column):
        return F.when((high - low) != 0, (col(x) - low) / (high - low) * 100).otherwise(col(x))
    return col(x) if high == low else (col(x) - low) / (high - low) * 100


def grade(share: Column | str) -> Column:
    """Confidence grade of a valid share."""
    out = F.lit("E")
    for name, limit in reversed(GRADE_LIMITS):
        out = F.when(col(share) >= limit, name).otherwise(out)
    return F.when(col(share).isNotNull(), out)


def score_grade(score: Column | str) -> Column:
    out = F.lit("BAD")
    for name, limit in reversed(SCORE_LIMITS):
        out = F.when(col(score) >= limit, name).otherwise(out)
    return F.when(col(score).isNull(), "INCONCLUSIVE").otherwise(out)


def rank_of(x: Column | str, order: tuple[str, ...]) -> Column:
    """Position of a name in an order; null for others."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(order):
        out = F.when(col(x) == name, i).otherwise(out)
    return out


def lookup(x: Column | str, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col(x) == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def control_type(loop_type: Column | str) -> Column:
    return lookup(F.upper(col(loop_type)), CONTROL_TYPES, "FC")


def score_type(loop_type: Column | str) -> Column:
    return lookup(F.upper(col(loop_type)), SCORE_TYPES, "LOGIC")


def to_standard_pid(p: Column, i: Column, d: Column, band: Column, minutes_i: Column, minutes_d: Column) -> Column:
    """Vendor form to gain and seconds; a band of zero has no gain."""
    return F.struct(F.when(band, F.when(p != 0, 100 / p)).otherwise(p).alias("kp"), F.when(minutes_i, i * 60).otherwise(i).alias("ti"), F.when(minutes_d, d * 60).otherwise(d).alias("td"))


def from_standard_pid(kp: Column, ti: Column, td: Column, band: Column, minutes_i: Column, minutes_d: Column) -> Column:
    return F.struct(F.when(band, F.when(kp != 0, 100 / kp)).otherwise(kp).alias("p"), F.when(minutes_i, ti / 60).otherwise(ti).alias("i"), F.when(minutes_d, td / 60).otherwise(td).alias("d"))


def infer_loop_type(tag: Column | str) -> Column:
    """Control type from the letters of a tag, such as 12FIC034."""
    letters = F.regexp_extract(F.upper(col(tag)), r"(FI?C|PI?C|TI?C|LI?C|AI?C|QI?C)", 1)
    return lookup(F.substring(letters, 1, 1), {"F": "FLOW", "P": "PRESSURE", "T": "TEMPERATURE", "L": "LEVEL", "A": "ANALYSIS", "Q": "ANALYSIS"}, "OTHER")


def stored_to_utc(ts: Column | str, zone: str = "Asia/Shanghai") -> Column:
    """Samples stored as wall clock of a zone, as UTC."""
    return F.to_utc_timestamp(col(ts), zone)
