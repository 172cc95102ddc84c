"""Controller settings by rule, as columns; closed-loop simulation as a kernel; risk of a change."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _safe(k: Column, tau: Column, theta: Column) -> tuple[Column, Column, Column]:
    """Gain zero counts as 1, a time constant or dead time that is not above zero as 1 or 0.1."""
    return F.when(k == 0, 1.0).otherwise(k), F.when(tau > 0, tau).otherwise(1.0), F.when(theta > 0, theta).otherwise(0.1)


def _pid(kp: Column, ti: Column, td: Column | float) -> Column:
    td = F.lit(float(td)) if isinstance(td, (int, float)) else td
    return F.struct(F.round(kp, 6).alias("kp"), F.round(ti, 4).alias("ti"), F.round(td, 4).alias("td"))


def imc(k: Column, tau: Column, theta: Column, ratio: float = 1.0) -> Column:
    lam = F.when(theta > 0, ratio * theta).otherwise(0.1)
    k = F.when(k == 0, 1.0).otherwise(k)
    lead = tau + theta / 2
    return _pid(lead / (k * (lam + theta / 2)), lead, F.when(lead > 0, tau * theta / (2 * lead)).otherwise(0.0))


def lambda_rule(k: Column, tau: Column, theta: Column, ratio: float = 1.0) -> Column:
    k, tau, _ = _safe(k, tau, theta)
    return _pid(tau / (k * (ratio * tau + theta)), tau, 0)


def ziegler_nichols(k: Column, tau: Column, theta: Column) -> Column:
    k, tau, theta = _safe(k, tau, theta)
    return _pid(1.2 * tau / (k * theta), 2 * theta, 0.5 * theta)


def cohen_coon(k: Column, tau: Column, theta: Column) -> Column:
    k, tau, theta = _safe(k, tau, theta)
    r = theta / tau
    return _pid((1.35 + r / 3) / (k * r), theta * (32 + 6 * r) / (13 + 8 * r), 4 * theta / (11 + 2 * r))


def simc(k: Column, tau: Column, theta: Column, ratio: float = 1.0) -> Column:
    k, tau, theta = _safe(k, tau, theta)
    wide = theta * (1 + ratio)
    return _pid(tau / (k * wide), F.least(tau, 4 * wide), 0)


RULES = {"imc": imc, "lambda": lambda_rule, "zn": ziegler_nichols, "cohen_coon": cohen_coon, "simc": simc}


def risk(old: Column, new: Column, grade: Column, theta: Column, tau: Column, k: Column) -> Column:
    """HIGH, MEDIUM or LOW by change of gain, confidence, dead time and gain of the process."""
    change = F.try_divide(F.abs(new - old), F.abs(old))
    points = (
        F.when(change > 0.5, 3).when(change > 0.2, 2).otherwise(0)
        + F.when(grade.isin("D", "E", "INCONCLUSIVE"), 4).when(grade == "C", 1).otherwise(0)
        + F.when(F.try_divide(theta, tau) > 0.5, 2).otherwise(0)
        + F.when((F.abs(k) > 10) | (F.abs(k) < 0.1), 1).otherwise(0)
    )
    return F.when(points >= 4, "HIGH").when(points >= 2, "MEDIUM").otherwise("LOW")


def closed_loops(k: np.ndarray, tau: np.ndarray, theta: np.ndarray, kp: np.ndarray, ti: np.ndarray, td: np.ndarray, seconds: float, dt: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(time, outputs by time and loop) of a unit step of the set point of many loops: incremental controller, derivative on the measurement, output within 100, dead time as a delay.

    Loops of one dead time and one number of inner steps go through time together."""
    n = int(seconds / dt) + 1
    out = np.zeros((n, len(k)))
    waits, parts = np.round(theta / dt).astype(int), np.maximum(1, np.ceil(4 * dt / np.maximum(tau, 1e-6))).astype(int)
    for wait, part in np.unique(np.stack([waits, parts]), axis=1).T.tolist():
        at = np.flatnonzero((waits == wait) & (parts == part))
        out[:, at] = _step_response(*(x[at] for x in (k, tau, kp, ti, td)), wait, part, n, dt)
    return np.arange(n) * dt, out


def _step_response(k: np.ndarray, tau: np.ndarray, kp: np.ndarray, ti: np.ndarray, td: np.ndarray, wait: int, parts: int, n: int, dt: float) -> np.ndarray:
    out, zero, h = np.zeros((n, len(k))), np.zeros(len(k)), dt / parts
    pv, u, e1, y1, y2 = zero, zero, zero, zero, zero
    integral, queue = np.divide(dt, ti, out=np.zeros(len(k)), where=ti > 0), deque([zero] * wait)
    for i in range(n):
        out[i] = pv
        e = 1.0 - pv
        u = np.clip(u + kp * ((e - e1 if i else e) + integral * e - td / dt * (pv - 2 * y1 + y2)), -100.0, 100.0)
        e1, y2, y1 = e, y1, pv
        queue.append(u)
        drive = k * queue.popleft()
        for _ in range(parts):
            a = (drive - pv) / tau
            b = (drive - pv - h / 2 * a) / tau
            c = (drive - pv - h / 2 * b) / tau
            d = (drive - pv - h * c) / tau
            pv = pv + h / 6 * (a + 2 * b + 2 * c + d)
    return out


def closed_loop(k: float, tau: float, theta: float, kp: float, ti: float, td: float, seconds: float, dt: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """closed_loops() of one loop."""
    t, out = closed_loops(*(np.array([float(x)]) for x in (k, tau, theta, kp, ti, td)), seconds, dt)
    return t, out[:, 0]


def response_metrics(t: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """responses_metrics() of one loop."""
    return {name: float(x[0]) for name, x in responses_metrics(t, y[:, None]).items()}


def responses_metrics(t: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of each column: rise time from 10 to 90 %, overshoot in percent, settling within 2 %, time-weighted absolute error."""
    dt, last = float(t[1] - t[0]), len(t) - 1
    low, high, outside = y >= 0.1, y >= 0.9, np.abs(y - 1) > 0.02
    return {
        "rise": np.where(low.any(0) & high.any(0), t[high.argmax(0)] - t[low.argmax(0)], t[-1]),
        "overshoot": np.maximum(0.0, y.max(0) - 1) * 100,
        "settling": np.where(outside.any(0), t[last - outside[::-1].argmax(0)] + dt, 0.0),
        "itae": np.stack([(t * np.abs(1 - one)).sum() for one in y.T]) * dt if y.shape[1] else np.zeros(0),
    }
