"""Process models from samples: excitation, least squares, instrumental variables, order and delay search, step tests."""

from __future__ import annotations

import math

import numpy as np

#: Poles closer to one are no lag but an integrator or an offset.
LARGEST_POLE = 0.999


def regressors(y: np.ndarray, u: np.ndarray, na: int, nb: int, delay: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, target) of y(t) = -a1 y(t-1) ... + b1 u(t-delay-1) ..."""
    start = max(na, nb + delay)
    rows = [-y[start - i : len(y) - i] for i in range(1, na + 1)] + [u[start - delay - i : len(u) - delay - i] for i in range(1, nb + 1)]
    return np.stack(rows, 1), y[start:]


def fit_arx(y: np.ndarray, u: np.ndarray, na: int = 1, nb: int = 1, delay: int = 0) -> dict | None:
    """Least squares; None for too few samples."""
    if len(y) < 4 * (na + nb + delay + 1):
        return None
    phi, target = regressors(y, u, na, nb, delay)
    theta = np.linalg.lstsq(phi, target, rcond=None)[0]
    return _model(theta, phi, target, na, delay)


def _model(theta: np.ndarray, phi: np.ndarray, target: np.ndarray, na: int, delay: int) -> dict:
    e = target - phi @ theta
    s = max(float(e @ e) / len(e), 1e-300)
    spread = float(((target - target.mean()) ** 2).sum())
    n, k = len(e), len(theta) + 1
    return {"a": theta[:na], "b": theta[na:], "delay": delay, "residual": e, "r2": 1 - float(e @ e) / spread if spread > 0 else 0.0, "aic": n * math.log(s) + 2 * k, "bic": n * math.log(s) + k * math.log(n)}


def fit_armax(y: np.ndarray, u: np.ndarray, na: int = 1, nb: int = 1, nc: int = 1, delay: int = 0, rounds: int = 10) -> dict | None:
    """Extended least squares: residuals of the last round are regressors of the next."""
    first = fit_arx(y, u, na, nb, delay)
    if first is None:
        return None
    start = max(na, nb + delay)
    e = np.concatenate([np.zeros(start), first["residual"]])
    phi, target = regressors(y, u, na, nb, delay)
    full = np.concatenate([phi, np.zeros((len(phi), nc))], 1)
    theta = None
    for _ in range(rounds):
        for i in range(1, nc + 1):
            full[:, na + nb + i - 1] = e[start - i : len(y) - i]
        theta = np.linalg.lstsq(full, target, rcond=None)[0]
        e[start:] = target - full @ theta
    return first if theta is None else _model(theta[: na + nb], phi, target, na, delay) | {"c": theta[na + nb :], "residual": e[start:]}


def simulate(model: dict, u: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """Free run of the model from its first outputs."""
    a, b, d = model["a"], model["b"], model["delay"]
    start = max(len(a), len(b) + d)
    y = np.zeros(len(u))
    y[:start] = y0[:start]
    for t in range(start, len(u)):
        y[t] = -sum(a[i] * y[t - 1 - i] for i in range(len(a))) + sum(b[i] * u[t - d - 1 - i] for i in range(len(b)))
    return y


def fit_iv(y: np.ndarray, u: np.ndarray, r: np.ndarray, na: int = 1, nb: int = 1, delay: int = 0, rounds: int = 2) -> dict | None:
    """Instrumental variables for closed loops: the model driven by the set point stands in for the noisy outputs."""
    model = fit_arx(y, u, na, nb, delay)
    for _ in range(rounds if model else 0):
        phi, target = regressors(y, u, na, nb, delay)
        z, _ = regressors(simulate(model, r, y), r, na, nb, delay)
        if not np.isfinite(z).all() or np.linalg.matrix_rank(z.T @ phi) < phi.shape[1]:
            break
        model = _model(np.linalg.solve(z.T @ phi, z.T @ target), phi, target, na, delay)
    return model


def search_delay(y: np.ndarray, u: np.ndarray, na: int, most: int) -> dict | None:
    """The delay of least BIC, the smaller of equals."""
    found = [m for d in range(most + 1) if (m := fit_arx(y, u, na, 1 if na == 1 else 2, d))]
    return min(found, key=lambda m: (m["bic"], m["delay"])) if found else None


def whiteness(e: np.ndarray, lags: int = 10) -> float:
    """Ljung-Box statistic over its 5 % limit for this many lags: white below 1."""
    e = e - e.mean()
    c0 = float(e @ e)
    if c0 == 0 or len(e) <= lags + 1:
        return 0.0
    q = len(e) * (len(e) + 2) * sum((float(e[k:] @ e[:-k]) / c0) ** 2 / (len(e) - k) for k in range(1, lags + 1))
    return q / (lags * (1 - 2 / (9 * lags) + 1.645 * math.sqrt(2 / (9 * lags))) ** 3)  # Wilson-Hilferty quantile


def to_fopdt(model: dict, interval: float) -> tuple[float, float, float] | None:
    """(gain, time constant, dead time) of a first-order model; None if its pole is not within (0, LARGEST_POLE)."""
    pole, b = -float(model["a"][0]), float(model["b"][0])
    return (b / (1 - pole), -interval / math.log(pole), model["delay"] * interval) if 0 < pole < LARGEST_POLE else None


def to_sopdt(model: dict, interval: float) -> tuple[float, float, float, float] | None:
    """(gain, slow and fast time constant, dead time) of a second-order model with real poles within (0, LARGEST_POLE)."""
    poles = np.roots([1, *model["a"]])
    if np.iscomplex(poles).any() or not ((poles.real > 0) & (poles.real < LARGEST_POLE)).all():
        return None
    slow, fast = sorted((-interval / np.log(poles.real)).tolist(), reverse=True)
    return float(sum(model["b"]) / (1 + sum(model["a"]))), slow, fast, model["delay"] * interval


def fit_ipdt(y: np.ndarray, u: np.ndarray, delay: int) -> dict | None:
    """Least squares of y(t) - y(t-1) = b u(t-delay-1) + c; c carries the output at which an integrator stands still, and drift."""
    if len(y) < 4 * (delay + 3):
        return None
    moved, driven = np.diff(y)[delay:], u[: len(y) - 1 - delay]
    phi = np.stack([driven, np.ones(len(driven))], 1)
    return _model(np.linalg.lstsq(phi, moved, rcond=None)[0], phi, moved, 0, delay)


def simulate_ipdt(model: dict, u: np.ndarray, first: float) -> np.ndarray:
    """Free run of an integrating model; outputs from before the first sample count as that sample's."""
    at = np.maximum(np.arange(len(u) - 1) - model["delay"], 0)
    return first + np.concatenate([[0.0], np.cumsum(model["b"][0] * u[at] + model["b"][1])])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(int)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def clean(signals: list[np.ndarray], most: int = 5) -> list[np.ndarray]:
    """Signals of one length without missing samples: runs shorter than `most` between sound samples are lines, at longer ones and at the ends the signals are cut; the longest part stays."""
    bad = np.any([~np.isfinite(x) for x in signals], axis=0)
    if not bad.any():
        return signals
    long_, at = np.zeros(len(bad), bool), np.arange(len(bad))
    for a, b in runs(bad):
        long_[a:b] = b - a >= most or a == 0 or b == len(bad)
    a, b = max(runs(~long_), key=lambda r: r[1] - r[0], default=(0, 0))
    if a == b:
        return [x[:0] for x in signals]
    return [np.interp(at[a:b], at[~bad], x[~bad]) for x in signals]


def excitation(u: np.ndarray, span: float = 100.0) -> tuple[bool, float]:
    """(sufficient, score 0..100): range, changes of direction and conditioning of the input."""
    moves = np.diff(u)
    moves = moves[moves != 0]
    turns = int((np.diff(np.sign(moves)) != 0).sum()) if len(moves) > 1 else 0
    width = float(np.ptp(u)) / span if len(u) else 0.0
    if width < 0.01 or turns < 1 or len(u) < 20:
        return False, 0.0
    lagged = np.stack([u[2:], u[1:-1], u[:-2]], 1)
    condition = float(np.linalg.cond(lagged - lagged.mean(0)))
    return condition <= 1e6, min(40.0, width * 400) + min(30.0, turns * 3.0) + (30.0 if condition <= 1e4 else 10.0 if condition <= 1e6 else 0.0)


def frequency_response(u: np.ndarray, y: np.ndarray, interval: float = 1.0, segment: int = 256) -> dict[str, np.ndarray]:
    """{frequency, gain, phase in degrees, coherence} of y against u from half-overlapping tapered segments."""
    segment = min(segment, len(u))
    starts = range(0, len(u) - segment + 1, max(segment // 2, 1))
    if segment < 16 or len(starts) < 2:
        return {k: np.zeros(0) for k in ("frequency", "gain", "phase", "coherence")}
    taper = np.hanning(segment)
    a, b = (np.array([np.fft.rfft((x[s : s + segment] - x[s : s + segment].mean()) * taper) for s in starts]) for x in (u, y))
    cross, own, other = (np.conj(a) * b).mean(0), (np.abs(a) ** 2).mean(0), (np.abs(b) ** 2).mean(0)
    response = cross / np.maximum(own, 1e-12)
    return {"frequency": np.fft.rfftfreq(segment, interval), "gain": np.abs(response), "phase": np.angle(response, deg=True), "coherence": np.abs(cross) ** 2 / np.maximum(own * other, 1e-30)}


def coherence(u: np.ndarray, y: np.ndarray, segment: int = 64) -> float:
    """Mean coherence of half-overlapping tapered segments."""
    if len(u) < segment:
        return 0.0
    found = frequency_response(u, y, segment=segment)["coherence"][1:]
    return float(found.mean()) if len(found) else 0.0


def feasibility(gain: float, b: np.ndarray) -> str:
    """OK, NEGATIVE_GAIN, or NMP_ZERO: a zero of the input's polynomial outside the unit circle answers the wrong way first."""
    if gain < 0:
        return "NEGATIVE_GAIN"
    zeros = np.roots(b) if len(b) > 1 and np.any(b) else np.zeros(0)
    return "NMP_ZERO" if (np.abs(zeros) > 1 + 1e-9).any() else "OK"


def from_history(y: np.ndarray, u: np.ndarray, interval: float = 1.0, r: np.ndarray | None = None, dead_time: float | None = None) -> dict:
    """The best model of a segment: {structure, K, tau, theta, r2, feasible, grade}; what can't be a process gets a C at best.

    Missing samples are cleaned first. The data are split in time order; delays are searched by BIC on the first part,
    candidates are judged by their free run on the next, and second order must beat first order by 5 % of fit and by
    BIC. An integrator (K is its slope by unit of input, tau None) leads where it explains the next part better than any lag."""
    y, u, *rest = clean([y, u] if r is None else [y, u, r])
    r = rest[0] if rest else None
    nothing = {"structure": "NONE", "K": None, "tau": None, "theta": None, "r2": None, "feasible": None, "grade": "E"}
    enough, score = excitation(u)
    if not enough or len(y) < 60:
        return nothing
    y, u = y - y.mean(), u - u.mean()
    cut = int(len(y) * 0.6) if len(y) >= 100 else int(len(y) * 0.7)
    end = int(len(y) * 0.8) if len(y) >= 100 else len(y)
    most = int(dead_time / interval) + 3 if dead_time is not None else min(cut // 4, 60)
    found = []
    for name, na in (("FOPDT", 1), ("SOPDT", 2)):
        base = search_delay(y[:cut], u[:cut], na, most)
        if base is None:
            continue
        nb, d = (1 if na == 1 else 2), base["delay"]
        options = [base, fit_armax(y[:cut], u[:cut], na, nb, 1, d)] + ([fit_iv(y[:cut], u[:cut], r[:cut] - r[:cut].mean(), na, nb, d)] if r is not None and np.ptp(r) > 0 else [])
        for m in filter(None, options):
            params = to_fopdt(m, interval) if na == 1 else to_sopdt(m, interval)
            if params is None:
                continue
            run = simulate(m, u[cut:end], y[cut:end])
            spread = float(((y[cut:end] - y[cut:end].mean()) ** 2).sum())
            fit = 1 - float(((run - y[cut:end]) ** 2).sum()) / spread if spread > 0 and np.isfinite(run).all() else -1.0
            found.append({"structure": name, "K": params[0], "tau": params[1], "theta": params[-1], "r2": fit, "bic": m["bic"], "feasible": feasibility(params[0], m["b"]), "white": m["r2"] >= 0.999 or whiteness(m["residual"]) < 1})
    tried = [m for d in range(most + 1) if (m := fit_ipdt(y[:cut], u[:cut], d))]
    if tried:
        m = min(tried, key=lambda m: (m["bic"], m["delay"]))
        spread = float(((y[cut:end] - y[cut:end].mean()) ** 2).sum())
        before = min(m["delay"], cut)
        run = simulate_ipdt(m, u[cut - before : end], 0.0)[before:]
        fit = 1 - float(((run - run[0] + y[cut] - y[cut:end]) ** 2).sum()) / spread if spread > 0 else -1.0
        if m["b"][0] and fit > 0:
            found.append({"structure": "IPDT", "K": float(m["b"][0]) / interval, "tau": None, "theta": m["delay"] * interval, "r2": fit, "bic": m["bic"], "feasible": feasibility(float(m["b"][0]), m["b"]), "white": m["r2"] >= 0.999 or whiteness(m["residual"]) < 1})
    if not found:
        return nothing
    best = {n: max((f for f in found if f["structure"] == n), key=lambda f: f["r2"], default=None) for n in ("FOPDT", "SOPDT", "IPDT")}
    one, two, integrator = best["FOPDT"], best["SOPDT"], best["IPDT"]
    pick = two if one is None or (two is not None and two["r2"] > one["r2"] * 1.05 and two["bic"] < one["bic"]) else one
    pick = integrator if integrator is not None and (pick is None or integrator["r2"] > pick["r2"]) else pick
    limits = [("A", 0.90, pick["white"] and score >= 60), ("B", 0.80, pick["white"]), ("C", 0.70, True), ("D", 0.50, True)]
    grade = next((g for g, least, ok in limits if pick["r2"] >= least and ok), "E")
    if grade in "AB" and (coherence(u, y) < 0.3 or pick["feasible"] != "OK"):
        grade = "C"
    return {k: pick[k] for k in ("structure", "K", "tau", "theta", "r2", "feasible")} | {"grade": grade}


def uncertainty(y: np.ndarray, u: np.ndarray, model: dict, interval: float = 1.0, rounds: int = 50, seed: int = 0) -> dict[str, float]:
    """Relative deviations of gain and time constant under resampled residuals: y is rebuilt and fitted again each round."""
    rng, na, nb, d = np.random.default_rng(seed), len(model["a"]), len(model["b"]), model["delay"]
    found = []
    for _ in range(rounds):
        again = simulate(model, u, y) + rng.choice(model["residual"], len(y))
        fitted = fit_arx(again, u, na, nb, d)
        params = fitted and (to_fopdt(fitted, interval) if na == 1 else to_sopdt(fitted, interval))
        if params:
            found.append(params[:2])
    if len(found) < 2:
        return {"K": math.inf, "tau": math.inf}
    mean, spread = np.mean(found, 0), np.std(found, 0)
    return {"K": float(spread[0] / abs(mean[0])), "tau": float(spread[1] / abs(mean[1]))}


def step_fopdt(t: np.ndarray, y: np.ndarray, move: float) -> tuple[float, float, float] | None:
    """(gain, time constant, dead time) of a step test by the times of 28.3 % and 63.2 % of the change."""
    tail = y[-max(1, len(y) // 10) :].mean()
    change = tail - y[0]
    if abs(change) < 1e-12 or move == 0:
        return None
    share = (y - y[0]) / change
    at = [float(np.interp(level, np.maximum.accumulate(share), t)) - float(t[0]) for level in (0.283, 0.632)]
    tau = 1.5 * (at[1] - at[0])
    return change / move, tau, max(0.0, at[1] - tau)


def step_sopdt(t: np.ndarray, y: np.ndarray, move: float) -> tuple[float, float, float, float] | None:
    """(gain, two time constants, dead time): a grid over the split of the lag, judged by squared error."""
    first = step_fopdt(t, y, move)
    if first is None:
        return None
    gain, tau, theta = first
    best = None
    for share in np.linspace(0.0, 1.0, 21):
        t1, t2 = tau * (1 - share / 2), tau * share / 2 + 1e-9
        s = np.maximum(t - t[0] - theta, 0)
        model = y[0] + gain * move * (1 - (t1 * np.exp(-s / t1) - t2 * np.exp(-s / t2)) / (t1 - t2 if abs(t1 - t2) > 1e-9 else 1e-9))
        error = float(((model - y) ** 2).sum())
        if best is None or error < best[0]:
            best = (error, t1, t2)
    return gain, best[1], best[2], theta


def step_ipdt(t: np.ndarray, y: np.ndarray, move: float) -> tuple[float, float] | None:
    """(slope by unit of input, dead time) of an integrating process, from the line through the later half."""
    half = len(t) // 2
    if move == 0 or half < 2:
        return None
    slope, cut = np.polyfit(t[half:] - t[0], y[half:], 1)
    return (float(slope / move), max(0.0, float((y[0] - cut) / slope))) if slope else None
