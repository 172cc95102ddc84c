"""Kernels on signals whose answer is known."""

import numpy as np
import pytest

from plantwave.operators import identify, kernels, tuning


def test_spectrum_finds_a_sine():
    t = np.arange(0, 5, 0.1)
    found, frequency, amplitude, _ = kernels.spectrum_oscillation(10 * np.sin(2 * np.pi * t), 0.1)
    assert found and frequency == pytest.approx(1.0, rel=0.02) and amplitude == pytest.approx(10, rel=0.1)


def test_noise_share():
    t = np.arange(512)
    assert kernels.noise_share(np.sin(2 * np.pi * 0.4 * t), 1.0, 0.2) > 0.9
    assert kernels.noise_share(np.sin(2 * np.pi * 0.02 * t), 1.0, 0.2) < 0.1
    assert kernels.noise_share(t[:5].astype(float), 1.0, 0.2) is None


def test_uncertainty_shrinks_with_noise():
    rng = np.random.default_rng(6)
    u = np.repeat(rng.choice([0.0, 20.0], 60), 10)
    clean = identify.simulate({"a": np.array([-0.9]), "b": np.array([0.2]), "delay": 1}, u, np.zeros(len(u)))
    spread = [identify.uncertainty(y, u, identify.fit_arx(y, u, 1, 1, 1))["K"] for y in (clean + rng.normal(0, s, len(u)) for s in (0.01, 1.0))]
    assert spread[0] < spread[1] < 1


def test_resampling():
    t, x = np.array([0.0, 10.0]), np.array([0.0, 1.0])
    assert kernels.resample(t, x, np.array([-5.0, 5.0, 20.0])).tolist() == [0.0, 0.5, 1.0]
    assert kernels.resample(t, x, np.array([5.0, 10.0]), True).tolist() == [0.0, 1.0]


def test_first_order_model_is_recovered():
    rng = np.random.default_rng(3)
    u = np.repeat(rng.choice([0.0, 20.0], 60), 10)
    y = identify.simulate({"a": np.array([-np.exp(-1 / 15)]), "b": np.array([2 * (1 - np.exp(-1 / 15))]), "delay": 3}, u, np.zeros(len(u))) + rng.normal(0, 0.05, len(u))
    found = identify.from_history(y, u)
    assert found["K"] == pytest.approx(2, rel=0.15) and found["tau"] == pytest.approx(15, rel=0.25) and found["theta"] == pytest.approx(3, abs=2) and found["grade"] in "ABC"


@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_integrator_is_recovered(noise):
    rng = np.random.default_rng(9)
    u = np.repeat(rng.choice([-10.0, 10.0], 60), 10) + 50
    y = np.concatenate([np.zeros(5), np.cumsum(0.02 * (u - 50))])[: len(u)] + rng.normal(0, noise, len(u))
    found = identify.from_history(y, u, interval=2.0)
    assert found["structure"] == "IPDT" and found["K"] == pytest.approx(0.01, rel=0.1) and found["theta"] == pytest.approx(8, abs=4) and found["tau"] is None and found["grade"] in "ABC"


def test_missing_runs_are_cleaned():
    rng = np.random.default_rng(3)
    u = np.repeat(rng.choice([0.0, 20.0], 60), 10)
    y = identify.simulate({"a": np.array([-np.exp(-1 / 15)]), "b": np.array([2 * (1 - np.exp(-1 / 15))]), "delay": 3}, u, np.zeros(len(u))) + rng.normal(0, 0.05, len(u))
    y[100], y[300:303], y[:2], y[580:590] = np.nan, np.nan, np.nan, np.inf
    cleaned = identify.clean([y, u])
    assert len(cleaned[0]) == len(cleaned[1]) == 578 and np.isfinite(cleaned[0]).all() and cleaned[0][98] == pytest.approx((y[99] + y[101]) / 2)
    assert identify.from_history(y, u)["K"] == pytest.approx(2, rel=0.15)
    assert identify.from_history(np.full(200, np.nan), u[:200])["structure"] == "NONE"


def test_no_excitation_no_model():
    assert identify.from_history(np.random.default_rng(4).normal(size=200), np.ones(200))["structure"] == "NONE"


def test_step_tests():
    t = np.arange(0, 300, 0.5)
    y = 10 * (1 - np.exp(-np.maximum(t - 3, 0) / 15))
    gain, tau, theta = identify.step_fopdt(t, y, 10)
    assert gain == pytest.approx(1, rel=0.05) and tau == pytest.approx(15, rel=0.05) and theta == pytest.approx(3, rel=0.1)
    assert identify.step_sopdt(t, y, 10)[1] == pytest.approx(15, rel=0.1)
    slope, dead = identify.step_ipdt(t, 0.2 * np.maximum(t - 4, 0), 10)
    assert slope == pytest.approx(0.02, rel=0.02) and dead == pytest.approx(4, rel=0.1)


def test_closed_loop_settles():
    t, y = tuning.closed_loop(1.0, 15.0, 3.0, 0.857143, 15.0, 0.0, 200)
    m = tuning.response_metrics(t, y)
    assert y[-1] == pytest.approx(1, abs=0.02) and m["settling"] < 200


def test_quiet_signals():
    assert kernels.bicoherence(np.zeros(1000)) == 0.0
    assert kernels.sample_interval(86_400) == 24 and kernels.sample_interval(10) == 1


@pytest.mark.parametrize("x", [np.zeros(0), np.ones(1), np.ones(50), np.full(50, np.nan), np.array([np.inf] * 50), np.arange(50.0)])
def test_degenerate_signals_raise_nothing(x):
    kernels.spectrum_oscillation(x), kernels.noise_share(x, 1.0, 0.2)
    y = kernels.filled(x) if len(x) else x
    if len(y):
        kernels.gaussianity(y), kernels.bicoherence(y), kernels.stiction_fit(y, y)


def test_stiction_needs_a_limit_cycle():
    t, rng = np.arange(1200), np.random.default_rng(0)
    op = 50 + 10 * (2 / np.pi) * np.arcsin(np.sin(t / 20))
    assert kernels.stiction(op, 50 + rng.normal(size=1200)) == ("NO_LIMIT_CYCLE", 0.0)
    outcome, index = kernels.stiction(op, 50 + 8 * np.sin(t / 20))
    assert outcome == "CYCLE" and 0 <= index < 15
    wave = 50 + 8 * np.sign(np.sin(t / 20 + 0.3))
    assert kernels.stiction(op, wave)[0] == "CYCLE" and kernels.stiction(op, wave)[1] > index
    assert kernels.stiction(50 + rng.normal(size=1200), wave) == ("LOW_CORRELATION", None) and kernels.stiction(op[:10], wave[:10]) == ("INSUFFICIENT", None)


@pytest.mark.parametrize("tau, slow", [(15.0, False), (90.0, True)])
def test_slow_response_to_a_step(tau, slow):
    t = np.arange(1200.0)
    sp = np.where(t < 100, 20.0, 40.0)
    pv = np.where(t < 100, 20.0, 20 + 20 * (1 - np.exp(-(t - 100) / tau)))
    found, sure, got = kernels.slow_response(t, pv, sp, "PRESSURE")
    assert found == slow and got == pytest.approx(tau, rel=0.02) and (sure == pytest.approx(min(0.9, tau / 300), rel=0.05) if slow else sure == 0)
    assert kernels.slow_response(t, np.full(1200, 20.0), sp, "FLOW") == (False, 0.0, None) and kernels.slow_response(t, pv, np.full(1200, 5.0)) == (False, 0.0, None)


# Inputs and results of published baselines, as they stand.
def test_published_baselines():
    t = np.linspace(0, 5, 50, endpoint=False)
    found, frequency, amplitude, index = kernels.spectrum_oscillation(50 + 10 * np.sin(2 * np.pi * t), 0.1)
    assert found and frequency == pytest.approx(1.0) and amplitude == pytest.approx(9.998393921123451) and index == pytest.approx(0.6531189414408392)
    t = np.arange(600) * 0.5
    gain, tau, theta = identify.step_fopdt(t, np.where(t < 3, 0.0, 10 * (1 - np.exp(-(t - 3) / 15))), 10.0)
    assert gain == pytest.approx(1.0, abs=1e-6) and tau == pytest.approx(15.0072, abs=1e-4) and theta == pytest.approx(2.9879, abs=1e-4)


def test_open_loop_history_finds_the_process():
    rng = np.random.default_rng(123)
    u = np.repeat(rng.choice([40.0, 60.0], 100), 10)
    y = np.full(1000, 75.0)
    a = np.exp(-1 / 20)
    for i in range(4, 1000):
        y[i] = a * y[i - 1] + 1.5 * (1 - a) * u[i - 4]
    got = identify.from_history(y + rng.normal(0, 0.05, 1000), u)
    assert got["structure"] == "FOPDT" and 1.45 <= got["K"] <= 1.55 and 18 <= got["tau"] <= 22 and 2 <= got["theta"] <= 4


def test_frequency_response_and_feasibility():
    rng = np.random.default_rng(6)
    u = rng.normal(size=4000)
    y = np.zeros(4000)
    for i in range(1, 4000):
        y[i] = 0.8 * y[i - 1] + 0.4 * u[i - 1]
    got = identify.frequency_response(u, y)
    z = np.exp(2j * np.pi * got["frequency"])
    true = 0.4 / (z - 0.8)
    assert np.abs(got["gain"] - np.abs(true))[1:].max() < 0.25 and got["coherence"][1:].min() > 0.85 and got["phase"][3] < 0
    assert identify.coherence(u, y) > 0.9 and identify.coherence(u, rng.normal(size=4000)) < 0.2 and not len(identify.frequency_response(u[:10], y[:10])["gain"])
    assert [identify.feasibility(*x) for x in ((1.0, np.array([1.0])), (-1.0, np.array([-1.0])), (1.0, np.array([-0.5, 1.5])), (1.0, np.array([1.5, -0.5])))] == ["OK", "NEGATIVE_GAIN", "NMP_ZERO", "OK"]
