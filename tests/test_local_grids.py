import numpy as np
import pytest

from markovine.functions.margins import Margin
from markovine.operators import series
from markovine.operators.engine import Chain, Kernels, simulate
from markovine.operators.local_grids import LocalGrids, runs
from markovine.plans.model import Copula, Model


def autoregression(tau):
    same = Margin("norm", {"loc": 1.0, "scale": 2.0})
    return Model("HMC-DN", np.array([[0.5, 0.1], [0.1, 0.3]]), {(0,): same, (1,): same}, {(i, j): Copula("Gauss", tau) for i in range(2) for j in range(2)})


def two_states(family, tau):
    margins = {(0,): Margin("norm", {"loc": 0.0, "scale": 1.0}), (1,): Margin("gamma", {"a": 2.0, "loc": 1.0, "scale": 1.0})}
    copulas = {(0, 0): Copula(family, tau), (1, 1): Copula(family, tau), (1, 0): Copula("Gauss", 0.3)}
    return Model("HMC-DN", np.array([[0.45, 0.05], [0.05, 0.45]]), margins, copulas)


def walk(tau, n, rng):
    rho = np.sin(np.pi * tau / 2)
    z = [rng.normal()]
    for _ in range(n - 1):
        z.append(rho * z[-1] + np.sqrt(1 - rho * rho) * rng.normal())
    return np.array(z), rho


GAPS = [(0, 2), (10, 11), (20, 33), (40, 41), (42, 43), (57, 60)]


def gapped(y):
    y = y.copy()
    for a, b in GAPS:
        y[a:b] = np.nan
    return y


@pytest.mark.parametrize("tau", [0.2, 0.7, 0.9, 0.97, 0.99])
def test_gaps_of_an_autoregression(tau):
    """Means, spreads and likelihoods against the closed bridge, however strong the dependence."""
    z, rho = walk(tau, 60, np.random.default_rng(1))
    y = gapped(1 + 2 * z)
    chain = Chain(autoregression(tau), y)
    seen = np.flatnonzero(np.isfinite(y))
    ll = 0.0
    for k, n in enumerate(seen):
        r = rho ** (n - seen[k - 1]) if k else 0.0
        d = z[n] - (r * z[seen[k - 1]] if k else 0.0)
        ll += -0.5 * d * d / (1 - r * r) - 0.5 * np.log(2 * np.pi * (1 - r * r)) - np.log(2)
    assert chain.log_lik == pytest.approx(ll, abs=2e-3)
    for n, mean, sd, _ in chain.impute():
        left, right = seen[seen < n], seen[seen > n]
        a = rho ** (n - left[-1]) if len(left) else 0.0
        b = rho ** (right[0] - n) if len(right) else 0.0
        za, zb = z[left[-1]] if len(left) else 0.0, z[right[0]] if len(right) else 0.0
        d = 1 - a * a * b * b
        assert mean == pytest.approx(1 + 2 * (a * (1 - b * b) * za + b * (1 - a * a) * zb) / d, abs=1e-3)
        assert sd == pytest.approx(2 * np.sqrt((1 - a * a) * (1 - b * b) / d), abs=1e-3)


@pytest.mark.parametrize("family,tau", [("Clayton", 0.8), ("Frank", 0.8)])
def test_twice_the_nodes_change_nothing(family, tau):
    m = two_states(family, tau)
    _, y = simulate(m, 60, np.random.default_rng(3))
    few, many = Chain(m, gapped(y)), Chain(m, gapped(y), 128)
    assert few.log_lik == pytest.approx(many.log_lik, abs=1e-2)
    for a, b in zip(few.impute(), many.impute(), strict=True):
        assert a[1] == pytest.approx(b[1], abs=1e-2) and a[2] == pytest.approx(b[2], abs=1e-2)


def test_nodes_integrate_the_margins():
    for m in (autoregression(0.99), two_states("Clayton", 0.8)):
        k = Kernels(m)
        for y, logw in LocalGrids(m, k, 64).gap(1.3, 1.9, 5):
            assert (np.diff(y) > 0).all()
            for i in range(2):
                law = m.margin(i, 0)
                assert float(np.exp(logw) @ law.pdf(y)) == pytest.approx(1.0, abs=5e-3)


def test_windows_follow_the_gap():
    """Nodes are dense near the two observations and few elsewhere."""
    m = autoregression(0.99)
    rows = LocalGrids(m, Kernels(m), 64).gap(3.0, 3.2, 4)
    for y, _ in rows:
        near = np.diff(y)[(y[:-1] > 2.9) & (y[:-1] < 3.3)]
        far = np.diff(y)[(y[:-1] < 0) & (y[:-1] > -2)]
        assert len(near) > 3 and near.max() < 0.05 and far.min() > 0.1 and len(y) < 200
    assert runs(np.array([1, 1, 0, 1, 0, 0, 1], bool)) == [(0, 2), (3, 1), (6, 1)] and runs(np.zeros(3, bool)) == []


def test_node_check_over_a_table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        z, _ = walk(0.9, 60, rng)
        rows += [(s, n, None if np.isnan(v) else float(v)) for n, v in enumerate(gapped(1 + 2 * z))]
    df = spark.createDataFrame(rows, "series_id long, n long, y double")
    got = series.node_check(df, autoregression(0.9)).collect()
    assert len(got) == 4 and all(r["fine"] for r in got)
