"""Log densities on a grid of tau, and the families written out for them."""

from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from markovine.functions import tau_grids
from markovine.functions.copulas import FAMILIES
from markovine.operators import estimate, selection
from markovine.operators.engine import Batch
from markovine.plans.registry import models


def _frank(u, v, a):
    eu, ev, e = (-a * u).exp(), (-a * v).exp(), (-a).exp()
    d = 1 - e - (1 - eu) * (1 - ev)
    return (a * (1 - e) * eu * ev / d**2).ln(), -(d / (1 - e)).ln() / a, eu * (1 - ev) / d


def _joe(u, v, a):
    x, y = ((1 - t).ln() * a for t in (u, v))
    q = x.exp() + y.exp() - (x + y).exp()
    density = q.ln() * (1 / a - 2) + (x + y) * (a - 1) / a + (a - 1 + q).ln()
    return density, 1 - (q.ln() / a).exp(), (q.ln() * (1 / a - 1) + x * (a - 1) / a).exp() * (1 - y.exp())


@pytest.mark.parametrize("name, exact", [("Frank", _frank), ("Joe", _joe)])
def test_strong_dependence_is_that_of_many_digits(name, exact):
    getcontext().prec = 400
    f = FAMILIES[name]
    for tau in (0.03, 0.5, 0.8, 0.9, 0.97, *((-0.5, -0.9, -0.97) if name == "Frank" else ())):
        p = f.params(tau)
        for u, v in ((0.5, 0.5), (0.03, 0.9), (0.976, 0.979), (0.99, 0.2), (1e-4, 2e-4), (1 - 2.0**-20, 1 - 2.0**-21)):
            density, cdf, h = (float(x) for x in exact(Decimal(u), Decimal(v), Decimal(p["theta"])))
            assert f.log_pdf(u, v, p) == pytest.approx(density, rel=1e-11, abs=1e-11)
            assert f.cdf(u, v, p) == pytest.approx(max(cdf, 2.3e-16), rel=1e-9, abs=1e-15)
            assert f.h(v, u, p) == pytest.approx(min(max(h, 2.3e-16), 1.0), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("name", list(tau_grids.FORMS))
def test_grid_sums_are_those_of_the_general_density(name, monkeypatch):
    monkeypatch.setattr(tau_grids, "ROWS", 100)  # several stretches
    rng, f = np.random.default_rng(3), FAMILIES[name]
    columns = {k: rng.random(350) for k in "ab"}
    pairs = {(0, 0): ("a", "a"), (0, 1): ("a", "b"), (1, 0): ("b", "a")}
    weights = {k: rng.random(349) for k in pairs}
    laws = [f.params(t) for t in estimate._grid(name, 15)]
    got = tau_grids.weighted_sums(columns, pairs, weights, {name: laws, "FGM": [FAMILIES["FGM"].params(0.1)]}, -50.0)
    for pair, (left, right) in pairs.items():
        u, v = columns[left][:-1], columns[right][1:]
        want = [float(weights[pair] @ np.maximum(f.log_pdf(u, v, p), -50.0)) for p in laws]
        assert np.allclose(got[pair, name], want, rtol=1e-9, atol=1e-9)
        assert got[pair, "FGM"] == pytest.approx(weights[pair] @ FAMILIES["FGM"].log_pdf(u, v, FAMILIES["FGM"].params(0.1)))


def test_grid_sums_at_the_edges_are_finite():
    ends = np.array([2.3e-16, 1e-15, 1e-9, 0.5, 1 - 1e-9, 1 - 2.3e-16])
    u, v = (z.ravel() for z in np.meshgrid(ends, ends))
    for name, form in tau_grids.FORMS.items():
        for t in estimate._grid(name, 15):
            p = FAMILIES[name].params(t)
            with np.errstate(all="ignore"):
                assert np.isfinite(form.log_pdf(form.at(form.column(u), p), form.at(form.column(v), p), p)).all()


def _rows(spark, seed=5):
    rng = np.random.default_rng(seed)
    y = [(s, n, None if (s, n) == (3, 7) else float(rng.normal(2.4 if (n // 9) % 2 else 3.9, 1.0))) for s in range(12) for n in range(40)]
    return spark.createDataFrame(y, "series_id long, n long, y double")


def test_likelihood_rises_with_every_step(spark):
    rows = _rows(spark)
    est = estimate.ice(rows, selection.kmeans_start(rows, models()["hmc_dn"]), max_iter=5)
    ll = [t["log_lik"] for t in est.trace]
    assert all(b > a - 1.0 for a, b in zip(ll, ll[1:]))
    assert ll[-1] < 0  # 480 values of spread 1


def test_one_pass_gives_likelihood_and_both_posteriors():
    rng = np.random.default_rng(4)
    y = rng.normal(3, 1, 90)
    y[[17, 18, 60]] = np.nan
    sizes = np.array([30, 30, 30])
    ll, g, xi = Batch(models()["hmc_dn"], y, sizes).posteriors()
    inner = np.ones(90, bool)
    inner[[29, 59, 89]] = False
    b = Batch(models()["hmc_dn"], y, sizes)
    assert np.allclose(ll, b.log_liks()) and np.allclose(g, b.gamma()) and np.allclose(xi[inner[:-1]], b.xi()[inner[:-1]])


def test_kmeans_rounds_are_lloyds(spark):
    y = np.array([r["y"] for r in _rows(spark).collect() if r["y"] is not None])
    groups = selection.kmeans(_rows(spark), 3, max_iter=7)
    from markovine.functions.ops import norm_ppf

    at = y.mean() + y.std() * norm_ppf((np.arange(3) + 0.5) / 3)
    for _ in range(7):
        near = np.abs(y[:, None] - at).argmin(axis=1)
        at = np.array([y[near == k].mean() for k in range(3)])
    want = [(at[k], y[near == k].std(), (near == k).mean()) for k in range(3)]
    assert np.allclose(groups, want)


def test_families_nearer_than_rounding_rank_as_in_sql(spark, tmp_path):
    """Likelihoods of two families at the least tau they have, 4e-11 apart."""
    duckdb = pytest.importorskip("duckdb")
    from markovine.plans import registry

    values = [13, 28, 38, 27, 21, 39, 29, 35, 2, 18, 14, 46, 6, 44, 56, 47, 36, 4, 31, 49, 30, 32, 42, 1, 41, 8, 16, 22, 43, 48, 10, 55, 50, 34, 37, 45, 58, 20, 17, 3, 9, 57, 25, 33, 24, 26, 23, 52, 15, 5, 53, 11, 54, 12, 40, 51, 19, 7]
    df = spark.createDataFrame([(k, 60.0 * k, float(v)) for k, v in enumerate(values)], "event_id long, t double, value double")
    df.select("event_id", F.timestamp_seconds("t").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["fit_best_closed"]).df().sort_values("place")
    got = registry.queries()["fit_best_closed"](spark, str(tmp_path)).toPandas().sort_values("place")
    assert got["family"].tolist() == want["family"].tolist() == ["FGM", "GH", "Clayton"]
    assert np.allclose(got["log_lik"], want["log_lik"], rtol=0, atol=1e-9)
