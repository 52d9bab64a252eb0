"""Cases of the third round's findings."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from markovine.functions import numerics
from markovine.functions.copulas import FAMILIES
from markovine.functions.ops import EPS
from markovine.operators import grouped, stats


def test_empirical_copula_counts_what_comparing_all_points_counts():
    rng = np.random.default_rng(1)
    u, v, w = np.round(rng.random(900), 2), rng.random(900), rng.random(900)
    a, b = rng.random(700), np.round(rng.random(700), 2)
    for weights in (None, w):
        one = np.ones(900) if weights is None else weights
        every = ((u[None] <= a[:, None]) & (v[None] <= b[:, None])) @ one / one.sum()
        assert np.allclose(stats.empirical_copula(u, v, a, b, weights), every, rtol=0, atol=1e-12)
    began = time.time()
    u, v = rng.random((2, 100_000))
    stats.cvm_statistic(u, v, lambda x, y: x * y)  # all pairs are 1e10 comparisons
    assert time.time() - began < 10


def test_gauss_inverse_is_that_of_bisection():
    f, rng = FAMILIES["Gauss"], np.random.default_rng(2)
    u, w, p = rng.random(200), rng.random(200), FAMILIES["Gauss"].params(-0.6)
    assert np.allclose(f.inv_h(w, u, p), numerics.invert(lambda v: f.h(v, u, p), w, EPS, 1 - EPS, 60), rtol=0, atol=1e-12)


def test_bootstrap_replicates_of_one_group_are_dealt_to_several_tasks(spark):
    rows = spark.range(40).select(F.lit(1).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    runs = grouped.gof_replicates(rows, "Gauss", B=20)
    assert runs.select(F.spark_partition_id()).distinct().count() > 3
    assert runs.count() == 20


def _zero_events(spark, tmp_path):
    """Two users of 20 events each; one value of the first is zero, outside of the planned gap."""
    rows = [(40 * g + k, 60.0 * k, g, 0.0 if (g, k) == (0, 12) else 5.0 + (7 * k + g) % 11) for g in range(2) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id long, t double, user_id long, value double")
    df.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def _same_as_sql(spark, sf, name, tolerance):
    duckdb = pytest.importorskip("duckdb")
    from markovine.plans import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    keys = [c for c in want.columns if c in ("series_id", "n", "step")]
    a, b = (d.sort_values(keys).to_numpy(float) for d in (got, want))
    assert a.shape == b.shape and np.allclose(a, b, rtol=0, atol=tolerance)


@pytest.mark.parametrize("name", ["metrics_error_split", "classify_with_mask_evidence", "forward_with_mask_evidence", "forecast_with_mask_evidence"])
def test_a_value_of_zero_is_as_in_sql(spark, tmp_path, name):
    _same_as_sql(spark, _zero_events(spark, tmp_path), name, 1e-9)


@pytest.mark.parametrize("tau", [0.4, 0.97])
def test_what_follows_a_value_far_out_is_exact(tau):
    from markovine.operators.engine import Chain
    from markovine.plans.registry import _MEAN, _SD, _autoregression

    rho = np.sin(np.pi * tau / 2)
    for y in (-4.6, 3.0, 6.3):
        chain = Chain(_autoregression(tau), np.array([y, np.nan, np.nan, np.nan]))
        for k, (_, mean, sd, _) in enumerate(chain.impute(), 1):
            assert mean == pytest.approx(_MEAN + rho**k * (y - _MEAN), abs=2e-6) and sd == pytest.approx(_SD * np.sqrt(1 - rho ** (2 * k)), abs=2e-6)
        assert chain.rows[1] is chain.rows[2]  # weights between them are worked out once


@pytest.mark.parametrize("tau", [0.4, 0.97])
def test_gaps_served_by_messages_are_those_of_whole_series(tau):
    from markovine.operators.engine import Batch, Chain
    from markovine.plans.registry import _autoregression, models

    rng = np.random.default_rng(4)
    for model in (_autoregression(tau), models()["pmc_pair"]):
        sizes = np.array([12, 9, 7])
        y = rng.normal(3.0, 1.0, 28)
        y[[0, 1, 5, 14, 15, 18, 20, 27]] = np.nan
        b = Batch(model, y, sizes)
        got = {first + r[0]: r[1:3] for first, chain in b.around_gaps() for r in chain.impute()}
        want = {int(a) + r[0]: r[1:3] for a, n in zip(b.starts, sizes) for r in Chain(model, y[a : a + n]).impute()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)
        assert min(chain.N for _, chain in b.around_gaps()) < 7


def test_small_groups_go_through_python_together(spark):
    rows = spark.range(3000).select((F.col("id") % 600).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    calls = spark.sparkContext.accumulator(0)

    class Counted:
        def __call__(self, pdf):
            calls.add(1)
            return {"m": len(pdf), "first": float(pdf["x"].iloc[0]), "least": float(pdf["x"].min())}

    plan = grouped.per_group(rows, Counted(), "m int, first double, least double")
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    got = plan.collect()
    assert len(got) == 600 and all(r["m"] == 5 and r["first"] == r["least"] for r in got) and calls.value == 600


def test_a_given_tau_is_that_of_the_sample():
    from markovine.operators import fit as fitting

    u, v = stats.pseudo_observations(*np.random.default_rng(6).random((2, 40)))
    for name in ("Gauss", "Frank"):
        assert fitting.fit(name, u, v, tau=stats.kendall_tau(u, v)) == fitting.fit(name, u, v)


def test_parameters_are_found_without_new_quadrature_nodes():
    f, began = FAMILIES["Frank"], time.time()
    thetas = [f.params(t)["theta"] for t in np.linspace(0.011, 0.61, 100)]
    assert time.time() - began < 5 and (np.diff(thetas) > 0).all()  # 38 seconds with nodes worked out for every step


def test_paths_of_a_batch_are_those_of_its_chains():
    from markovine.operators.engine import Batch, Chain
    from markovine.operators.series import rng_of
    from markovine.plans.registry import models

    sizes, rng = np.array([30, 1, 17, 30]), np.random.default_rng(7)
    y = rng.normal(3.0, 1.2, 78)
    y[[4, 30, 50]] = np.nan
    for name, model in models().items():
        if name == "pmc_in_pair":
            y = np.where(np.isnan(y), 3.0, y)
        b = Batch(model, y, sizes)
        x, z = b.sample([rng_of(3, k) for k in range(4)])
        for k, (a, n) in enumerate(zip(b.starts, sizes, strict=True)):
            xs, zs = Chain(model, y[a : a + n]).sample(rng_of(3, k))
            assert (x[a : a + n] == xs).all() and np.allclose(z[a : a + n], zs, rtol=0, atol=1e-12)


def test_sem_steps_through_series_together():
    from markovine.operators import estimate
    from markovine.plans.registry import models

    rng = np.random.default_rng(8)
    b = estimate.Batch(models()["hmc_in"], rng.normal(3.0, 1.0, 40_000), np.full(2000, 20))
    began = time.time()
    b.sample([estimate.rng_of(0, k) for k in range(2000)])
    assert time.time() - began < 3


def test_a_task_may_hold_no_pair_at_all(spark):
    from markovine.operators import series
    from markovine.plans.registry import models

    df = spark.createDataFrame([(1, 0, 0.5)], "series_id long, n long, y double")
    assert series.classify_pairs(df, models()["pmc_pair"]).collect() == []
