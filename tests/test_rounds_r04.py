"""Cases of the fourth round's findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markovine.functions.copulas import FAMILIES
from markovine.functions.ops import EPS
from markovine.operators import inference, missing
from markovine.operators.engine import Chain, simulate
from markovine.plans import registry
from markovine.plans.model import gaussian
from tests.test_rounds import _same_as_sql


def _events(spark, path, values):
    """Series of given values, a user each."""
    rows = [(1000 * g + k, 60.0 * k, g, float(v)) for g, y in values.items() for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "event_id long, t double, user_id long, value double")
    df.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def _with_zeros(spark, path):
    """Six series in which every fourth value is zero, so has no logarithm."""
    rng = np.random.default_rng(4)
    return _events(spark, path, {g: np.where(np.arange(40) % 4 == 1, 0.0, np.round(rng.exponential(49, 40) + 0.01, 2)) for g in range(6)})


def test_masks_of_rows_without_a_state(spark, tmp_path):
    sf = _with_zeros(spark, tmp_path)
    _same_as_sql(spark, sf, "pattern_state_dependent", 0)

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["patterns_random"]).df().sort_values(["series_id", "pattern"])
    got = registry.queries()["patterns_random"](spark, sf).toPandas()[list(want.columns)].sort_values(["series_id", "pattern"])
    assert got.values.tolist() == want.values.tolist()
    rows = spark.createDataFrame([(0, k, None if k else 1) for k in range(40)], "series_id long, n long, x int")
    assert missing.state_dependent(rows, [0.5, 1.0]).where("miss IS NULL").count() == 39


def test_nodes_of_a_gap_do_not_depend_on_the_other_gaps():
    """The first gap lies beside a value far out, the second does not: cut between them or not, the
    posteriors are the same."""
    m = gaussian("PMC", [-1, 1], [1, 1], tau=0.6, family="GH")
    _, y = simulate(m, 30, np.random.default_rng(5))
    y[3], y[4], y[14:17], y[17] = 3.9, np.nan, np.nan, 0.2
    whole = Chain(m, y)
    after = Chain(m, y[9:], before=whole.forward()[0][9][0])
    assert np.allclose(after.gamma(), whole.gamma()[9:], rtol=0, atol=1e-12)
    before = Chain(m, y[:10], after=whole.backward()[9][0])
    assert np.allclose(before.gamma(), whole.gamma()[:10], rtol=0, atol=1e-12)


def test_bootstrap_of_series_with_missing_values(spark, tmp_path):
    _same_as_sql(spark, _with_zeros(spark, tmp_path), "parametric_bootstrap", 1e-6)
    rows = spark.createDataFrame([(g, k, None if (g, k) in ((0, 3), (2, 0), (2, 1)) else float((7 * k + g) % 11)) for g, size in ((0, 30), (2, 3)) for k in range(size)], "series_id long, n long, y double")
    seen = lambda y: float(np.isfinite(y).sum()) if len(y) > 3 else float("nan")
    got = {r["series_id"]: r for r in inference.bootstrap_series(rows, gaussian("HMC-IN", [-1, 1], [1, 1]), seen, B=9).collect()}
    assert (got[0]["observed"], got[0]["p_value"]) == (29.0, 1.0)  # replicates have the same rows
    assert got[2]["observed"] is None and got[2]["p_value"] is None


def test_densities_where_the_joint_probability_is_below_the_least_that_enters():
    u, v = np.array([1e-4, 3e-15, 1e-9, 0.2]), np.array([3e-15, 1e-4, 1e-9, 0.7])
    f, p = FAMILIES["GH"], FAMILIES["GH"].params(0.25)
    a, x, y = p["theta"], -np.log(u), -np.log(v)
    w = (x**a + y**a) ** (1 / a)
    want = x + y - w + (a - 1) * np.log(x * y) + (1 - 2 * a) * np.log(w) + np.log(w + a - 1)
    assert np.exp(-w).min() < EPS and np.allclose(f.log_pdf(u, v, p), want, rtol=0, atol=1e-9)
    h = np.exp(-w + x) * (x / w) ** (a - 1)
    assert np.allclose(f.h(v, u, p), h, rtol=1e-9, atol=EPS)


@pytest.mark.parametrize("name", ["forward_pmc_pair", "forward_pmc_state", "pair_posteriors"])
def test_values_eight_deviations_out_are_as_in_sql(spark, tmp_path, name):
    """The value 0.07 between two small ones, as in series 309 of sf0.1."""
    y = np.array([20.0, 55, 31, 3.62, 0.07, 3.15, 44, 80, 12, 61])
    _same_as_sql(spark, _events(spark, tmp_path, {0: y, 1: y[::-1], 2: np.roll(y, 1)}), name, 1.1e-6 if name[0] == "f" else 1.1e-5)  # a unit of the last digit


@pytest.mark.parametrize("left, right, size", [(-6.0, 1.0, 13), (-6.0, 2.3, 9)])
def test_gaps_between_values_far_apart_are_bridged(left, right, size):
    """Ends of a gap which hardly any path joins: its probability is below what plain numbers hold."""
    at = np.arange(1, size + 1)
    m, r = registry._autoregression(registry._STRONG), float(np.sin(np.pi * registry._STRONG / 2))
    a, b, whole = r**at, r ** (size + 1 - at), r ** (size + 1)
    mean = (a * (1 - b**2) * left + b * (1 - a**2) * right) / (1 - whole**2)
    got = Chain(m, registry._MEAN + registry._SD * np.r_[left, [np.nan] * size, right]).impute()
    assert np.allclose([g[1] for g in got], registry._MEAN + registry._SD * mean, rtol=0, atol=1e-6)
    assert np.allclose([g[2] for g in got], registry._SD * np.sqrt((1 - a**2) * (1 - b**2) / (1 - whole**2)), rtol=0, atol=1e-6)
