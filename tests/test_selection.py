import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from markovine.functions.margins import Margin
from markovine.operators import estimate, inference, missing, selection, series, stats
from markovine.operators.engine import Chain
from markovine.operators.fit import BivariateLaw
from markovine.plans.model import gaussian


def test_assignment_by_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            c = rng.integers(0, 9, (n, n)).astype(float)
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = missing.assignment(c)
            assert sorted(got.tolist()) == list(range(n)) and c[np.arange(n), got].sum() == best


def test_error_split_of_three_states(spark):
    rows = [(1, 0, 2, False), (1, 1, 0, False), (1, 2, 1, True), (1, 2, 2, True), (2, 0, 0, False)]
    got = {r["series_id"]: r for r in missing.error_split(spark.createDataFrame(rows, "series_id long, t int, h int, m boolean"), "t", "h", "m", ["series_id"]).collect()}
    assert (got[1]["error"], got[1]["error_missing"], got[1]["error_observed"]) == (0.25, 0.5, 0.0)
    assert (got[2]["error"], got[2]["error_missing"]) == (0.0, None)
    assert stats.error_rate(np.array([0, 1, 2, 2]), np.array([2, 0, 1, 2])) == (0.25, [1, 2, 0])


def test_markov_masks_by_recursion(spark):
    df = spark.createDataFrame([(s, n, (n * s) % 3 % 2) for s in (1, 2, 3) for n in range(60)], "series_id long, n long, x int")
    a, b = [0.3, 0.6], [0.2, 0.7]
    u = missing.uniform("4", F.col("series_id"), F.col("n"))
    rows = missing.state_markov(df, a, b, seed=4).withColumn("u", u).orderBy("series_id", "n").collect()
    last = None
    for r in rows:
        i = r["x"]
        p = a[i] / (1 - b[i] + a[i]) if r["n"] == 0 else b[i] if last else a[i]
        last = r["u"] < p
        assert r["miss"] == last
    with pytest.raises(Exception, match="too short"):
        missing.aligned(df, 0.95, offset=10).collect()


def test_start_and_margins(spark):
    m = gaussian("HMC-IN", [-2, 2], [1, 0.5])
    df = series.simulate_series(spark, m, 4, 300, seed=2).select("series_id", "n", "y").cache()
    groups = selection.kmeans(df, 2)
    assert groups[0][0] == pytest.approx(-2, abs=0.3) and groups[1][0] == pytest.approx(2, abs=0.3) and sum(g[2] for g in groups) == pytest.approx(1)
    turned = selection.kmeans_start(df, gaussian("HMC-IN", [5, -5], [1, 1]))
    assert turned.margins[(0,)].loc > 1 and turned.margins[(1,)].loc < -1
    gamma = series.classify(df, m).select("series_id", "n", "gamma").join(df, ["series_id", "n"])
    for criterion in ("mle", "kolmogorov"):
        best = selection.select_margins(gamma, 2, ("norm", "uniform"), criterion)
        assert {k: v.dist for k, v in best.items()} == {0: "norm", 1: "norm"}
    d = {r["series_id"]: r["distance"] for r in selection.kolmogorov_distance(df, Margin("norm", {"loc": 0.0, "scale": 2.0})).collect()}
    y = np.array([r["y"] for r in df.where("series_id = 0").collect()])
    assert d[0] == pytest.approx(stats.ks_distance(Margin("norm", {"loc": 0.0, "scale": 2.0}).cdf(y)))


def test_standard_errors_of_a_known_state(spark):
    """States far apart: the means' errors are sd over root of the state's rows."""
    m = gaussian("HMC-IN", [-20, 20], [1, 2])
    df = series.simulate_series(spark, m, 6, 200, seed=1).select("series_id", "n", "y").cache()
    got = inference.chain_standard_errors(df, m, [("margin", (0,), "loc"), ("margin", (1,), "loc")])
    n = [df.where("y < 0").count(), df.where("y > 0").count()]
    assert got.se == pytest.approx([1 / n[0] ** 0.5, 2 / n[1] ** 0.5], rel=1e-3)
    assert got.robust.shape == (2,) and got.ci()[0][0] < -20 < got.ci()[0][1]
    every = inference.chain_standard_errors(df, gaussian("HMC-DN", [-20, 20], [1, 2], tau=0.3), None)
    assert len(every.names) == len(every.se) and np.isfinite(every.scores).all()


def test_bootstrap_and_transforms(spark):
    m = gaussian("HMC-IN", [0, 0], [1, 1])
    draws = inference.parametric_bootstrap(spark, m, lambda x, y: y.mean(), 100, 200)
    lo, hi = inference.bootstrap_interval(draws, 0.9)
    assert -0.25 < lo < -0.1 and 0.1 < hi < 0.25
    x, y = BivariateLaw(Margin("norm", {"loc": 0.0, "scale": 1.0}), Margin("norm", {"loc": 1.0, "scale": 2.0}), "Clayton", 0.5).sample(200, 3)
    df = spark.createDataFrame([(1, n, float(a), float(b)) for n, (a, b) in enumerate(zip(x, y, strict=True))], "g long, n long, x double, y double")
    good, bad = (inference.rosenblatt_bootstrap(df, f, B=39).first()["p_value"] for f in ("Clayton", "GH"))
    assert good > 0.05 >= bad
    matrix = selection.comparison_matrix(df, ("Clayton", "GH", "Frank"))
    assert {r["family"] for r in selection.confidence_set(matrix).collect()} == {"Clayton"}


def test_node_check_and_pairs(spark):
    m = gaussian("HMC-DN", [-1, 1], [1, 1], tau=0.5)
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (1, 2, 1.0), (2, 0, 0.1), (2, 1, 0.3)], "series_id long, n long, y double")
    got = series.node_check(df, m).collect()
    assert [r["series_id"] for r in got] == [1] and got[0]["fine"]
    pair = {r["series_id"]: r for r in series.classify_pairs(df, m).collect()}
    assert set(pair) == {2} and pair[2]["log_lik"] == pytest.approx(Chain(m, np.array([0.1, 0.3])).log_lik)
    sim = series.simulate_pairs(spark, m, 2, 5).collect()
    assert len(sim) == 20 and estimate.trace_rows(estimate.Estimate(m, [{"iter": 0, "log_lik": float("nan")}])) == [{"iter": 0, "log_lik": None}]
