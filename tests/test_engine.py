import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from markovine.functions.margins import Margin
from markovine.operators import catalyst, estimate, image, missing, series, stats
from markovine.operators.engine import Chain, Kernels, bh_threshold, flag_outliers, simulate
from markovine.plans.model import Copula, Missingness, Model, ModelError, VectorMargin, gaussian
from markovine.streaming.online import filter_step

P = np.array([[0.5, 0.05], [0.05, 0.4]])
N = lambda m, s: Margin("norm", {"loc": m, "scale": s})
PAIR = {(0, 0): N(0, 1), (0, 1): N(0.3, 1.6), (1, 0): N(1.1, 1.4), (1, 1): N(1.5, 1)}
CLAYTON = {(i, j): Copula("Clayton", 0.7) for i in range(2) for j in range(2)}
MODELS = {
    "hmc_in": gaussian("HMC-IN", [-1, 1], [1, 1]),
    "hmc_dn": gaussian("HMC-DN", [-1, 1], [1, 1], tau=0.6),
    "pmc_state": gaussian("PMC", [-1, 1], [1, 1], tau=0.6, family="GH"),
    "pmc_in_pair": Model("PMC-IN", P, PAIR),
    "pmc_pair": Model("PMC", P, PAIR, CLAYTON),
}


def enumerate_paths(m, y):
    k = Kernels(m)
    f, c = np.exp(k.logf(y)), k.cdf(y)
    total, g = 0.0, np.zeros((len(y), m.K))
    for path in itertools.product(range(m.K), repeat=len(y)):
        v = np.exp(k.initial(np.log(f[:1])))[0, path[0]]
        for n, (i, j) in enumerate(zip(path, path[1:], strict=False)):
            v *= m.p[i, j] * f[n, i, j] * f[n + 1, j, i] / (m.p[i] @ f[n, i])
            if m.uses_copula:
                q = m.copula(i, j)
                v *= math.exp(q.family.log_pdf(c[n, i, j], c[n + 1, j, i], q.params))
        total += v
        g[np.arange(len(y)), path] += v
    return math.log(total), g / total


@pytest.mark.parametrize("name", MODELS)
def test_against_enumeration(name):
    m = MODELS[name]
    _, y = simulate(m, 5, np.random.default_rng(3))
    ll, g = enumerate_paths(m, y)
    chain = Chain(m, y)
    xi = chain.xi()
    assert chain.log_lik == pytest.approx(ll, abs=1e-10)
    assert np.allclose(chain.gamma(), g, atol=1e-10)
    assert np.allclose(xi.sum(2), chain.gamma()[:-1]) and np.allclose(xi.sum(1), chain.gamma()[1:])


@pytest.mark.parametrize("name", MODELS)
def test_a_gap_is_the_integral_over_its_value(name):
    m = MODELS[name]
    _, y = simulate(m, 5, np.random.default_rng(4))
    z = np.linspace(-9, 9, 1501)
    like = []
    for v in z:
        w = y.copy()
        w[2] = v
        like.append(math.exp(Chain(m, w).log_lik))
    y[2] = np.nan
    chain = Chain(m, y)
    assert chain.log_lik == pytest.approx(math.log(np.trapezoid(like, z)), abs=1e-6)
    assert chain.impute()[0][1] == pytest.approx(np.trapezoid(np.array(like) * z, z) / np.trapezoid(like, z), abs=1e-5)
    assert Chain(m, np.append(y, [np.nan] * 2)).log_lik == pytest.approx(chain.log_lik, abs=1e-10)


@pytest.mark.parametrize("name", ["hmc_in", "pmc_pair"])
def test_catalyst_filter_and_blocks_agree_with_the_engine(spark, name):
    m, rows, want = MODELS[name], [], {}
    for s in range(4):
        _, y = simulate(m, 1 + 13 * s, np.random.default_rng(s))
        want[s] = Chain(m, y)
        rows += [(s, n, float(v)) for n, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id long, n long, y double")
    got = {r["series_id"]: r["log_lik"] for r in catalyst.forward(df, m).collect()}
    assert all(got[s] == pytest.approx(c.log_lik, abs=1e-7) for s, c in want.items())
    blocks = series.classify_blocks(df, m, 8).toPandas()
    for s, c in want.items():
        g = np.array(blocks[blocks.series_id == s].sort_values("n")["gamma"].tolist())
        assert np.allclose(g, c.gamma(), atol=1e-9)


@pytest.mark.parametrize("name", MODELS)
def test_gaps_in_batches_blocks_and_the_catalyst_filter(spark, name):
    """Leading, inner and trailing gaps; series in one batch are those of one chain each."""
    m, rows, want = MODELS[name], [], {}
    for s in range(5):
        _, y = simulate(m, 3 + 9 * s, np.random.default_rng(s))
        if s:
            y[[0, 1, 7, 8, 9, -1]] = np.nan if s < 4 else np.inf
        want[s] = Chain(m, y)
        rows += [(s, n, None if s == 3 and np.isnan(v) else float(v)) for n, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id long, n long, y double").repartition(3)
    got = {r["series_id"]: r for r in catalyst.forward(df, m).collect()}
    for s, c in want.items():
        assert got[s]["log_lik"] == pytest.approx(c.log_lik, abs=1e-7) and np.allclose(got[s]["last"], c.filtered()[-1], atol=1e-8)
    lik = {r["series_id"]: r["log_lik"] for r in series.log_likelihood(df, m).collect()}
    assert all(lik[s] == pytest.approx(c.log_lik, abs=1e-9) for s, c in want.items())
    for out in (series.classify(df, m), series.classify_blocks(df, m, 4), series.classify_blocks(df, m, 1000)):
        out = out.toPandas()
        assert len(out) == len(rows)
        for s, c in want.items():
            assert np.allclose(np.array(out[out.series_id == s].sort_values("n")["gamma"].tolist()), c.gamma(), atol=1e-8)
    xi, pit, imp = (f(df, m).toPandas() for f in (series.pair_posteriors, series.predictive_pit, series.impute))
    for s, c in want.items():
        assert np.allclose(np.array(xi[xi.series_id == s].sort_values("n")["xi"].tolist()).reshape(-1, 2, 2), c.xi(), atol=1e-8)
        assert np.allclose(pit[pit.series_id == s].sort_values("n")["pit"], c.pit(), atol=1e-8, equal_nan=True)
        own = imp[imp.series_id == s].sort_values("n")
        assert own["n"].tolist() == [r[0] for r in c.impute()] and np.allclose(own["mean"], [r[1] for r in c.impute()], atol=1e-7)
        assert not len(own) or np.allclose(own["quantiles"].tolist(), [r[3] for r in c.impute()], atol=1e-6)


def test_blocks_with_a_mask_model(spark):
    m = MODELS["hmc_dn"].with_missingness(Missingness("state_markov", onset=(0.05, 0.2), persistence=(0.6, 0.8)))
    _, y = simulate(m, 60, np.random.default_rng(2))
    y[[5, 6, 7, 20, 40, 41, 59]] = np.nan
    df = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(y)], "series_id long, n long, y double")
    g = np.array(series.classify_blocks(df, m, 8).toPandas().sort_values("n")["gamma"].tolist())
    assert np.allclose(g, Chain(m, y).gamma(), atol=1e-8)


def test_batches_of_long_series_and_underflow(spark, monkeypatch):
    monkeypatch.setattr(series, "ROWS", 50)
    m = gaussian("HMC-IN", [0, 400], [0.01, 0.01], stay=1 - 1e-12)
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for s, n in enumerate((3, 200, 1, 49, 60, 2)):
        y = np.where(rng.random(n) < 0.5, 0.0, 400.0)
        want[s] = Chain(m, y)
        rows += [(s, k, float(v)) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id long, n long, y double").coalesce(1)
    lik = {r["series_id"]: r["log_lik"] for r in series.log_likelihood(df, m).collect()}
    assert lik == pytest.approx({s: c.log_lik for s, c in want.items()})
    out = series.classify(df, m).toPandas()
    for s, c in want.items():
        assert np.allclose(np.array(out[out.series_id == s].sort_values("n")["gamma"].tolist()), c.gamma(), atol=1e-9)
    assert series.classify(df.limit(0), m).isEmpty()


def test_streaming_steps_are_the_forward_filter():
    m = MODELS["hmc_dn"]
    _, y = simulate(m, 30, np.random.default_rng(5))
    state = None
    for v in y:
        state, _ = filter_step(m, state, v)
    chain = Chain(m, y)
    assert state[2] == pytest.approx(chain.log_lik) and np.allclose(np.exp(state[1]), chain.filtered()[-1])


def test_streaming_query(spark, tmp_path):
    from markovine.streaming.online import online_filter

    m = MODELS["hmc_in"]
    _, y = simulate(m, 20, np.random.default_rng(6))
    rows = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(y)], "series_id long, n long, y double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = online_filter(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), m).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("online").orderBy("n").collect()
    assert np.allclose([r["filtered"] for r in got], Chain(m, y).filtered())


def test_posterior_draws_match_gamma():
    m = MODELS["pmc_state"]
    _, y = simulate(m, 12, np.random.default_rng(7))
    chain, rng = Chain(m, y), np.random.default_rng(8)
    share = np.mean([chain.sample(rng)[0] for _ in range(1500)], axis=0)
    assert np.abs(share - chain.gamma()[:, 1]).max() < 0.06


def test_mask_evidence_and_vectors():
    m = gaussian("HMC-IN", [-1, 1], [1, 1]).with_missingness(Missingness("state", (0.05, 0.6)))
    g = Chain(m, np.array([0.0, np.nan, 0.0])).gamma()
    assert g[1, 1] > g[0, 1]
    v = Model("HMC-IN", P / P.sum(), {(0,): VectorMargin((-1.0, -1.0), ((1.0, 0.2), (0.2, 1.0))), (1,): VectorMargin((1.0, 1.0), ((1.0, 0.0), (0.0, 1.0)))})
    x, y = simulate(v, 200, np.random.default_rng(0))
    y[5, 1] = np.nan
    assert (Chain(v, y).gamma().argmax(1) == x).mean() > 0.8


def test_impossible_observation():
    m = Model("HMC-IN", P / P.sum(), {(0,): Margin("expon"), (1,): Margin("expon", {"scale": 2.0})})
    with pytest.raises(ValueError):
        Chain(m, np.array([-1.0, 1.0])).forward()


def test_outliers_are_flagged():
    m = MODELS["hmc_dn"]
    _, y = simulate(m, 200, np.random.default_rng(9))
    y[100] = 12.0
    p, flag = flag_outliers(m, y, 1e-4)
    assert flag[100] and flag.sum() < 6
    assert bh_threshold(np.array([0.001, 0.5, 0.9]), 0.05) == 0.001 and bh_threshold(np.array([0.9]), 0.05) == 0.0


def test_toml_round_trip(tmp_path):
    m = MODELS["pmc_pair"].with_missingness(Missingness("state_markov", onset=(0.1, 0.2), persistence=(0.5, 0.6)))
    m = Model(m.variant, m.p / m.p.sum(), m.margins, m.copulas, missingness=m.missingness)
    m.save(str(tmp_path / "m.toml"))
    back = Model.load(str(tmp_path / "m.toml"))
    assert np.allclose(back.p, m.p) and back.margins == m.margins and back.copulas == m.copulas and back.missingness == m.missingness
    with pytest.raises(ModelError):
        Model("HMC-IN", np.eye(2), m.margins)


def test_ice_recovers_means(spark):
    m = gaussian("HMC-IN", [-2, 2], [1, 1])
    df = series.simulate_series(spark, m, 12, 150, seed=4).select("series_id", "n", "y")
    est = estimate.ice(df, gaussian("HMC-IN", [-0.5, 0.7], [2, 2], stay=0.6), max_iter=15)
    means = sorted(x.params["loc"] for x in est.model.margins.values())
    assert abs(means[0] + 2) < 0.25 and abs(means[1] - 2) < 0.25
    lls = [t["log_lik"] for t in est.trace]
    assert lls[-1] > lls[0]


def test_kendall_by_definition():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, 60) * 1.0
    y = x + rng.integers(0, 9, 60)
    w = rng.integers(0, 4, 60) * 1.0
    s = lambda a: np.sign(a[:, None] - a[None])
    ww = w[:, None] * w[None]
    want = (ww * s(x) * s(y)).sum() / math.sqrt((ww * s(x) ** 2).sum() * (ww * s(y) ** 2).sum())
    assert stats.kendall_tau(x, y, w) == pytest.approx(want)


def test_small_statistics():
    assert stats.error_rate(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 1]))[0] == 0.25
    assert stats.crps_from_samples(0.0, np.array([0.0, 0.0])) == 0.0
    assert list(stats.mid_ranks(np.array([3.0, 1.0, 3.0]))) == [2.5, 1.0, 2.5]
    assert stats.adjust([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])
    u = np.random.default_rng(0).random(500)
    assert stats.neyman_test(u)["p_value"] > 0.01 and stats.ks_pvalue(stats.ks_distance(u), 500) > 0.01
    assert stats.mks_statistic(np.c_[u[:250], u[250:]], lambda z: np.clip(z, 0, 1).prod(axis=1)) < 2 * stats.mks_critical(250, 2)
    la = np.random.default_rng(1).normal(0.3, 1, 400)
    assert stats.vuong_test(la, np.zeros(400))["preferred"] == "a" and stats.clarke_test(la, np.zeros(400))["preferred"] == "a"


def test_patterns_and_fills(spark):
    df = spark.createDataFrame([(s, n, float(n)) for s in (1, 2) for n in range(40)], "series_id long, n long, y double")
    for d, k in ((missing.aligned(df, 0.2), 8), (missing.scattered(df, 0.2), 8), (missing.mcar_blocks(df, 0.25, 5), 10), (missing.weighted_draw(df, 0.2), 8)):
        assert d.count() == 80
        assert {r["c"] for r in d.where("miss").groupBy("series_id").count().withColumnRenamed("count", "c").collect()} == {k}
        assert d.where("miss AND n < 4").isEmpty()
    gap = missing.aligned(df, 0.2).selectExpr("series_id", "n", "y AS truth", "CASE WHEN NOT miss THEN y END AS y")
    line = missing.linear(gap).toPandas()
    assert np.allclose(line["filled"], line["truth"])
    assert missing.aligned(df.limit(0), 0.2).isEmpty()


def test_cells(spark):
    d = spark.createDataFrame([("",), (" NaN",), ("na",), ("1.5",)], "c string")
    from pyspark.sql import functions as F

    assert [r[0] for r in d.select(missing.parse_cell(F.col("c"))).collect()] == [None, None, None, 1.5]


def test_csv(spark, tmp_path):
    from markovine.sources.tables import CSVLoadError, read_observations

    (tmp_path / "a.csv").write_text("n,X,Y\n1,0,1.5\n2,1,\n3,0,NaN\n")
    got = read_observations(spark, str(tmp_path / "a.csv"), ref="X").orderBy("n").collect()
    assert [(r["n"], r["y"], r["x"]) for r in got] == [(0, 1.5, 0), (1, None, 1), (2, None, 0)]
    (tmp_path / "b.csv").write_text("Y\nx\n")
    (tmp_path / "c.csv").write_text("n,X,Y\n1,0,1.5\n2,1\n")
    for name in "bc":
        with pytest.raises(CSVLoadError):
            read_observations(spark, str(tmp_path / f"{name}.csv"))


@pytest.mark.parametrize("h,w", [(1, 7), (8, 8), (5, 11), (24, 37), (13, 6)])
def test_curve_visits_every_cell_once_through_neighbours(h, w):
    p = image.curve(h, w)
    assert len({tuple(x) for x in p.tolist()}) == h * w == len(p)
    assert np.abs(np.diff(p, axis=0)).max() <= 1
    assert (image.position_of(p[:, 0], p[:, 1], h, w) == np.arange(h * w)).all()


def test_curve_of_small_squares():
    assert image.curve(2, 2).tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert image.curve(1, 3).tolist() == [[0, 0], [0, 1], [0, 2]]


def test_queries_run_and_agree_with_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from markovine.plans import registry

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("forward_pmc_pair", "pair_posteriors", "outliers_bh", "kendall_tau", "fill_locf_linear_mean", "tau_inversion", "margin_kernels"):
        a, b = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns) and len(a) == len(b)
        a, b = (pd.DataFrame(x[cols]).sort_values(cols).reset_index(drop=True) for x in (a, b))
        for c in cols:
            assert (a[c] == b[c]).all() if a[c].dtype == object else np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True)


def test_missingness_test_fits_the_rates(spark):
    """Low rates that differ by state; a common rate that does not."""
    m = gaussian("HMC-IN", [-2, 2], [1, 1])
    df = series.simulate_series(spark, m, 4, 500, 3).cache()
    y = F.when(~F.col("miss"), F.col("y"))
    got = []
    for rates in ([0.02, 0.10], [0.05, 0.05]):
        rows = missing.state_dependent(df, rates).select("series_id", "n", y.alias("y"))
        got.append(estimate.missingness_lr_test(rows, m, max_iter=12))
    assert got[0]["p_value"] < 1e-4 and np.allclose(got[0]["rates"], [0.02, 0.10], atol=0.03)
    assert got[1]["p_value"] > 0.01
