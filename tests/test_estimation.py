import numpy as np
import pytest

from markovine.functions.margins import Margin
from markovine.operators import ecdf, estimate, series
from markovine.operators.engine import Batch, Chain, simulate, simulate_many
from markovine.operators.series import rng_of
from markovine.plans.model import Copula, Missingness, Model, gaussian
from markovine.streaming.online import filter_step

MODEL = gaussian("HMC-IN", [0.0, 4.0], [1.0, 0.7], stay=0.85)


def rows_of(model, sizes, gaps=0.0, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for s, n in enumerate(sizes):
        _, y = simulate(model, n, rng)
        out += [(s, k, None if rng.random() < gaps else float(v)) for k, v in enumerate(y)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "series_id long, n long, y double")


@pytest.mark.parametrize("mask", [Missingness("state", rates=(0.1, 0.4)), Missingness("state_markov", onset=(0.05, 0.3), persistence=(0.5, 0.8))])
def test_masks_in_filter_forecast_and_stream(spark, mask):
    m = MODEL.with_missingness(mask)
    rows = rows_of(MODEL, [12, 9, 15], 0.3)
    rows[11] = (0, 11, None)  # a series that ends with a gap
    df = table(spark, rows)
    lls = {r["series_id"]: r["log_lik"] for r in series.log_likelihood(df, m).collect()}
    last = {}
    for r in series.forward(df, m).collect():
        assert r["log_lik"] == pytest.approx(lls[r["series_id"]], abs=1e-9)
        last[r["series_id"]] = np.array(r["last"])
    plain = {r["series_id"]: r["log_lik"] for r in series.log_likelihood(df, MODEL).collect()}
    assert any(abs(plain[s] - lls[s]) > 0.1 for s in lls)
    for s, p in last.items():
        state = None
        for _, _, v in [r for r in rows if r[0] == s]:
            state, _ = filter_step(m, state, np.nan if v is None else v)
        assert np.allclose(np.exp(state[1]), p, atol=1e-10) and state[2] == pytest.approx(lls[s], abs=1e-9)
    for r in series.forecast(df, m, 3).collect():  # no evidence from rows that are to come
        assert np.allclose(r["state"], last[r["series_id"]] @ np.linalg.matrix_power(MODEL.A, r["step"]), atol=1e-9)


def test_forecasts_from_the_last_message_equal_those_of_the_whole_series(spark):
    m = Model("HMC-DN", MODEL.p, MODEL.margins, {(0, 0): Copula("Clayton", 0.4), (1, 1): Copula("Gauss", 0.5)})
    rows = rows_of(m, [14, 8], 0.0)
    for r in series.forecast(table(spark, rows), m, 2).collect():
        y = np.array([v for s, _, v in rows if s == r["series_id"]] + [np.nan] * 2)
        whole = Chain(m, y).impute()[r["step"] - 1]
        assert r["mean"] == pytest.approx(whole[1], abs=1e-9) and r["sd"] == pytest.approx(whole[2], abs=1e-9)


def test_draws_of_missing_rows_follow_the_posterior():
    y = np.array([0.2, np.nan, np.nan, 4.1, np.nan])
    b = Batch(MODEL, y, np.array([5]))
    many = np.array([estimate.completed(b, np.array([7]), 3, d) for d in range(1500)])
    assert np.array_equal(many[0], estimate.completed(b, np.array([7]), 3, 0)) and np.isfinite(many).all()
    for n, mean, sd, _ in Chain(MODEL, y).impute():
        assert many[:, n].mean() == pytest.approx(mean, abs=5 * sd / 1500**0.5)
    assert (many[:, [0, 3]] == y[[0, 3]]).all()


def test_estimation_with_draws(spark):
    df = table(spark, rows_of(MODEL, [60] * 6, 0.25))
    start = gaussian("HMC-IN", [0.5, 3.0], [1.5, 1.5], stay=0.7)
    est = estimate.ice(df, start, max_iter=6, draws=3)
    means = [est.model.margin(i, 0).loc for i in range(2)]
    assert means == pytest.approx([0.0, 4.0], abs=0.4)
    # no gaps: draws change nothing
    full = table(spark, rows_of(MODEL, [30] * 2))
    s = estimate.e_step(full, start, (), draws=2)
    a, b = estimate.m_step_draws(start, s, 2, ()), estimate.m_step(start, estimate.e_step(full, start, ()), ())
    assert np.allclose(a.p, b.p) and all(a.margins[k].params == pytest.approx(b.margins[k].params) for k in a.margins)


def test_starts_share_passes_and_equal_single_runs(spark):
    df = table(spark, rows_of(MODEL, [40] * 3))
    starts = [gaussian("HMC-IN", [a, 3.0], [1.0, 1.0]) for a in (-1.0, 1.0)]
    both = estimate.ice_many(df, starts, max_iter=4)
    for start, run in zip(starts, both, strict=True):
        assert [t["log_lik"] for t in run.trace] == pytest.approx([t["log_lik"] for t in estimate.ice(df, start, max_iter=4).trace])
    best = estimate.multistart(df, starts[0], 2, max_iter=3)
    assert best.log_lik >= estimate.ice(df, starts[0], max_iter=3).log_lik - 1e-9


def test_margin_families_inside_estimation(spark):
    true = Model("HMC-IN", MODEL.p, {(0,): Margin("norm", {"loc": 0.0, "scale": 1.0}), (1,): Margin("lognorm", {"s": 0.4, "scale": 8.0})})
    df = table(spark, rows_of(true, [150] * 4))
    start = Model("HMC-IN", MODEL.p, {(0,): Margin("norm", {"loc": 0.0, "scale": 1.0}), (1,): Margin("norm", {"loc": 8.0, "scale": 2.0})}, candidates={(0,): ("norm", "logistic"), (1,): ("norm", "lognorm")})
    fitted = estimate.choose_margins(df, start, start, "bic")
    assert fitted.margins[(1,)].dist == "lognorm" and fitted.margins[(0,)].dist in ("norm", "logistic")
    assert estimate.ice(df, start, max_iter=2, margin_criterion="bic").model.margins[(1,)].dist == "lognorm"


def test_weighted_distribution_functions(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i % 2}", float(rng.integers(0, 30)) if i % 3 else 5.0, float(rng.random())) for i in range(900)] + [("k0", None, 1.0), ("k1", 2.0, None)]
    df = spark.createDataFrame(rows, "key string, y double, w double")
    for ranges in (1, 7, 256):
        got = {(r["key"], r["y"]): r["cdf"] for r in ecdf.weighted_cdf(df, ranges).collect()}
        seen = [r for r in rows if r[1] is not None and r[2] is not None]
        assert set(got) == {(k, y) for k, y, _ in seen}
        for (k, y), f in got.items():
            assert f == pytest.approx(sum(w for a, b, w in seen if a == k and b <= y) / (1 + sum(w for a, _, w in seen if a == k)))
    assert ecdf.weighted_cdf(df.limit(0)).count() == 0


def test_many_simulated_series():
    m = Model("PMC", np.array([[0.5, 0.05], [0.05, 0.4]]), {(0,): Margin("norm", {"loc": 0.0, "scale": 1.0}), (1,): Margin("norm", {"loc": 3.0, "scale": 0.5})}, {(0, 0): Copula("Clayton", 0.5), (1, 1): Copula("Gauss", 0.6)})
    sizes = np.array([50] * 60 + [1, 30])
    keys = [f"s{k}" for k in range(62)]
    x, y = simulate_many(m, sizes, [rng_of(1, k) for k in keys])
    assert len(x) == len(y) == sizes.sum()
    again = simulate_many(m, sizes[60:], [rng_of(1, k) for k in keys[60:]])
    assert np.array_equal(again[0], x[3000:]) and np.allclose(again[1], y[3000:])
    assert x.mean() == pytest.approx(0.45, abs=0.08)
    assert y[x == 0].mean() == pytest.approx(0.0, abs=0.25) and y[x == 1].std() == pytest.approx(0.5, abs=0.1)
    x, y = x[:3000].reshape(60, 50), y[:3000].reshape(60, 50)
    stay = (x[:, :-1] == 1) & (x[:, 1:] == 1)
    assert np.corrcoef(y[:, :-1][stay], y[:, 1:][stay])[0, 1] == pytest.approx(np.sin(np.pi * 0.3), abs=0.08)


def test_reader_refuses_what_is_no_finite_number(spark, tmp_path):
    from markovine.sources.tables import CSVLoadError, read_observations

    good = tmp_path / "good.csv"
    good.write_text("Y\n1.5\n\nNaN\nna\n-2e3\n")
    got = sorted((r["n"], r["y"]) for r in read_observations(spark, str(good)).collect() if r["y"] is not None)
    assert [y for _, y in got] == [1.5, -2000.0]
    for cell in ("inf", "-Infinity", "1e999", "x"):
        bad = tmp_path / f"{cell}.csv"
        bad.write_text(f"Y\n1.5\n{cell}\n")
        with pytest.raises(CSVLoadError):
            read_observations(spark, str(bad))
