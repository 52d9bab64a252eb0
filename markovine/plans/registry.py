"""Registered queries over the synthetic tables, and their SQL counterparts.

Series are the users' log values, pairs their consecutive values.  Results are rounded
where two engines may add numbers in a different order.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ops
from ..functions.copulas import FAMILIES
from ..functions.margins import Margin
from ..functions.ops import Sql
from ..operators import catalyst, ecdf, estimate, grouped, image, inference, missing, selection, series
from ..operators import fit as fitting
from ..sources.tables import events_series, lag_pairs, table
from . import oracle
from .model import Copula, Missingness, Model, gaussian

# ------------------------------------------------------------------ SQL sources

EV = "SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, event_type AS kind, value, CASE WHEN value > 0 THEN ln(value) END AS y FROM events"
PAIRS = f"SELECT series_id AS g, n, value AS x, z AS y, CAST(n % 3 + 1 AS DOUBLE) AS w FROM (SELECT *, lead(value) OVER (PARTITION BY series_id ORDER BY n) AS z FROM ({EV}) e) q WHERE z IS NOT NULL"
RANKED = f"SELECT g, n, (rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY g) + 1.0) AS u, (rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0) / (count(*) OVER (PARTITION BY g) + 1.0) AS v, count(*) OVER (PARTITION BY g) AS m FROM ({PAIRS}) p"
#: The first tenth of a series is protected, the next fifth is missing.
GAPPED = f"SELECT series_id, n, value, y, n >= ceil(len * 0.1 - 1e-9) AND n < ceil(len * 0.1 - 1e-9) + floor(len * 0.2 + 1e-9) AS miss FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS len FROM ({EV}) e) q"


# ------------------------------------------------------------------ models


@cache
def models() -> dict[str, Model]:
    """One model per variant, for series of log values."""
    n = lambda m, s: Margin("norm", {"loc": m, "scale": s})
    p = np.array([[0.5, 0.05], [0.05, 0.4]])
    pair = {(0, 0): n(2.4, 1.2), (0, 1): n(2.8, 1.3), (1, 0): n(3.6, 1.1), (1, 1): n(3.9, 0.8)}
    copulas = {(0, 0): Copula("Clayton", 0.3), (0, 1): Copula("FGM", 0.1), (1, 0): Copula("Frank", 0.2), (1, 1): Copula("GH", 0.25)}
    return {
        "hmc_in": gaussian("HMC-IN", [2.4, 3.9], [1.2, 0.8]),
        "hmc_dn": gaussian("HMC-DN", [2.4, 3.9], [1.2, 0.8], tau=0.4, family="Clayton"),
        "pmc_in_pair": Model("PMC-IN", p, pair),
        "pmc_state": Model("PMC", p, {(0,): n(2.4, 1.2), (1,): n(3.9, 0.8)}, copulas),
        "pmc_pair": Model("PMC", p, pair, copulas),
    }


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in cols else c for c in df.columns))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# ------------------------------------------------------------------ sequences


def _classify_sql(m: Model) -> str:
    return f"WITH RECURSIVE {oracle.smooth_sql(m, EV)} SELECT series_id, n, round(g0, 4) AS gamma_0, round(g1, 4) AS gamma_1 FROM post"


@query("classify_pmc", _classify_sql(models()["pmc_pair"]))
def classify_pmc(spark, sf):
    """Posterior state probabilities of the pairwise chain with pair margins."""
    out = series.classify(events_series(spark, sf), models()["pmc_pair"])
    return out.select("series_id", "n", F.round(F.col("gamma")[0], 4).alias("gamma_0"), F.round(F.col("gamma")[1], 4).alias("gamma_1"))


@query("classify_blocks_hmc_dn", _classify_sql(models()["hmc_dn"]))
def classify_blocks_hmc_dn(spark, sf):
    """The same for a hidden chain with dependent noise, cut into blocks of 16 rows."""
    out = series.classify_blocks(events_series(spark, sf), models()["hmc_dn"], 16)
    return out.select("series_id", "n", F.round(F.col("gamma")[0], 4).alias("gamma_0"), F.round(F.col("gamma")[1], 4).alias("gamma_1"))


def _forward_query(name: str):
    m = models()[name]
    sql = f"WITH RECURSIVE {oracle.filter_sql(m, EV)} SELECT series_id, round(ll + ln(b0 + b1), 6) AS log_lik, round(b0 / (b0 + b1), 6) AS last_0 FROM fwd JOIN (SELECT series_id, max(n) AS n FROM fwd GROUP BY series_id) z USING (series_id, n)"

    @query(f"forward_{name}", sql)
    def run(spark, sf):
        out = series.forward(events_series(spark, sf), m)
        return out.select("series_id", F.round("log_lik", 6).alias("log_lik"), F.round(F.col("last")[0], 6).alias("last_0"))

    return run


for _name in models():
    _forward_query(_name)


def _xi_sql(m: Model) -> str:
    w = [[oracle.step(m, i, j, "f", "s") for j in range(2)] for i in range(2)]
    cell = {(i, j): f"f.b{i} * {w[i][j]} * s.e{j}" for i in range(2) for j in range(2)}
    total = "(" + " + ".join(cell.values()) + ")"
    sums = ", ".join(f"round(sum({c} / {total}), 5) AS xi_{i}{j}" for (i, j), c in cell.items())
    return f"WITH RECURSIVE {oracle.smooth_sql(m, EV)} SELECT f.series_id, {sums} FROM fwd f JOIN bwd s ON s.series_id = f.series_id AND s.n = f.n + 1 GROUP BY f.series_id"


@query("pair_posteriors", _xi_sql(models()["pmc_state"]))
def pair_posteriors(spark, sf):
    xi = series.pair_posteriors(events_series(spark, sf), models()["pmc_state"])
    return xi.groupBy("series_id").agg(*(F.round(F.sum(F.col("xi")[2 * i + j]), 5).alias(f"xi_{i}{j}") for i in range(2) for j in range(2)))


def _pmm_sql(m: Model) -> str:
    a = ", ".join(f"{text} AS {k}" for k, text in oracle.columns(m).items())
    w = {(i, j): f"{oracle.number(m.p[i, j])} * l.f{i}{j} * r.f{j}{i} * " + oracle.density(m.copula(i, j).name, m.copula(i, j).tau, f"l.u{i}{j}", f"r.u{j}{i}") for i in range(2) for j in range(2)}
    z = "(" + " + ".join(f"({x})" for x in w.values()) + ")"
    return f"WITH rws AS MATERIALIZED (SELECT series_id, n, {a} FROM ({EV}) q) SELECT l.series_id, CAST(floor(l.n / 2) AS BIGINT) AS pair, round((({w[0, 0]}) + ({w[0, 1]})) / {z}, 6) AS left_0, round((({w[0, 0]}) + ({w[1, 0]})) / {z}, 6) AS right_0, round(ln({z}), 6) AS log_lik FROM rws l JOIN rws r ON r.series_id = l.series_id AND r.n = l.n + 1 WHERE l.n % 2 = 0"


@query("pmm_classify", _pmm_sql(models()["pmc_pair"]))
def pmm_classify(spark, sf):
    """Independent pairs (rows 2k and 2k + 1): joint posterior of both states."""
    got = series.classify_pairs(events_series(spark, sf), models()["pmc_pair"])
    return got.select("series_id", "pair", F.round(F.col("joint")[0] + F.col("joint")[1], 6).alias("left_0"), F.round(F.col("joint")[0] + F.col("joint")[2], 6).alias("right_0"), F.round("log_lik", 6).alias("log_lik"))


_IN = models()["hmc_in"]


def _state_cdf(j: int, row: str) -> str:
    m = _IN.margin(j, 0)
    return oracle.normal_cdf(f"(({row}.y - {m.loc!r}) / {m.scale!r})")


def _pit_terms(a: list[str], row: str) -> str:
    cdf = [_state_cdf(j, row) for j in range(2)]
    return " + ".join(f"({' + '.join(f'{a[i]} * {float(_IN.A[i, j])!r}' for i in range(2))}) * {cdf[j]}" for j in range(2))


_PIT = f"""{oracle.filter_sql(_IN, EV)}, pit AS (SELECT r.series_id, r.n, CASE WHEN r.n = 0 THEN {' + '.join(f'{float(_IN.pi[j])!r} * {_state_cdf(j, "r")}' for j in range(2))}
 ELSE {_pit_terms(['p.b0 / (p.b0 + p.b1)', 'p.b1 / (p.b0 + p.b1)'], 'r')} END AS pit FROM rws r LEFT JOIN fwd p ON p.series_id = r.series_id AND p.n = r.n - 1)"""


@query("predictive_pit", f"WITH RECURSIVE {_PIT} SELECT series_id, n, round(pit, 6) AS pit, round(2 * least(pit, 1 - pit), 6) AS p_value FROM pit")
def predictive_pit(spark, sf):
    return _rounded(series.predictive_pit(events_series(spark, sf), _IN).drop("log_predictive"), 6, "pit", "p_value")


@query(
    "outliers_bh",
    f"""WITH RECURSIVE {_PIT}, p AS (SELECT series_id, n, 2 * least(pit, 1 - pit) AS p FROM pit), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS k, count(*) OVER (PARTITION BY series_id) AS m FROM p),
    t AS (SELECT series_id, max(CASE WHEN p <= 0.2 * k / m THEN p ELSE 0 END) AS cut FROM r GROUP BY series_id) SELECT series_id, CAST(sum(CASE WHEN p <= cut THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM p JOIN t USING (series_id) GROUP BY series_id""",
)
def outliers_bh(spark, sf):
    f = series.outliers(events_series(spark, sf), _IN, 0.2, sequential=False, correction="bh")
    return f.groupBy("series_id").agg(F.sum(F.col("outlier").cast("long")).alias("flagged"))


def _sequential_sql(alpha: float) -> str:
    """A row's p-value from the state probabilities before it; a flagged row teaches nothing."""
    prior = {0: [repr(float(x)) for x in _IN.pi], 1: [" + ".join(f"s.b{i} * {float(_IN.A[i, j])!r}" for i in range(2)) for j in range(2)]}

    def row(k: int, source: str) -> str:
        inner = f"SELECT r.series_id, r.n, r.y, r.f00, r.f10, {', '.join(f'{a} AS a{j}' for j, a in enumerate(prior[k]))} FROM {source}"
        p = f"SELECT *, CASE WHEN y IS NOT NULL THEN 2 * least({' + '.join(f'a{j} * {_state_cdf(j, chr(113))}' for j in range(2))}, 1 - ({' + '.join(f'a{j} * {_state_cdf(j, chr(113))}' for j in range(2))})) END AS p FROM ({inner}) q"
        w = [f"a{j} * CASE WHEN p < {alpha!r} THEN 1.0 ELSE f{j}0 END" for j in range(2)]
        return f"SELECT series_id, n, p, " + ", ".join(f"({x}) / ({w[0]} + {w[1]}) AS b{j}" for j, x in enumerate(w)) + f" FROM ({p}) q2"

    return f"WITH RECURSIVE {oracle.rows(_IN, EV)}, run AS ({row(0, 'rws r WHERE r.n = 0')} UNION ALL {row(1, 'run s JOIN rws r ON r.series_id = s.series_id AND r.n = s.n + 1')}) SELECT series_id, n, round(p, 6) AS p_value, coalesce(p < {alpha!r}, false) AS outlier FROM run"


@query("outliers_sequential", _sequential_sql(0.05))
def outliers_sequential(spark, sf):
    return _rounded(series.outliers(events_series(spark, sf), _IN, 0.05), 6, "p_value")


@query("outliers_sequential_dn")
def outliers_sequential_dn(spark, sf):
    """Flagged rows of a chain with dependent noise are integrated on the grid."""
    return series.outliers(events_series(spark, sf), models()["hmc_dn"], 0.01)


# ------------------------------------------------------------------ missing data

_MASKED = f"SELECT series_id, n, miss, lag(miss) OVER (PARTITION BY series_id ORDER BY n) AS was, CASE WHEN NOT miss THEN y END AS y FROM ({GAPPED}) g"


def _gap_sql(select: str, evidence: list[str] | None = None) -> str:
    return f"WITH RECURSIVE {oracle.smooth_sql(_IN, _MASKED, evidence)} {select}"


def _gapped(spark, sf):
    return missing.aligned(events_series(spark, sf), 0.2).withColumn("y", F.when(~F.col("miss"), F.col("y")))


_M0, _M1 = _IN.margins[(0,)], _IN.margins[(1,)]


@query(
    "impute_hmc_in",
    _gap_sql(
        f"SELECT p.series_id, p.n, round(g0 * {_M0.loc!r} + g1 * {_M1.loc!r}, 6) AS mean, round(sqrt(g0 * {_M0.scale**2 + _M0.loc**2!r} + g1 * {_M1.scale**2 + _M1.loc**2!r} - power(g0 * {_M0.loc!r} + g1 * {_M1.loc!r}, 2)), 6) AS sd FROM post p JOIN rws r ON r.series_id = p.series_id AND r.n = p.n WHERE r.y IS NULL"
    ),
)
def impute_hmc_in(spark, sf):
    return _rounded(series.impute(_gapped(spark, sf), _IN).drop("quantiles"), 6, "mean", "sd")


@query("impute_grid_hmc_dn")
def impute_grid_hmc_dn(spark, sf):
    """Gaps of a model with dependent noise, integrated on the quadrature grid."""
    return series.impute(_gapped(spark, sf), models()["hmc_dn"])


_A1, _A2 = _IN.A, _IN.A @ _IN.A


@query(
    "forecast_hmc_in",
    f"WITH RECURSIVE {oracle.filter_sql(_IN, EV)}, l AS (SELECT series_id, b0 / (b0 + b1) AS a0, b1 / (b0 + b1) AS a1 FROM fwd JOIN (SELECT series_id, max(n) AS n FROM fwd GROUP BY series_id) z USING (series_id, n)) "
    + " UNION ALL ".join(
        f"SELECT series_id, {k} AS step, round(a0 * {float(A[0, 0])!r} + a1 * {float(A[1, 0])!r}, 6) AS state_0, round((a0 * {float(A[0, 0])!r} + a1 * {float(A[1, 0])!r}) * {_M0.loc!r} + (a0 * {float(A[0, 1])!r} + a1 * {float(A[1, 1])!r}) * {_M1.loc!r}, 6) AS mean FROM l"
        for k, A in ((1, _A1), (2, _A2))
    ),
)
def forecast_hmc_in(spark, sf):
    f = series.forecast(events_series(spark, sf), _IN, 2)
    return f.select("series_id", "step", F.round(F.col("state")[0], 6).alias("state_0"), F.round("mean", 6).alias("mean"))


@query(
    "missingness_rates",
    _gap_sql("SELECT round(sum(CASE WHEN y IS NULL THEN g0 ELSE 0 END) / sum(g0), 6) AS rate_0, round(sum(CASE WHEN y IS NULL THEN g1 ELSE 0 END) / sum(g1), 6) AS rate_1 FROM post p JOIN rws r USING (series_id, n)"),
)
def missingness_rates(spark, sf):
    """M-step of a state-dependent mask from posteriors and mask."""
    rows = _gapped(spark, sf)
    g = series.classify(rows, _IN).join(rows.select("series_id", "n", "miss"), ["series_id", "n"])
    rates = estimate.missingness_rates(g, 2)
    return spark.createDataFrame([tuple(round(r, 6) for r in rates)], "rate_0 double, rate_1 double")


_MASK = Missingness("state_markov", onset=(0.05, 0.2), persistence=(0.6, 0.8))
_EVIDENCE = [f"CASE WHEN miss THEN x ELSE 1 - x END".replace("x", f"(CASE WHEN was IS NULL THEN {a / (1 - b + a)!r} WHEN was THEN {b!r} ELSE {a!r} END)") for a, b in zip(_MASK.onset, _MASK.persistence, strict=True)]


@query("classify_with_mask_evidence", _gap_sql("SELECT series_id, n, round(g0, 5) AS gamma_0 FROM post", _EVIDENCE))
def classify_with_mask_evidence(spark, sf):
    """Posteriors when the mask itself tells about the state."""
    got = series.classify(_gapped(spark, sf), _IN.with_missingness(_MASK))
    return got.select("series_id", "n", F.round(F.col("gamma")[0], 5).alias("gamma_0"))


def _last_sql(select: str) -> str:
    last = "l AS (SELECT series_id, b0 / (b0 + b1) AS a0, b1 / (b0 + b1) AS a1, ll + ln(b0 + b1) AS ll FROM fwd JOIN (SELECT series_id, max(n) AS n FROM fwd GROUP BY series_id) z USING (series_id, n))"
    return f"WITH RECURSIVE {oracle.filter_sql(_IN, _MASKED, _EVIDENCE)}, {last} {select}"


@query("forward_with_mask_evidence", _last_sql("SELECT series_id, round(ll, 5) AS log_lik, round(a0, 6) AS last_0 FROM l"))
def forward_with_mask_evidence(spark, sf):
    got = catalyst.forward(_gapped(spark, sf), _IN.with_missingness(_MASK))
    return got.select("series_id", F.round("log_lik", 5).alias("log_lik"), F.round(F.col("last")[0], 6).alias("last_0"))


@query("forecast_with_mask_evidence", _last_sql(" UNION ALL ".join(f"SELECT series_id, {k} AS step, round(a0 * {float(A[0, 0])!r} + a1 * {float(A[1, 0])!r}, 6) AS state_0, round((a0 * {float(A[0, 0])!r} + a1 * {float(A[1, 0])!r}) * {_M0.loc!r} + (a0 * {float(A[0, 1])!r} + a1 * {float(A[1, 1])!r}) * {_M1.loc!r}, 6) AS mean FROM l" for k, A in ((1, _A1), (2, _A2)))))
def forecast_with_mask_evidence(spark, sf):
    """The mask tells about the rows that are there, not about those to come."""
    f = series.forecast(_gapped(spark, sf), _IN.with_missingness(_MASK), 2)
    return f.select("series_id", "step", F.round(F.col("state")[0], 6).alias("state_0"), F.round("mean", 6).alias("mean"))


# A chain whose states have one and the same normal law and dependence is a Gaussian
# autoregression, whatever the states, so gaps and forecasts have closed forms.
_RHO, _MEAN, _SD = float(np.sin(np.pi * 0.4 / 2)), 3.2, 1.3


def _autoregression(tau: float = 0.4) -> Model:
    same = Margin("norm", {"loc": _MEAN, "scale": _SD})
    p = np.array([[0.5, 0.1], [0.1, 0.3]])
    return Model("HMC-DN", p, {(0,): same, (1,): same}, {(i, j): Copula("Gauss", tau) for i in range(2) for j in range(2)})


_Z = f"SELECT series_id, n, miss, CASE WHEN NOT miss THEN (y - {_MEAN!r}) / {_SD!r} END AS z FROM ({GAPPED}) g"
_LAST = f"SELECT *, last_value(z IGNORE NULLS) OVER w AS zl, last_value(CASE WHEN z IS NOT NULL THEN n END IGNORE NULLS) OVER w AS nl, first_value(z IGNORE NULLS) OVER f AS zr, first_value(CASE WHEN z IS NOT NULL THEN n END IGNORE NULLS) OVER f AS nr FROM ({_Z}) z0 WINDOW w AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
def _powers(rho: float) -> tuple[str, str, str]:
    return f"power({rho!r}, n - nl)", f"power({rho!r}, nr - n)", f"power({rho!r}, nr - nl)"


_POW = _powers(_RHO)


def _bridge_sql(_POW: tuple[str, str, str], digits: int = 3) -> str:
    return f"SELECT series_id, n, round({_MEAN!r} + {_SD!r} * ({_POW[0]} * (1 - power({_POW[1]}, 2)) * zl + {_POW[1]} * (1 - power({_POW[0]}, 2)) * zr) / (1 - power({_POW[2]}, 2)), {digits}) AS mean, round({_SD!r} * sqrt((1 - power({_POW[0]}, 2)) * (1 - power({_POW[1]}, 2)) / (1 - power({_POW[2]}, 2))), {digits}) AS sd FROM ({_LAST}) q WHERE z IS NULL AND zl IS NOT NULL AND zr IS NOT NULL"


@query("impute_autoregression", _bridge_sql(_POW))
def impute_autoregression(spark, sf):
    """Gaps integrated on the quadrature grid, against the bridge of an autoregression."""
    return _bridged(spark, sf, _autoregression())


#: Almost deterministic dependence: a neighbour leaves a twentieth of the spread.
_STRONG = 0.97


@query("impute_strong_autoregression", _bridge_sql(_powers(float(np.sin(np.pi * _STRONG / 2))), 2))
def impute_strong_autoregression(spark, sf):
    """The same where nodes have to be laid per gap."""
    return _bridged(spark, sf, _autoregression(_STRONG), 2)


def _bridged(spark, sf, model: Model, digits: int = 3) -> DataFrame:
    rows = _gapped(spark, sf)
    inner = rows.withColumn("first", F.min(F.when(F.col("y").isNotNull(), F.col("n"))).over(Window.partitionBy("series_id"))).withColumn("end", F.max(F.when(F.col("y").isNotNull(), F.col("n"))).over(Window.partitionBy("series_id")))
    got = series.impute(rows, model).join(inner.where("n > first AND n < end").select("series_id", "n"), ["series_id", "n"])
    return _rounded(got.drop("quantiles"), digits, "mean", "sd")


@query(
    "forward_autoregression",
    f"SELECT series_id, round(sum(CASE WHEN nl IS NULL THEN -0.5 * z * z - {float(np.log(_SD * np.sqrt(2 * np.pi)))!r} ELSE -0.5 * power(z - {_POW[0]} * zl, 2) / (1 - power({_POW[0]}, 2)) - 0.5 * ln(1 - power({_POW[0]}, 2)) - {float(np.log(_SD * np.sqrt(2 * np.pi)))!r} END), 3) AS log_lik FROM ({_LAST}) q WHERE z IS NOT NULL GROUP BY series_id",
)
def forward_autoregression(spark, sf):
    """Likelihoods of series with gaps, against those of an autoregression."""
    return _rounded(series.log_likelihood(_gapped(spark, sf), _autoregression()), 3, "log_lik")


@query(
    "forecast_autoregression",
    " UNION ALL ".join(f"SELECT series_id, {k} AS step, round({_MEAN!r} + {_SD!r} * {_RHO**k!r} * z, 3) AS mean, round({_SD * float(np.sqrt(1 - _RHO ** (2 * k)))!r}, 3) AS sd FROM (SELECT series_id, arg_max((y - {_MEAN!r}) / {_SD!r}, n) AS z FROM ({EV}) e GROUP BY series_id) q" for k in (1, 2, 3)),
)
def forecast_autoregression(spark, sf):
    got = series.forecast(events_series(spark, sf), _autoregression(), 3)
    return got.select("series_id", "step", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"))


@query("pattern_aligned", f"SELECT series_id, n, miss FROM ({GAPPED}) g")
def pattern_aligned(spark, sf):
    return missing.aligned(events_series(spark, sf), 0.2).select("series_id", "n", "miss")


_LEN = f"SELECT *, count(*) OVER (PARTITION BY series_id) AS len FROM ({EV}) e"


@query(
    "pattern_staircase",
    f"SELECT series_id, n, n >= h + c AND n < least(h + 2 * c, len) AS disjoint_1, n >= h + 2 * floor(len * 0.05 + 1e-9) AND n < least(h + 2 * floor(len * 0.05 + 1e-9) + c, len) AS overlap_2 FROM (SELECT *, ceil(len * 0.1 - 1e-9) AS h, floor(len * 0.15 + 1e-9) AS c FROM ({_LEN}) q) z",
)
def pattern_staircase(spark, sf):
    """Second column of disjoint blocks and third of overlapping ones."""
    s = events_series(spark, sf)
    d = missing.staircase(s, 0.15, 1).withColumnRenamed("miss", "disjoint_1")
    return missing.staircase(d, 0.15, 2, shift=0.05).select("series_id", "n", "disjoint_1", F.col("miss").alias("overlap_2"))


def _above(s: DataFrame) -> DataFrame:
    """Adds the state ``x``: one above 3.3, else zero (a value that is not there is not above)."""
    return s.withColumn("x", F.coalesce(F.col("y") > 3.3, F.lit(False)).cast("int"))


_U = "(('0x' || substr(md5(concat_ws(':', {0})), 1, 13))::BIGINT / 4503599627370496.0)"


@query("pattern_state_dependent", f"SELECT series_id, n, {_U.format("'5', CAST(series_id AS VARCHAR), CAST(n AS VARCHAR)")} < CASE WHEN y > 3.3 THEN 0.4 ELSE 0.1 END AS miss FROM ({EV}) e")
def pattern_state_dependent(spark, sf):
    s = _above(events_series(spark, sf))
    return missing.state_dependent(s, [0.1, 0.4], seed=5).select("series_id", "n", "miss")


def _patterns_sql() -> str:
    """Which rows every pattern takes, from the same hash draws."""
    u = _U.format("'0', CAST(series_id AS VARCHAR), CAST(n AS VARCHAR)")
    one = _U.format("'0', CAST(series_id AS VARCHAR)")
    slot = _U.format("'0', CAST(series_id AS VARCHAR), CAST(slot AS VARCHAR)")
    rows = f"rws AS MATERIALIZED (SELECT series_id, n, {u} AS u, {one} AS u1, len, CAST(ceil(len * 0.1 - 1e-9) AS BIGINT) AS head, CASE WHEN y > 3.3 THEN 0.2 ELSE 0.05 END AS a, CASE WHEN y > 3.3 THEN 0.8 ELSE 0.5 END AS b FROM ({_LEN}) e1)"
    cut = "CAST(floor(len * {0} + 1e-9) AS BIGINT)"
    start = f"head + CAST(floor(u1 * (len - {cut.format(0.2)} - head + 1)) AS BIGINT)"

    def drawn(weight: str) -> str:
        keys = f"SELECT *, CASE WHEN n >= head THEN -ln(u + 1e-300) / ({weight}) END AS k FROM rws"
        return f"SELECT series_id, n FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY k NULLS LAST, n) AS r FROM ({keys}) k0) r0 WHERE r <= {cut.format(0.2)}"

    m = f"({cut.format(0.3)} // 5)"
    heads = f"SELECT DISTINCT series_id, len, head FROM rws"
    chosen = f"SELECT series_id, head, slot, row_number() OVER (PARTITION BY series_id ORDER BY slot) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {slot}, slot) AS r FROM (SELECT *, unnest(range(1, len - head - {m} * 5 + {m} + 1)) AS slot FROM ({heads}) h0) h1) h2 WHERE r <= {m}"
    parts = {
        "scattered": f"SELECT series_id, n FROM rws WHERE n >= {start} AND n < {start} + {cut.format(0.2)}",
        "mcar_blocks": f"SELECT series_id, head + slot - 1 + i * 4 + j AS n FROM ({chosen}) c0 CROSS JOIN range(5) g(j)",
        "gaussian": drawn("exp(-0.5 * power(((n - head) / greatest(len - head, 1) - 0.5) / 0.2, 2))"),
        "uniform": drawn("1.0"),
        "state_markov": "SELECT series_id, n FROM run WHERE m",
    }
    every = " UNION ALL ".join(f"SELECT series_id, '{name}' AS pattern, n FROM ({q}) p_{name}" for name, q in parts.items())
    run = "run AS (SELECT series_id, n, u < a / (1 - b + a) AS m FROM rws WHERE n = 0 UNION ALL SELECT r.series_id, r.n, r.u < CASE WHEN s.m THEN r.b ELSE r.a END FROM run s JOIN rws r ON r.series_id = s.series_id AND r.n = s.n + 1)"
    return f"WITH RECURSIVE {rows}, {run} SELECT series_id, pattern, CAST(count(*) AS BIGINT) AS removed, CAST(sum(n) AS BIGINT) AS places, CAST(sum(n * n) AS BIGINT) AS squares FROM ({every}) z GROUP BY series_id, pattern"


@query("patterns_random", _patterns_sql())
def patterns_random(spark, sf):
    """Scattered, block, position-weighted and Markov masks: how many rows are removed per series, and
    where (sums of their places and of the squares)."""
    s = events_series(spark, sf)
    out = None
    for name, d in (
        ("scattered", missing.scattered(s, 0.2)),
        ("mcar_blocks", missing.mcar_blocks(s, 0.3, 5)),
        ("gaussian", missing.weighted_draw(s, 0.2, missing.gaussian_position())),
        ("uniform", missing.weighted_draw(s, 0.2)),
        ("state_markov", missing.state_markov(_above(s), [0.05, 0.2], [0.5, 0.8])),
    ):
        part = d.where("miss").groupBy("series_id").agg(F.count(F.lit(1)).alias("removed"), F.sum("n").alias("places"), F.sum(F.col("n") * F.col("n")).alias("squares")).withColumn("pattern", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "fill_locf_linear_mean",
    f"""SELECT series_id, n, round(coalesce(b, a), 9) AS locf, round(CASE WHEN y IS NOT NULL THEN y WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE b + (a - b) * (n - nb) / (na - nb) END, 9) AS linear, round(coalesce(y, m), 6) AS mean FROM (
    SELECT *, last_value(y IGNORE NULLS) OVER w AS b, last_value(k IGNORE NULLS) OVER w AS nb, first_value(y IGNORE NULLS) OVER f AS a, first_value(k IGNORE NULLS) OVER f AS na, avg(y) OVER (PARTITION BY series_id) AS m FROM (SELECT *, CASE WHEN y IS NOT NULL THEN n END AS k FROM ({_MASKED}) z0) z1
    WINDOW w AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) z2""",
)
def fill_locf_linear_mean(spark, sf):
    d = missing.locf(_gapped(spark, sf)).withColumnRenamed("filled", "locf")
    d = missing.linear(d).withColumnRenamed("filled", "linear")
    d = missing.mean_fill(d).withColumnRenamed("filled", "mean")
    return d.select("series_id", "n", F.round("locf", 9).alias("locf"), F.round("linear", 9).alias("linear"), F.round("mean", 6).alias("mean"))


_FILLED = f"SELECT g.series_id, g.n, g.miss, g.y AS truth, avg(CASE WHEN NOT miss THEN g.y END) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS guess FROM ({GAPPED}) g"


def _filled(spark, sf):
    d = missing.aligned(events_series(spark, sf), 0.2).withColumnRenamed("y", "truth")
    w = Window.partitionBy("series_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("guess", F.avg(F.when(~F.col("miss"), F.col("truth"))).over(w))


@query("metrics_points", f"SELECT kind, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(corr(truth, guess), 6) AS pearson, round(avg(CASE WHEN truth BETWEEN guess - 1 AND guess + 1 THEN 1.0 ELSE 0 END), 6) AS coverage FROM (SELECT f.*, e.kind, guess - truth AS d FROM ({_FILLED}) f JOIN ({EV}) e USING (series_id, n)) q WHERE guess IS NOT NULL GROUP BY kind")
def metrics_points(spark, sf):
    d = _filled(spark, sf).where("guess IS NOT NULL").withColumn("lo", F.col("guess") - 1).withColumn("hi", F.col("guess") + 1)
    all_rows = F.lit(True)
    a = missing.point_metrics(d, "truth", "guess", all_rows, ["kind"])
    return _rounded(a.join(missing.coverage(d, "truth", "lo", "hi", all_rows, ["kind"]), "kind"), 6, "rmse", "mae", "pearson", "coverage")


@query(
    "metrics_mutual_information",
    f"""WITH b AS (SELECT kind, floor((x - min(x) OVER (PARTITION BY kind)) / ((max(x) OVER (PARTITION BY kind) - min(x) OVER (PARTITION BY kind)) / 10)) AS i, floor((y - min(y) OVER (PARTITION BY kind)) / ((max(y) OVER (PARTITION BY kind) - min(y) OVER (PARTITION BY kind)) / 10)) AS j FROM (SELECT e.kind, p.x, p.y FROM ({PAIRS}) p JOIN ({EV}) e ON e.series_id = p.g AND e.n = p.n) q),
    c AS (SELECT kind, i, j, CAST(count(*) AS DOUBLE) AS k FROM b GROUP BY ALL) SELECT kind, round(sum(k / t * ln(k * t / (ki * kj))), 6) AS mi FROM (SELECT *, sum(k) OVER (PARTITION BY kind, i) AS ki, sum(k) OVER (PARTITION BY kind, j) AS kj, sum(k) OVER (PARTITION BY kind) AS t FROM c) z GROUP BY kind""",
)
def metrics_mutual_information(spark, sf):
    p = lag_pairs(spark, sf).join(events_series(spark, sf).select(F.col("series_id").alias("g"), "n", "kind"), ["g", "n"])
    return _rounded(missing.mutual_information(p, "x", "y", ["kind"]), 6, "mi")


_PHI = oracle.normal_cdf("z")


@query("metrics_crps_gaussian", f"SELECT series_id, round(avg(1.2 * (z * (2 * {_PHI} - 1) + 2 * exp(-0.5 * z * z) / {float(np.sqrt(2 * np.pi))!r} - {float(1 / np.sqrt(np.pi))!r})), 6) AS crps FROM (SELECT series_id, (y - 3.0) / 1.2 AS z FROM ({EV}) e) q GROUP BY series_id")
def metrics_crps_gaussian(spark, sf):
    rows = missing.crps_gaussian(events_series(spark, sf).where("y IS NOT NULL"), 3.0, 1.2)
    return rows.groupBy("series_id").agg(F.round(F.avg("crps"), 6).alias("crps"))


@query(
    "metrics_error_split",
    f"SELECT series_id, round(CASE WHEN e > 0.5 THEN 1 - e ELSE e END, 6) AS error, round(CASE WHEN e > 0.5 THEN 1 - em ELSE em END, 6) AS error_missing, round(CASE WHEN e > 0.5 THEN 1 - eo ELSE eo END, 6) AS error_observed FROM (SELECT series_id, avg(w) AS e, avg(CASE WHEN miss THEN w END) AS em, avg(CASE WHEN NOT miss THEN w END) AS eo FROM (SELECT series_id, miss, CASE WHEN (y > 3.3) <> (n % 2 = 0) THEN 1.0 ELSE 0.0 END AS w FROM ({GAPPED}) g) q GROUP BY series_id) z",
)
def metrics_error_split(spark, sf):
    d = missing.aligned(events_series(spark, sf), 0.2).withColumn("h", (F.col("n") % 2 == 0).cast("int"))
    d = d.withColumn("t", F.coalesce((F.col("y") > 3.3).cast("int"), "h"))  # a label that is not known is not known to be wrong
    return _rounded(missing.error_split(d, "t", "h", "miss", ["series_id"]), 6, "error", "error_missing", "error_observed")


@query("parse_cells", f"SELECT series_id, count(v) AS observed, round(sum(v), 6) AS total FROM (SELECT series_id, CASE WHEN lower(trim(c)) IN ('', 'nan', 'na') THEN NULL ELSE CAST(c AS DOUBLE) END AS v FROM (SELECT series_id, CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN ' NaN' WHEN 2 THEN 'na ' ELSE CAST(value AS VARCHAR) END AS c FROM ({EV}) e) q) z GROUP BY series_id")
def parse_cells(spark, sf):
    c = F.expr("CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN ' NaN' WHEN 2 THEN 'na ' ELSE CAST(value AS STRING) END")
    d = events_series(spark, sf).withColumn("v", missing.parse_cell(c))
    return d.groupBy("series_id").agg(F.count("v").alias("observed"), F.round(F.sum("v"), 6).alias("total"))


# ------------------------------------------------------------------ dependence


@query("pseudo_observations", f"SELECT g, n, round(u, 9) AS u, round(v, 9) AS v FROM ({RANKED}) r")
def pseudo_observations(spark, sf):
    return _rounded(grouped.pseudo_observations(lag_pairs(spark, sf)).select("g", "n", "u", "v"), 9, "u", "v")


@query("weighted_ecdf", f"SELECT g, n, round(sum(w) OVER (PARTITION BY g ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (sum(w) OVER (PARTITION BY g) + 1), 9) AS ecdf FROM ({PAIRS}) p")
def weighted_ecdf(spark, sf):
    return _rounded(grouped.weighted_ecdf(lag_pairs(spark, sf)).select("g", "n", "ecdf"), 9, "ecdf")


def _tau_sql(w: str) -> str:
    return f"SELECT a.g, sum({w} * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum({w} * abs(sign(a.x - b.x))) * sum({w} * abs(sign(a.y - b.y)))) AS tau FROM ({PAIRS}) a JOIN ({PAIRS}) b ON a.g = b.g GROUP BY a.g"


@query("kendall_tau", f"SELECT g, round(t.tau, 9) AS tau, round(tw.tau, 9) AS weighted_tau FROM ({_tau_sql('1.0')}) t JOIN ({_tau_sql('a.w * b.w')}) tw USING (g)")
def kendall_tau(spark, sf):
    p = lag_pairs(spark, sf)
    return _rounded(grouped.kendalls(p, {"tau": None, "weighted_tau": "w"}), 9, "tau", "weighted_tau")


def _theta(family: str) -> str:
    """The parameter from ``tau``, clipped into the family's range."""
    lo, hi = {"FGM": (-2 / 9, 2 / 9), "Clayton": (0.0, 1.0), "GH": (0.0, 1.0)}[family]
    pad = 1e-6 * (hi - lo)
    t = f"least(greatest(tau, {lo + pad!r}), {hi - pad!r})"
    return {"FGM": f"4.5 * {t}", "Clayton": f"2 * {t} / (1 - {t})", "GH": f"1 / (1 - {t})"}[family]


@query(
    "copula_statistics",
    f"""WITH r AS MATERIALIZED (SELECT q.*, v * (1 + t * (1 - 2 * u) * (1 - v)) AS e FROM (SELECT r.*, {_theta('FGM')} AS t FROM ({RANKED}) r JOIN ({_tau_sql('1.0')}) t ON r.g = t.g) q),
    c AS (SELECT a.g, a.n, a.m, a.u, a.v, a.e, avg(CASE WHEN b.u <= a.u AND b.v <= a.v THEN 1.0 ELSE 0 END) AS c1, avg(CASE WHEN b.u <= a.v AND b.v <= a.u THEN 1.0 ELSE 0 END) AS c2, avg(CASE WHEN b.u <= 1 - a.u + 1e-12 AND b.v <= 1 - a.v + 1e-12 THEN 1.0 ELSE 0 END) AS c3, avg(CASE WHEN b.u <= a.u AND b.e <= a.e THEN 1.0 ELSE 0 END) AS c4 FROM r a JOIN r b ON a.g = b.g GROUP BY ALL)
    SELECT g, round(sum(power(c1 - u * v, 2)), 4) AS cvm, round(sum(power(c1 - c2, 2)), 4) AS exchangeability, round(sum(power(c1 - (u + v - 1 + c3), 2)), 4) AS radial_symmetry, round(sum(power(c4 - u * e, 2)), 4) AS rosenblatt FROM c GROUP BY g""",
)
def copula_statistics(spark, sf):
    return _rounded(grouped.copula_statistics(lag_pairs(spark, sf)), 4, "cvm", "exchangeability", "radial_symmetry", "rosenblatt")


@query(
    "tau_inversion",
    f"WITH t AS ({_tau_sql('1.0')}) "
    + " UNION ALL ".join(
        f"SELECT g, '{f}' AS family, round(tau, 9) AS tau, round({th}, 6) AS theta FROM (SELECT g, tau, least(greatest(tau, {FAMILIES[f].clip_tau(-9)!r}), {FAMILIES[f].clip_tau(9)!r}) AS c FROM t) q"
        for f, th in (("Gauss", "sin(pi() * c / 2)"), ("Clayton", "2 * c / (1 - c)"), ("GH", "1 / (1 - c)"), ("FGM", "4.5 * c"))
    ),
)
def tau_inversion(spark, sf):
    return _rounded(_rounded(grouped.tau_fits(lag_pairs(spark, sf)), 9, "tau"), 6, "theta")


@query(
    "ljung_box",
    f"WITH z AS (SELECT g, n, x - avg(x) OVER (PARTITION BY g) AS z FROM ({PAIRS}) p), l AS (SELECT g, z, {', '.join(f'lag(z, {k}) OVER (PARTITION BY g ORDER BY n) AS z{k}' for k in range(1, 6))} FROM z), s AS (SELECT g, count(*) AS m, sum(z * z) AS s0, {', '.join(f'sum(z * z{k}) AS s{k}' for k in range(1, 6))} FROM l GROUP BY g) SELECT g, round(m * (m + 2.0) * ({' + '.join(f'power(s{k} / s0, 2) / (m - {k})' for k in range(1, 6))}), 6) AS q FROM s",
)
def ljung_box(spark, sf):
    return _rounded(grouped.ljung_box(lag_pairs(spark, sf)), 6, "q")


@query(
    "neyman_components",
    f"SELECT g, {', '.join(f'round(sum({p}) * {float(np.sqrt(2 * k + 1))!r} / sqrt(count(*)), 6) AS v{k}' for k, p in enumerate(('z', '(3 * z * z - 1) / 2', '(5 * z * z * z - 3 * z) / 2', '(35 * z * z * z * z - 30 * z * z + 3) / 8'), 1))} FROM (SELECT g, 2 * (1 - exp(-x / 49)) - 1 AS z FROM ({PAIRS}) p) q GROUP BY g",
)
def neyman_components(spark, sf):
    d = lag_pairs(spark, sf).withColumn("u", 1 - F.exp(-F.col("x") / 49))
    return _rounded(grouped.neyman(d), 6, "v1", "v2", "v3", "v4")


# ------------------------------------------------------------------ kernels

_GRID = [("Prod", 0.0), ("FGM", 0.15), ("CubSec", 0.1), ("Clayton", 0.5), ("GH", 0.5), ("Frank", 0.4), ("Joe", 0.5), ("A12", 0.6), ("A14", 0.6), ("AMH", 0.2), ("Plackett", 0.4), ("Galambos", 0.5), ("Tawn1", 0.3), ("Tawn2", 0.3), ("Tawn3", 0.3), ("BB1", 0.6), ("BB6", 0.6), ("BB7", 0.6), ("BB8", 0.5), ("SClayton", 0.5), ("SGH", 0.5), ("SJoe", 0.5), ("SBB1", 0.6), ("Clayton90", -0.5), ("Clayton270", -0.5), ("GH90", -0.5), ("GH270", -0.5), ("Joe90", -0.5), ("Joe270", -0.5), ("BB190", -0.6), ("BB1270", -0.6), ("A1290", -0.6), ("A12270", -0.6), ("A1490", -0.6), ("A14270", -0.6), ("SBB190", -0.6), ("SBB1270", -0.6)]
_EXTRA = {"Tawn1": {"psi": 0.7}, "Tawn2": {"psi": 0.7}, "Tawn3": {"psi_u": 0.8, "psi_v": 0.6}}
#: Where kernels are evaluated: the pseudo-observations of all pairs, in five parts.
_POINTS = f"SELECT g % 5 AS part, u, v FROM ({RANKED}) r0"


#: Families whose kernels are short enough to be compiled next to each other.
_SHORT = ("Prod", "FGM", "CubSec", "Clayton", "GH", "Frank", "AMH", "Plackett", "SClayton", "Clayton90", "GH270")


def _grid_params(name: str, tau: float) -> dict[str, float]:
    return FAMILIES[name].params(tau, _EXTRA.get(name))


def _kernel_oracle(names) -> str:
    return oracle.kernel_sql([(f, _grid_params(f, t)) for f, t in _GRID if f in names], _POINTS)


def _points(spark, sf) -> DataFrame:
    return grouped.pseudo_observations(lag_pairs(spark, sf)).select((F.col("g") % 5).alias("part"), "u", "v")


def _kernel_means(df: DataFrame) -> DataFrame:
    return df.select("family", "part", "n", F.round("pdf", 3).alias("pdf"), F.round("h", 4).alias("h"), F.round("cdf", 6).alias("cdf"))


@query("copula_kernels", _kernel_oracle(_SHORT))
def copula_kernels(spark, sf):
    """Density, conditional and joint distribution as Catalyst expressions, averaged over the
    pairs."""
    u, v = Sql("u"), Sql("v")
    means = [F.count(F.lit(1)).alias("n")]
    for name, tau in _GRID:
        if name in _SHORT:
            f, p = FAMILIES[name].shape, _grid_params(name, tau)
            means += [F.avg(F.expr(str(x))).alias(f"{k}_{name}") for k, x in (("pdf", ops.exp(f.log_pdf(u, v, p))), ("h", f.h(v, u, p)), ("cdf", f.cdf(u, v, p)))]
    wide = _points(spark, sf).groupBy("part").agg(*means)
    each = F.array(*(F.struct(F.lit(f).alias("family"), *(F.col(f"{k}_{f}").alias(k) for k in ("pdf", "h", "cdf"))) for f in _SHORT))
    return _kernel_means(wide.select("part", "n", F.inline(each)))


@query("copula_kernels_numpy", _kernel_oracle({n for n, _ in _GRID}))
def copula_kernels_numpy(spark, sf):
    """All families with an elementary form, from the numpy form of the kernels."""
    return _kernel_means(grouped.kernel_means(_points(spark, sf), [(n, _grid_params(n, t)) for n, t in _GRID]))


#: Two dependent values of a pair, so that every family has a tau within its range.
_TAU_PAIRS = f"SELECT g % 3 AS g, x, x + y AS y FROM ({PAIRS}) p1"
_CLIPS = [(n, -1.0 if FAMILIES[n].tau_range[1] <= 0 else 1.0, FAMILIES[n].clip_tau(-9), FAMILIES[n].clip_tau(9)) for n, _ in _GRID if n != "Prod"]


@query(
    "copula_tau",
    f"WITH p AS MATERIALIZED ({_TAU_PAIRS}), t AS MATERIALIZED (SELECT a.g, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) AS tau FROM p a JOIN p b ON a.g = b.g GROUP BY a.g) "
    + " UNION ALL ".join(f"SELECT g, '{n}' AS family, round(least(greatest({s!r} * tau, {lo!r}), {hi!r}), 6) AS tau, true AS reached FROM t" for n, s, lo, hi in _CLIPS),
)
def copula_tau(spark, sf):
    """Every family fitted to the tau of a third of the pairs, and whether its density has that
    tau: one less four times the integral of both conditionals."""
    pairs = lag_pairs(spark, sf).select((F.col("g") % 3).alias("g"), "x", (F.col("x") + F.col("y")).alias("y"))
    return _rounded(grouped.tau_reached(grouped.kendall(pairs), [c[:2] for c in _CLIPS], _EXTRA), 6, "tau")


_NU, _TAU = 4.0, 0.4
_ELL_Z = f"SELECT part, (l - {3.2!r}) / {1.3!r} AS x, (r - {3.2!r}) / {1.3!r} AS y FROM (SELECT series_id % 5 AS part, y AS l, lead(y) OVER (PARTITION BY series_id ORDER BY n) AS r FROM ({EV}) e0) q0 WHERE l IS NOT NULL AND r IS NOT NULL"


def _elliptical_sql() -> str:
    r = float(np.sin(np.pi * _TAU / 2))
    k = float(1 - r * r)
    gauss = f"-0.5 * ln({k!r}) - ({r * r!r} * (x * x + y * y) - {2 * r!r} * x * y) / {2 * k!r}"
    # gamma(3) gamma(2) / gamma(5/2)^2 = 32 / (9 pi)
    student = f"ln(32 / (9 * pi())) - 0.5 * ln({k!r}) - 3 * ln(1 + (x * x + y * y - {2 * r!r} * x * y) / {4 * k!r}) + 2.5 * (ln(1 + x * x / 4) + ln(1 + y * y / 4))"
    return f"WITH z AS MATERIALIZED ({_ELL_Z}) SELECT 'Gauss' AS family, part, count(*) AS n, round(avg({gauss}), 5) AS log_pdf FROM z GROUP BY part UNION ALL SELECT 'Student', part, count(*), round(avg({student}), 5) FROM z GROUP BY part"


@query("elliptical_kernels", _elliptical_sql())
def elliptical_kernels(spark, sf):
    """Gauss and Student densities at the probabilities of standardised neighbours."""
    s = events_series(spark, sf)
    z = s.select((F.col("series_id") % 5).alias("part"), F.col("y").alias("x"), F.lead("y").over(Window.partitionBy("series_id").orderBy("n")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    z = z.select("part", ((F.col("x") - 3.2) / 1.3).alias("x"), ((F.col("y") - 3.2) / 1.3).alias("y"))
    return _rounded(grouped.elliptical_means(z, _TAU, _NU), 5, "log_pdf")


_LAW = {"left": Margin("norm", {"loc": 25.5, "scale": 14.43}), "right": Margin("norm", {"loc": 35000.0, "scale": 22000.0})}


def _law_oracle() -> str:
    u, v = (oracle.normal_cdf(f"(({c} - {m.loc!r}) / {m.scale!r})") for c, m in (("l_quantity", _LAW["left"]), ("l_extendedprice", _LAW["right"])))
    a, b = (f"-0.5 * power(({c} - {m.loc!r}) / {m.scale!r}, 2) - {float(np.log(m.scale * np.sqrt(2 * np.pi)))!r}" for c, m in (("l_quantity", _LAW["left"]), ("l_extendedprice", _LAW["right"])))
    s = "(power(-ln(u), 2) + power(-ln(v), 2))"
    given = f"exp(-sqrt({s})) * power({s}, -0.5) * -ln(u) / u"  # the derivative of the joint distribution in u
    return f"SELECT l_returnflag, round(avg(ln({oracle.density('GH', 0.5, 'u', 'v')}) + a + b), 6) AS mean_log_pdf, round(avg({given}), 6) AS mean_conditional FROM (SELECT l_returnflag, {u} AS u, {v} AS v, {a} AS a, {b} AS b FROM lineitem) q GROUP BY l_returnflag"


@query("bivariate_law_lineitem", _law_oracle())
def bivariate_law_lineitem(spark, sf):
    """Joint log density and conditional law of quantity and price."""
    law = fitting.BivariateLaw(_LAW["left"], _LAW["right"], "GH", 0.5)
    d = law.over(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return d.groupBy("l_returnflag").agg(F.round(F.avg("log_pdf"), 6).alias("mean_log_pdf"), F.round(F.avg("conditional"), 6).alias("mean_conditional"))


_MARGINS = {"norm": Margin("norm", {"loc": 40.0, "scale": 30.0}), "expon": Margin("expon", {"scale": 49.0}), "logistic": Margin("logistic", {"loc": 40.0, "scale": 20.0}), "lognorm": Margin("lognorm", {"s": 1.2, "scale": 28.0}), "weibull_min": Margin("weibull_min", {"c": 1.1, "scale": 50.0}), "uniform": Margin("uniform", {"loc": 0.0, "scale": 600.0})}
_MARGIN_AGGS = {f"{k}_{part}": str(getattr(m, part)(Sql("value"))) for k, m in _MARGINS.items() for part in ("logpdf", "cdf")}
#: The same by their definitions.
_MARGIN_SQL = {
    "norm_logpdf": "-0.5 * power((value - 40) / 30, 2) - ln(30 * sqrt(2 * pi()))",
    "norm_cdf": oracle.normal_cdf("((value - 40) / 30)"),
    "expon_logpdf": "-value / 49 - ln(49)",
    "expon_cdf": "1 - exp(-value / 49)",
    "logistic_logpdf": "-(value - 40) / 20 - ln(20) - 2 * ln(1 + exp(-(value - 40) / 20))",
    "logistic_cdf": "1 / (1 + exp(-(value - 40) / 20))",
    "lognorm_logpdf": "-0.5 * power(ln(value / 28) / 1.2, 2) - ln(value * 1.2 * sqrt(2 * pi()))",
    "lognorm_cdf": oracle.normal_cdf("(ln(value / 28) / 1.2)"),
    "weibull_min_logpdf": "ln(1.1 / 50) + 0.1 * ln(value / 50) - power(value / 50, 1.1)",
    "weibull_min_cdf": "1 - exp(-power(value / 50, 1.1))",
    "uniform_logpdf": "CASE WHEN value <= 600 THEN -ln(600) ELSE -1e300 END",
    "uniform_cdf": "least(value / 600, 1)",
}


@query("margin_kernels", f"SELECT event_type, {', '.join(f'round(avg({s}), 6) AS {k}' for k, s in _MARGIN_SQL.items())} FROM events WHERE value > 0 GROUP BY event_type")
def margin_kernels(spark, sf):
    return table(spark, sf, "events").where("value > 0").groupBy("event_type").agg(*(F.round(F.avg(F.expr(s)), 6).alias(k) for k, s in _MARGIN_AGGS.items()))


# ------------------------------------------------------------------ fitting


@query("fit_best")
def fit_best(spark, sf):
    return grouped.fit_best(lag_pairs(spark, sf))


#: Log densities of three families at the rank-transformed pairs, written out.
_S = "(power(-ln(u), gh) + power(-ln(v), gh))"
_LOGS = f"""SELECT g, ln(1 + fgm * (1 - 2 * u) * (1 - 2 * v)) AS fgm, ln(1 + cl) - (1 + cl) * ln(u * v) - (2 + 1 / cl) * ln(power(u, -cl) + power(v, -cl) - 1) AS cl,
 -power({_S}, 1 / gh) - ln(u * v) + (gh - 1) * ln(ln(u) * ln(v)) + (2 / gh - 2) * ln({_S}) + ln(1 + (gh - 1) * power({_S}, -1 / gh)) AS gh
 FROM (SELECT r.g, u, v, {_theta('FGM')} AS fgm, {_theta('Clayton')} AS cl, {_theta('GH')} AS gh FROM ({RANKED}) r JOIN ({_tau_sql('1.0')}) t ON r.g = t.g) z"""
_CLOSED = (("FGM", "fgm"), ("Clayton", "cl"), ("GH", "gh"))


@query(
    "fit_best_closed",
    "SELECT g, row_number() OVER (PARTITION BY g ORDER BY log_lik DESC) AS place, family, round(log_lik, 4) AS log_lik FROM (" + " UNION ALL ".join(f"SELECT g, '{f}' AS family, sum({c}) AS log_lik FROM ({_LOGS}) l GROUP BY g" for f, c in _CLOSED) + ") q",
)
def fit_best_closed(spark, sf):
    """Families of closed form fitted by tau and ranked by likelihood."""
    got = grouped.fit_best(lag_pairs(spark, sf), tuple(f for f, _ in _CLOSED), criterion="mle")
    return got.select("g", F.col("place").cast("long").alias("place"), "family", F.round("log_lik", 4).alias("log_lik"))


def _vuong_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_CLOSED) for b in _CLOSED[i + 1 :]]
    return " UNION ALL ".join(f"SELECT g, '{a[0]}' AS a, '{b[0]}' AS b, round(sqrt(count(*)) * avg({a[1]} - {b[1]}) / stddev_pop({a[1]} - {b[1]}), 4) AS statistic FROM ({_LOGS}) l JOIN ({_tau_sql('1.0')}) t USING (g) WHERE tau > 0.02 GROUP BY g" for a, b in pairs)


@query("comparison_matrix", _vuong_sql())
def comparison_matrix(spark, sf):
    """Every pair of three families compared per group of positive dependence (at the edge of
    independence two of them are one)."""
    pairs = lag_pairs(spark, sf)
    some = pairs.join(grouped.kendall(pairs).where("tau > 0.02").select("g"), "g")
    got = selection.comparison_matrix(some, tuple(f for f, _ in _CLOSED), bandwidth=0)
    return got.select("g", "a", "b", F.round("statistic", 4).alias("statistic"))


@query("rosenblatt_transform", f"SELECT g, n, round(u, 6) AS e1, round(v * (1 + t * (1 - 2 * u) * (1 - v)), 6) AS e2 FROM (SELECT r.*, {_theta('FGM')} AS t FROM ({RANKED}) r JOIN ({_tau_sql('1.0')}) t ON r.g = t.g) q")
def rosenblatt_transform(spark, sf):
    return _rounded(inference.rosenblatt_transform(lag_pairs(spark, sf), "FGM"), 6, "e1", "e2")


@query("kolmogorov_distance", f"SELECT series_id, round(max(greatest(abs(k / m - p), abs(p - (k0 - 1) / m))), 6) AS distance FROM (SELECT series_id, {oracle.normal_cdf('((y - 3.2) / 1.3)')} AS p, CAST(rank() OVER (PARTITION BY series_id ORDER BY y) AS DOUBLE) AS k0, CAST(count(*) OVER (PARTITION BY series_id ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS k, CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS m FROM ({EV}) e) q GROUP BY series_id")
def kolmogorov_distance(spark, sf):
    return _rounded(selection.kolmogorov_distance(events_series(spark, sf), Margin("norm", {"loc": 3.2, "scale": 1.3})), 6, "distance")


_ROUNDS = 8


def _kmeans_sql() -> str:
    z = 0.674489750196081743  # the normal quantile of 0.75
    ctes = [f"e AS MATERIALIZED (SELECT y FROM ({EV}) e0)", f"c0 AS (SELECT avg(y) - {z!r} * stddev_pop(y) AS a, avg(y) + {z!r} * stddev_pop(y) AS b FROM e)"]
    for k in range(1, _ROUNDS + 1):
        ctes.append(f"c{k} AS (SELECT avg(CASE WHEN abs(y - a) <= abs(y - b) THEN y END) AS a, avg(CASE WHEN abs(y - a) > abs(y - b) THEN y END) AS b, avg(CASE WHEN abs(y - a) <= abs(y - b) THEN 1.0 ELSE 0 END) AS w FROM e CROSS JOIN c{k - 1})")
    return f"WITH {', '.join(ctes)} SELECT 0 AS cluster, round(a, 6) AS centre, round(w, 6) AS share FROM c{_ROUNDS} UNION ALL SELECT 1, round(b, 6), round(1 - w, 6) FROM c{_ROUNDS}"


@query("kmeans_centres", _kmeans_sql())
def kmeans_centres(spark, sf):
    """Lloyd's rounds for the start of an estimation."""
    got = selection.kmeans(events_series(spark, sf), 2, max_iter=_ROUNDS, tol=0.0)
    return spark.createDataFrame([(k, round(c, 6), round(w, 6)) for k, (c, _, w) in enumerate(got)], "cluster int, centre double, share double")


_STATE_MOMENTS = " UNION ALL ".join(f"SELECT {i} AS state, y, g{i} AS w FROM post JOIN rws USING (series_id, n)" for i in range(2))


@query(
    "margin_selection",
    f"""WITH RECURSIVE {oracle.smooth_sql(_IN, EV)}, s AS MATERIALIZED ({_STATE_MOMENTS}), m AS (SELECT state, sum(w * y) / sum(w) AS mu, sqrt(sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2)) AS sd FROM s GROUP BY state)
    SELECT s.state, 'norm' AS family, round(sum(w * (-0.5 * power((y - mu) / sd, 2) - ln(sd * sqrt(2 * pi())))), 3) AS log_lik FROM s JOIN m ON s.state = m.state GROUP BY s.state
    UNION ALL SELECT s.state, 'logistic', round(sum(w * (-(y - mu) / k - ln(k) - 2 * ln(1 + exp(-(y - mu) / k)))), 3) FROM s JOIN (SELECT *, sd * sqrt(3) / pi() AS k FROM m) m ON s.state = m.state GROUP BY s.state""",
)
def margin_selection(spark, sf):
    """Candidate families of the state margins, scored under the posteriors."""
    rows = events_series(spark, sf)
    gamma = series.classify(rows, _IN).select("series_id", "n", "gamma").join(rows, ["series_id", "n"])
    return _rounded(selection.margin_scores(gamma, 2).select("state", "family", "log_lik"), 3, "log_lik")


def _information_sql() -> str:
    """Standard errors of both state means by differences of the filter's likelihood."""
    h = [1e-3 * _IN.margin(i, 0).scale for i in range(2)]
    at = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    ctes = []
    for k, shift in enumerate(at):
        m = inference.moved(_IN, {("margin", (i,), "loc"): _IN.margin(i, 0).loc + shift[i] * h[i] for i in range(2)})
        ctes.append(f"(SELECT ll FROM ({oracle.log_lik_sql(m, EV)}) z{k}) AS l{k}")
    return f"""SELECT round(sqrt(-b / (a * b - c * c)), 4) AS se_0, round(sqrt(-a / (a * b - c * c)), 4) AS se_1 FROM (SELECT (l1 - 2 * l0 + l2) / {h[0] ** 2!r} AS a, (l3 - 2 * l0 + l4) / {h[1] ** 2!r} AS b, (l5 - l6 - l7 + l8) / {4 * h[0] * h[1]!r} AS c FROM (SELECT {', '.join(ctes)}) q) z"""


@query("chain_standard_errors", _information_sql())
def chain_standard_errors(spark, sf):
    """Observed information of the state means of a hidden chain."""
    got = inference.chain_standard_errors(events_series(spark, sf).where("y IS NOT NULL"), _IN, [("margin", (0,), "loc"), ("margin", (1,), "loc")])
    return spark.createDataFrame([tuple(round(float(x), 4) for x in got.se)], "se_0 double, se_1 double")


def _neighbours(y: np.ndarray) -> float:
    """The correlation of neighbours that are both there."""
    a, b = y[:-1], y[1:]
    both = np.isfinite(a) & np.isfinite(b)
    return float(np.corrcoef(a[both], b[both])[0, 1])


@query("parametric_bootstrap", f"SELECT series_id, round(corr(y, z), 6) AS observed FROM (SELECT series_id, y, lead(y) OVER (PARTITION BY series_id ORDER BY n) AS z FROM ({EV}) e) q GROUP BY series_id")
def parametric_bootstrap(spark, sf):
    """The correlation of neighbours in every series, tested against simulations of its length."""
    got = inference.bootstrap_series(events_series(spark, sf), models()["hmc_dn"], _neighbours, B=39)
    return got.where("p_value IS NULL OR p_value BETWEEN 1 / 40 AND 1").select("series_id", F.round("observed", 6).alias("observed"))


@query("vuong_clarke")
def vuong_clarke(spark, sf):
    return grouped.vuong(lag_pairs(spark, sf), "Gauss", "Frank")


@query("gof_bootstrap")
def gof_bootstrap(spark, sf):
    """Goodness of fit of a Gauss copula to customers' order counts and totals, per nation."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("o_totalprice").alias("y"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("g"))
    return grouped.gof_bootstrap(o.join(c, "c_custkey").select("g", "x", "y"), "Gauss")


@query("ice_hmc_dn")
def ice_hmc_dn(spark, sf):
    """Unsupervised estimation over all series: the trace of log-likelihoods."""
    rows = events_series(spark, sf).select("series_id", "n", "y")
    est = estimate.ice(rows, selection.kmeans_start(rows, models()["hmc_dn"]))
    return spark.createDataFrame([(t["iter"], float(t["log_lik"])) for t in est.trace], "iter int, log_lik double")


@query("sem_hmc_in")
def sem_hmc_in(spark, sf):
    est = estimate.sem(events_series(spark, sf), _IN)
    return spark.createDataFrame([(t["iter"], float(t["log_lik"])) for t in est.trace], "iter int, log_lik double")


@query(
    "m_step_margins",
    f"WITH RECURSIVE {oracle.smooth_sql(_IN, EV)} SELECT round(sum(g0 * y) / sum(g0), 6) AS mean_0, round(sum(g1 * y) / sum(g1), 6) AS mean_1, round(sqrt(sum(g0 * y * y) / sum(g0) - power(sum(g0 * y) / sum(g0), 2)), 5) AS sd_0, round(sqrt(sum(g1 * y * y) / sum(g1) - power(sum(g1 * y) / sum(g1), 2)), 5) AS sd_1 FROM post JOIN rws USING (series_id, n)",
)
def m_step_margins(spark, sf):
    """One estimation step of the state margins."""
    m = estimate.m_step(_IN, estimate.e_step(events_series(spark, sf), _IN, ()), ())
    row = [round(m.margins[(i,)].params[k], d) for k, d in (("loc", 6), ("scale", 5)) for i in range(2)]
    return spark.createDataFrame([tuple(row)], "mean_0 double, mean_1 double, sd_0 double, sd_1 double")


def _cdf_sql(samples: str) -> str:
    each = f"SELECT key, y, sum(w) AS w FROM ({samples}) s0 GROUP BY key, y"
    return f"SELECT key, round(y, 9) AS y, round(sum(w) OVER (PARTITION BY key ORDER BY y) / (sum(w) OVER (PARTITION BY key) + 1), 6) AS cdf FROM ({each}) e1"


@query("margin_cdfs_state", f"WITH RECURSIVE {oracle.smooth_sql(_IN, _MASKED)} " + _cdf_sql(" UNION ALL ".join(f"SELECT '{i}' AS key, r.y, g{i} AS w FROM post JOIN rws r USING (series_id, n) WHERE r.y IS NOT NULL" for i in range(2))))
def margin_cdfs_state(spark, sf):
    """Posterior-weighted distribution functions of the states' margins, over series with gaps."""
    return _rounded(_rounded(ecdf.margin_cdfs(_gapped(spark, sf), _IN), 9, "y"), 6, "cdf")


def _pair_cdf_sql(m: Model) -> str:
    w = {(i, j): f"f.b{i} * {oracle.step(m, i, j, 'f', 's')} * s.e{j}" for i in range(2) for j in range(2)}
    total = "(" + " + ".join(w.values()) + ")"
    xi = f"xi AS MATERIALIZED (SELECT f.series_id, f.n, {', '.join(f'{x} / {total} AS x{i}{j}' for (i, j), x in w.items())} FROM fwd f JOIN bwd s ON s.series_id = f.series_id AND s.n = f.n + 1)"
    both = [f"SELECT '{i},{j}' AS key, r.y, 0.5 * x{i}{j} AS w FROM xi JOIN rws r USING (series_id, n) UNION ALL SELECT '{i},{j}', r.y, 0.5 * x{j}{i} FROM xi JOIN rws r ON r.series_id = xi.series_id AND r.n = xi.n + 1" for i in range(2) for j in range(2)]
    return f"WITH RECURSIVE {oracle.smooth_sql(m, EV)}, {xi} " + _cdf_sql(" UNION ALL ".join(both)).replace(", 6) AS cdf", ", 5) AS cdf")


@query("margin_cdfs_pair", _pair_cdf_sql(models()["pmc_pair"]))
def margin_cdfs_pair(spark, sf):
    """The same for the pairwise chain, from both rows of every pair."""
    return _rounded(_rounded(ecdf.margin_cdfs(events_series(spark, sf), models()["pmc_pair"]), 9, "y"), 5, "cdf")


#: Margins whose quantiles are elementary, so that another engine can draw from them.
_LOGISTIC = Model("HMC-IN", _IN.p, {(i,): Margin("logistic", {"loc": m, "scale": s}) for i, (m, s) in enumerate(((2.4, 0.65), (3.9, 0.45)))})
_DRAWS = 3


def _draws_sql() -> str:
    """Paths drawn backwards from the filter, missing values from the drawn state's margin; then the
    moments of every completed table under its own posteriors, and their mean."""
    a = [[repr(float(_LOGISTIC.A[i, j])) for j in range(2)] for i in range(2)]
    u = [_U.format(f"'11', CAST(series_id AS VARCHAR), CAST(d AS VARCHAR), CAST(n AS VARCHAR), '{k}'") for k in range(2)]
    to = [f"f.b{i} * CASE WHEN s.x = 0 THEN {a[i][0]} ELSE {a[i][1]} END" for i in range(2)]
    quantile = f"CASE WHEN x = 0 THEN {_LOGISTIC.margin(0, 0).loc!r} ELSE {_LOGISTIC.margin(1, 0).loc!r} END + CASE WHEN x = 0 THEN {_LOGISTIC.margin(0, 0).scale!r} ELSE {_LOGISTIC.margin(1, 0).scale!r} END * ln(v / (1 - v))"
    paths = f"""{oracle.filter_sql(_LOGISTIC, _MASKED)}, us AS MATERIALIZED (SELECT f.*, d, {u[0]} AS u, {u[1]} AS v FROM fwd f CROSS JOIN range({_DRAWS}) g(d)),
    path AS (SELECT f.series_id, f.d, f.n, f.v, CASE WHEN f.u * (f.b0 + f.b1) < f.b0 THEN 0 ELSE 1 END AS x FROM us f JOIN (SELECT series_id, max(n) AS n FROM fwd GROUP BY series_id) m USING (series_id, n)
     UNION ALL SELECT f.series_id, f.d, f.n, f.v, CASE WHEN f.u * ({to[0]} + {to[1]}) < {to[0]} THEN 0 ELSE 1 END FROM path s JOIN us f ON f.series_id = s.series_id AND f.d = s.d AND f.n = s.n - 1),
    full_rows AS MATERIALIZED (SELECT CAST(p.series_id AS VARCHAR) || ':' || CAST(p.d AS VARCHAR) AS series_id, p.n, p.d, coalesce(r.y, {quantile}) AS y FROM path p JOIN rws r ON r.series_id = p.series_id AND r.n = p.n)"""
    second = oracle.smooth_sql(_LOGISTIC, "SELECT * FROM full_rows")
    for name in ("rws", "fwd", "bwd", "post"):
        second = re.sub(rf"\b{name}\b", f"{name}_2", second)
    sums = ", ".join(f"sum(g{i} * y) / sum(g{i}) AS m{i}, sqrt(sum(g{i} * y * y) / sum(g{i}) - power(sum(g{i} * y) / sum(g{i}), 2)) AS s{i}" for i in range(2))
    return f"WITH RECURSIVE {paths}, {second}, each AS (SELECT d, {sums} FROM post_2 JOIN rws_2 USING (series_id, n) GROUP BY d) SELECT " + ", ".join(f"round(avg(m{i}), 4) AS loc_{i}, round(avg(s{i}) * sqrt(3) / pi(), 4) AS scale_{i}" for i in range(2)) + " FROM each"


@query("m_step_draws", _draws_sql())
def m_step_draws(spark, sf):
    """One estimation step on draws of the missing rows: an M-step per draw, parameters averaged."""
    s = estimate.e_step(_gapped(spark, sf), _LOGISTIC, (), draws=_DRAWS, seed=11)
    m = estimate.m_step_draws(_LOGISTIC, s, _DRAWS, ())
    row = {f"{k}_{i}": round(m.margins[(i,)].params[k], 4) for i in range(2) for k in ("loc", "scale")}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


# ------------------------------------------------------------------ simulation and images


@query("simulate_series", f"SELECT series_id, count(*) AS rows, CAST(max(n) AS BIGINT) AS last_n, true AS states_known FROM ({EV}) e GROUP BY series_id")
def simulate_series(spark, sf):
    """A simulated series beside every given one, of its length."""
    d = series.simulate_like(events_series(spark, sf), models()["pmc_pair"], seed=1)
    return d.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("last_n"), F.min(F.col("x").isin(0, 1) & F.col("y").isNotNull()).alias("states_known"))


@query("sample_posterior")
def sample_posterior(spark, sf):
    return series.sample_posterior(_gapped(spark, sf), models()["hmc_dn"], seed=3)


#: Every vector of 64 components is an image of 8 x 8, row by row.
_SIDE = 8
_CELLS = f"SELECT vec_id AS image_id, CAST(k // {_SIDE} AS INTEGER) AS \"row\", CAST(k % {_SIDE} AS INTEGER) AS col, CAST(embedding[k + 1] AS DOUBLE) AS y FROM embeddings CROSS JOIN range({_SIDE * _SIDE}) t(k)"
_ON_CURVE, _PLACE = oracle.hilbert(_SIDE, '"row"', "col")
_PIXELS = f"SELECT image_id AS series_id, {_PLACE} AS n, \"row\", col, y FROM ({_ON_CURVE.format(_CELLS)}) c"
_REGIONS = gaussian("HMC-IN", [-0.06, 0.06], [0.11, 0.11], stay=0.8)


def _images(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "y"))
    return e.select("image_id", F.floor(F.col("k") / _SIDE).cast("int").alias("row"), (F.col("k") % _SIDE).cast("int").alias("col"), F.col("y").cast("double").alias("y"))


@query("image_path", f'SELECT series_id AS image_id, n, "row", col, round(y, 6) AS y FROM ({_PIXELS}) x')
def image_path(spark, sf):
    """Where every pixel comes on the curve: unfolded, and folded back."""
    px = _images(spark, sf)
    back = image.fold(image.unfold(px, _SIDE, _SIDE), _SIDE, _SIDE)
    return back.select("image_id", image.place(_SIDE, _SIDE).alias("n"), "row", "col", F.round("y", 6).alias("y"))


@query("classify_image", f"WITH RECURSIVE {oracle.smooth_sql(_REGIONS, _PIXELS)} SELECT p.series_id AS image_id, r.\"row\", r.col, round(g0, 5) AS gamma_0 FROM post p JOIN rws r ON r.series_id = p.series_id AND r.n = p.n")
def classify_image(spark, sf):
    """Pixels labelled along the curve."""
    got = image.classify_image(_images(spark, sf), _REGIONS, _SIDE, _SIDE)
    return got.select("image_id", "row", "col", F.round(F.col("gamma")[0], 5).alias("gamma_0"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
