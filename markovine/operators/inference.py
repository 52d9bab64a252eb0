"""Inference on fitted chains and copulas: standard errors, bootstrap, transforms.

A chain's information is found by differences of the log-likelihood: all models around the
fitted one are evaluated in one pass over the series, and only a row per model leaves the
cluster.  The same pass gives each series' score, whose products are the middle of the
sandwich.  Bootstrap replicates are rows of a table, one task row each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.copulas import FAMILIES
from ..functions.margins import Margin
from ..plans.model import Model
from . import fit as fitting
from . import stats
from .engine import Batch, simulate, simulate_many
from .grouped import _xy, per_group
from .series import in_batches, rng_of

#: What can be moved: ``(kind, key, name)``, the name being a margin's parameter or ``tau``.
Parameter = tuple[str, tuple[int, ...], str]


def parameters(model: Model) -> list[Parameter]:
    """Location and scale of every margin, and tau of every copula that depends."""
    out: list[Parameter] = [("margin", k, name) for k, m in sorted(model.margins.items()) for name in ("loc", "scale") if name in m.params]
    return out + [("copula", k, "tau") for k, c in sorted(model.copulas.items()) if not c.family.independent]


def value(model: Model, p: Parameter) -> float:
    kind, key, name = p
    return model.margins[key].params[name] if kind == "margin" else model.copulas[key].tau


def moved(model: Model, changes: dict[Parameter, float]) -> Model:
    margins, copulas = dict(model.margins), dict(model.copulas)
    for (kind, key, name), x in changes.items():
        if kind == "margin":
            margins[key] = Margin(margins[key].dist, {**margins[key].params, name: x})
        else:
            copulas[key] = replace(copulas[key], tau=copulas[key].family.clip_tau(x))
    return replace(model, margins=margins, copulas=copulas)


@dataclass
class StandardErrors:
    """Estimates with their covariances: by the observed information, and by the sandwich of
    information and score products, which holds under a wrong model too."""

    names: list[Parameter]
    estimates: np.ndarray
    hessian: np.ndarray
    scores: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return np.linalg.pinv(-self.hessian)

    @property
    def sandwich(self) -> np.ndarray:
        return self.covariance @ self.scores @ self.covariance

    @staticmethod
    def _root(c: np.ndarray) -> np.ndarray:
        d = np.diag(c)
        return np.sqrt(np.where(d > 0, d, np.nan))

    @property
    def se(self) -> np.ndarray:
        return self._root(self.covariance)

    @property
    def robust(self) -> np.ndarray:
        return self._root(self.sandwich)

    def ci(self, level: float = 0.95, robust: bool = False) -> list[tuple[float, float]]:
        from ..functions.ops import norm_ppf

        z = float(norm_ppf(np.array(0.5 + level / 2)))
        return [(float(m - z * s), float(m + z * s)) for m, s in zip(self.estimates, self.robust if robust else self.se, strict=True)]


def chain_standard_errors(df: DataFrame, model: Model, names: list[Parameter] | None = None, step: float = 1e-3) -> StandardErrors:
    """Standard errors of chain parameters from the series' exact log-likelihoods."""
    names = parameters(model) if names is None else names
    at = np.array([value(model, p) for p in names])
    k = len(names)
    h = np.array([step * max(abs(model.margins[p[1]].scale), 1e-6) if p[0] == "margin" else step for p in names])
    shifts: list[tuple[int, ...]] = [()]
    shifts += [(s * (i + 1),) for i in range(k) for s in (1, -1)]
    shifts += [(s * (i + 1), t * (j + 1)) for i in range(k) for j in range(i) for s in (1, -1) for t in (1, -1)]

    def at_shift(shift: tuple[int, ...]) -> Model:
        return moved(model, {names[abs(s) - 1]: float(at[abs(s) - 1] + np.sign(s) * h[abs(s) - 1]) for s in shift})

    models = [at_shift(s) for s in shifts]

    def batch(pdf: pd.DataFrame, b: Batch) -> pd.DataFrame:
        ll = np.array([Batch(m, b.y, b.sizes, masked=b.masked).log_liks() for m in models])  # models x series
        # a series' score is what its two shifts differ by
        score = (ll[1 : 2 * k + 1 : 2] - ll[2 : 2 * k + 1 : 2]) / (2 * h[:, None])
        rows = [(-1 - m, float(x)) for m, x in enumerate(ll.sum(axis=1))]
        rows += [(i * k + j, float(x)) for (i, j), x in np.ndenumerate(score @ score.T)]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "what": [a for a, _ in rows], "v": [x for _, x in rows]})

    got = in_batches(df, model, batch, "what int, v double").groupBy("what").agg(F.sum("v").alias("v")).collect()  # a row per model and pair
    sums = {r["what"]: r["v"] for r in got}
    ll = {s: sums[-1 - m] for m, s in enumerate(shifts)}
    hess = np.empty((k, k))
    for i in range(k):
        hess[i, i] = (ll[(i + 1,)] - 2 * ll[()] + ll[(-i - 1,)]) / h[i] ** 2
        for j in range(i):
            f = {(s, t): ll[(s * (i + 1), t * (j + 1))] for s in (1, -1) for t in (1, -1)}
            hess[i, j] = hess[j, i] = (f[1, 1] - f[1, -1] - f[-1, 1] + f[-1, -1]) / (4 * h[i] * h[j])
    scores = np.array([[sums[i * k + j] for j in range(k)] for i in range(k)]).reshape(k, k)
    return StandardErrors(names, at, hess, scores)


def parametric_bootstrap(spark, model: Model, statistic: Callable[[np.ndarray, np.ndarray], float], n: int, B: int = 199, seed: int = 0) -> DataFrame:
    """``b, value`` of any statistic of simulated states and observations, a task row each."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"b": pdf["id"], "value": [float(statistic(*simulate(model, n, rng_of(seed, b)))) for b in pdf["id"]]})

    return spark.range(B).mapInPandas(run, "b long, value double")


#: Rows of simulated series that a task holds.
DRAWN = 1 << 20


def bootstrap_series(df: DataFrame, model: Model, statistic: Callable[[np.ndarray], float], B: int = 199, seed: int = 0) -> DataFrame:
    """``observed, p_value`` of a statistic of each series, two-sided against ``B`` simulated
    series of the same length, of which the same rows are missing (NaN); the draws depend on the seed and
    the series alone.  The p-value of a series without a number is none, replicates without one do not count."""

    def batch(pdf: pd.DataFrame, b: Batch) -> pd.DataFrame:
        own = pdf["series_id"].to_numpy()[b.starts]
        observed = np.array([float(statistic(b.y[i : i + n])) for i, n in zip(b.starts, b.sizes, strict=True)])
        above, below, counted = np.zeros((3, len(own)), int)
        together = max(1, DRAWN // max(b.N, 1))  # replicates that are drawn at once
        for first in range(0, B, together):
            some = range(first, min(first + together, B))
            sizes = np.tile(b.sizes, len(some))
            y = simulate_many(model, sizes, [rng_of(seed, f"{s}:{r}") for r in some for s in own])[1]
            y[np.tile(b.miss, len(some))] = np.nan
            stops = np.cumsum(sizes)
            t = np.array([statistic(y[c - n : c]) for c, n in zip(stops, sizes, strict=True)]).reshape(len(some), -1)
            above += (t >= observed).sum(axis=0)
            below += (t <= observed).sum(axis=0)
            counted += np.isfinite(t).sum(axis=0)
        p = np.where(np.isfinite(observed), np.minimum(1.0, 2 * (1 + np.minimum(above, below)) / (1 + counted)), np.nan)
        return pd.DataFrame({"series_id": own, "observed": observed, "p_value": p})

    return in_batches(df, model, batch, "observed double, p_value double")


def bootstrap_interval(draws: DataFrame, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of ``value``; replicates without a number do not count."""
    ok = draws.where("value IS NOT NULL AND NOT isnan(value)")
    lo, hi = ok.agg(F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))).first()[0]
    return float(lo), float(hi)


def rosenblatt_transform(df: DataFrame, family: str, method: str = "tau") -> DataFrame:
    """``n, e1, e2``: pseudo-observations made independent by the fitted family."""

    def one(pdf):
        u, v = stats.pseudo_observations(*_xy(pdf))
        f = FAMILIES[family]
        e = f.h(v, u, fitting.fit(family, u, v, method).params)
        return [{"n": int(n), "e1": float(a), "e2": float(b)} for n, a, b in zip(pdf["n"], u, e, strict=True)]

    return per_group(df, one, "n long, e1 double, e2 double")


def rosenblatt_bootstrap(df: DataFrame, family: str, B: int = 99, seed: int = 0) -> DataFrame:
    """``statistic, p_value`` per group: the transform's distance from independence against
    replicates of the fitted family, refitted."""
    f = FAMILIES[family]

    def distance(u, v) -> float:
        return stats.rosenblatt_statistic(u, f.h(v, u, fitting.fit(family, u, v).params))

    def one(pdf):
        u, v = stats.pseudo_observations(*_xy(pdf))
        rng = rng_of(seed, pdf["g"].iloc[0])
        fitted, stat = fitting.fit(family, u, v).params, distance(u, v)
        over = 0
        for _ in range(B):
            a, b = f.sample(rng.random(len(u)), rng.random(len(u)), fitted)
            over += distance(*stats.pseudo_observations(a, b)) >= stat
        return {"statistic": stat, "p_value": (1 + over) / (1 + B)}

    return per_group(df, one, "statistic double, p_value double")
