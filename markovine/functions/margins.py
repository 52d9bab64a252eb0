"""Margin distributions: density, distribution function, quantile, moments fit.

``norm``, ``expon``, ``uniform``, ``logistic``, ``lognorm`` and ``weibull_min`` are
written with ``ops`` and so also run as SQL text; the others need incomplete gamma or
beta functions and run in numpy only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from . import numerics
from . import ops


@dataclass(frozen=True)
class Margin:
    """``dist`` with shape parameters, ``loc`` and ``scale``."""

    dist: str
    params: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.dist not in DISTS:
            raise ValueError(f"unknown margin family {self.dist!r}")

    @property
    def loc(self) -> float:
        return self.params.get("loc", 0.0)

    @property
    def scale(self) -> float:
        return self.params.get("scale", 1.0)

    def logpdf(self, y):
        return DISTS[self.dist][0]((y - self.loc) / self.scale, self.params) - math.log(self.scale)

    def pdf(self, y):
        with np.errstate(all="ignore"):
            out = ops.exp(self.logpdf(y))
        return out if isinstance(out, ops.Sql) else np.nan_to_num(out)

    def cdf(self, y):
        return DISTS[self.dist][1]((y - self.loc) / self.scale, self.params)

    def ppf(self, q):
        """Quantile: closed form for the normal, bisection on a compact scale otherwise."""
        q = np.clip(np.asarray(q, float), 1e-15, 1 - 1e-15)
        if self.dist == "norm":
            return self.loc + self.scale * ops.norm_ppf(q)
        lo, hi = DISTS[self.dist][2]
        if np.isfinite(hi):
            z = numerics.invert(lambda t: DISTS[self.dist][1](t, self.params), q, lo, hi)
        elif np.isfinite(lo):
            x = numerics.invert(lambda t: DISTS[self.dist][1](t / (1 - t), self.params), q, 1e-15, 1 - 1e-15)
            z = x / (1 - x)
        else:
            x = numerics.invert(lambda t: DISTS[self.dist][1](np.tan(np.pi * (t - 0.5)), self.params), q, 1e-12, 1 - 1e-12)
            z = np.tan(np.pi * (x - 0.5))
        return self.loc + self.scale * z

    def moments(self) -> tuple[float, float]:
        """Mean and standard deviation, by quadrature over the quantile function."""
        if self.dist == "norm":
            return self.loc, self.scale
        t, w = numerics.gauss_legendre(200)
        y = self.ppf(t)
        m = float((w * y).sum())
        return m, math.sqrt(max(float((w * (y - m) ** 2).sum()), 0.0))


def _positive(f):
    """A log density that is minus infinity outside the positive half line."""

    def apply(z, p):
        if isinstance(z, ops.Sql):
            return ops.where(z > 0.0, f(ops.maximum(z, 1e-300), p), -1e300)
        with np.errstate(all="ignore"):
            return np.where(z > 0, f(np.maximum(z, 1e-300), p), -np.inf)

    return apply


def _positive_cdf(f):
    def apply(z, p):
        if isinstance(z, ops.Sql):
            return ops.where(z > 0.0, f(ops.maximum(z, 1e-300), p), 0.0)
        return np.where(z > 0, f(np.maximum(z, 1e-300), p), 0.0)

    return apply


def _lbeta(a, b):
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


_HALF, _LINE, _UNIT = (0.0, math.inf), (-math.inf, math.inf), (0.0, 1.0)
DISTS = {
    "norm": (lambda z, p: ops.norm_logpdf(z), lambda z, p: ops.norm_cdf(z), _LINE),
    "expon": (_positive(lambda z, p: -z), _positive_cdf(lambda z, p: 1.0 - ops.exp(-z)), _HALF),
    "uniform": (lambda z, p: ops.where(ops.absolute(z - 0.5) <= 0.5, 0.0 * z, -1e300), lambda z, p: ops.minimum(ops.maximum(z, 0.0), 1.0), _UNIT),
    "logistic": (lambda z, p: -ops.absolute(z) - 2.0 * ops.log1p(ops.exp(-ops.absolute(z))), lambda z, p: 1.0 / (1.0 + ops.exp(-z)), _LINE),
    "lognorm": (_positive(lambda z, p: ops.norm_logpdf(ops.log(z) / p["s"]) - ops.log(z) - math.log(p["s"])), _positive_cdf(lambda z, p: ops.norm_cdf(ops.log(z) / p["s"])), _HALF),
    "weibull_min": (_positive(lambda z, p: math.log(p["c"]) + (p["c"] - 1.0) * ops.log(z) - z ** p["c"]), _positive_cdf(lambda z, p: 1.0 - ops.exp(-(z ** p["c"]))), _HALF),
    "gamma": (_positive(lambda z, p: (p["a"] - 1.0) * np.log(z) - z - math.lgamma(p["a"])), _positive_cdf(lambda z, p: numerics.gammainc(p["a"], z)), _HALF),
    "invgamma": (_positive(lambda z, p: -(p["a"] + 1.0) * np.log(z) - 1.0 / z - math.lgamma(p["a"])), _positive_cdf(lambda z, p: 1.0 - numerics.gammainc(p["a"], 1.0 / z)), _HALF),
    "beta": (
        lambda z, p: np.where((z > 0) & (z < 1), (p["a"] - 1) * np.log(np.clip(z, 1e-300, None)) + (p["b"] - 1) * np.log1p(-np.clip(z, None, 1 - 1e-16)) - _lbeta(p["a"], p["b"]), -np.inf),
        lambda z, p: numerics.betainc(p["a"], p["b"], z),
        _UNIT,
    ),
    "betaprime": (_positive(lambda z, p: (p["a"] - 1) * np.log(z) - (p["a"] + p["b"]) * np.log1p(z) - _lbeta(p["a"], p["b"])), _positive_cdf(lambda z, p: numerics.betainc(p["a"], p["b"], z / (1 + z))), _HALF),
    "t": (lambda z, p: numerics.t_logpdf(z, p["df"]), lambda z, p: numerics.t_cdf(z, p["df"]), _LINE),
}


def fit_moments(dist: str, mean: float, var: float, params: dict[str, float] | None = None) -> Margin:
    """A margin with the given mean and variance (``loc`` of ``params`` is kept where the
    family lives on a half line)."""
    old = dict(params or {})
    loc = old.get("loc", 0.0)
    sd = math.sqrt(max(var, 1e-12))
    m = max(mean - loc, 1e-9)
    if dist == "norm":
        return Margin("norm", {"loc": mean, "scale": sd})
    if dist == "logistic":
        return Margin("logistic", {"loc": mean, "scale": sd * math.sqrt(3) / math.pi})
    if dist == "uniform":
        return Margin("uniform", {"loc": mean - sd * math.sqrt(3), "scale": 2 * sd * math.sqrt(3)})
    if dist == "expon":
        return Margin("expon", {"loc": loc, "scale": m})
    if dist == "gamma":
        return Margin("gamma", {"a": m * m / sd**2, "loc": loc, "scale": sd**2 / m})
    if dist == "lognorm":
        s2 = math.log1p(sd**2 / m**2)
        return Margin("lognorm", {"s": math.sqrt(s2), "loc": loc, "scale": m * math.exp(-s2 / 2)})
    if dist == "weibull_min":
        cv = lambda c: math.exp(math.lgamma(1 + 2 / c) - 2 * math.lgamma(1 + 1 / c)) - 1
        lo, hi = 0.1, 50.0
        for _ in range(80):
            mid = 0.5 * (lo + hi)
            lo, hi = (mid, hi) if cv(mid) > sd**2 / m**2 else (lo, mid)
        return Margin("weibull_min", {"c": lo, "loc": loc, "scale": m / math.exp(math.lgamma(1 + 1 / lo))})
    if dist == "invgamma":
        a = 2 + m * m / sd**2
        return Margin("invgamma", {"a": a, "loc": loc, "scale": m * (a - 1)})
    if dist == "t":
        df = max(old.get("df", 5.0), 2.1)
        return Margin("t", {"df": df, "loc": mean, "scale": sd * math.sqrt((df - 2) / df)})
    if dist in ("beta", "betaprime"):
        scale = old.get("scale", 1.0)
        m, v = m / scale, sd**2 / scale**2
        if dist == "beta":
            k = max(m * (1 - m) / v - 1, 1e-3)
            return Margin("beta", {"a": max(m * k, 1e-3), "b": max((1 - m) * k, 1e-3), "loc": loc, "scale": scale})
        b = 2 + m * (m + 1) / v
        return Margin("betaprime", {"a": m * (b - 1), "b": b, "loc": loc, "scale": scale})
    raise ValueError(f"no moment fit for {dist!r}")


def mvn_logpdf(y: np.ndarray, mean, cov) -> np.ndarray:
    """Log density of a multivariate normal; singular covariances use the pseudo-inverse."""
    cov = np.atleast_2d(np.asarray(cov, float))
    w, v = np.linalg.eigh(cov)
    live = w > 1e-12 * w.max()
    z = (np.asarray(y, float) - np.asarray(mean, float)) @ v[:, live] / np.sqrt(w[live])
    return -0.5 * (z * z).sum(axis=1) - 0.5 * (np.log(w[live]).sum() + live.sum() * math.log(2 * math.pi))
