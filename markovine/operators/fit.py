"""Fitting copula families and joint laws to samples, with selection and inference."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.copulas import DEFAULT_CANDIDATES, EXTRA_BOUNDS, FAMILIES, CopulaNotAvailableError, Family
from ..functions.margins import Margin, fit_moments
from ..functions.ops import Sql, clamp
from . import stats


def weights_of(w, n: int) -> np.ndarray:
    """Frequency weights: finite, not negative, not all zero."""
    if w is None:
        return np.ones(n)
    w = np.asarray(w, float)
    if w.shape != (n,) or not np.isfinite(w).all() or (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be finite, not negative and sum to more than 0")
    return w


def log_likelihood(f: Family, params: dict, u, v, w=None) -> float:
    """Sum of w log c; rows of weight 0 do not count."""
    w = weights_of(w, len(u))
    z = f.log_pdf(u, v, params)
    z = z[w > 0]
    return float((w[w > 0] * z).sum()) if np.isfinite(z).all() else -math.inf


@dataclass(frozen=True)
class Fit:
    """A fitted family."""

    family: str
    tau: float
    extras: dict[str, float] = field(default_factory=dict)
    log_lik: float = math.nan
    n_eff: float = math.nan
    method: str = "tau"

    @property
    def k(self) -> int:
        return FAMILIES[self.family].n_params

    @property
    def params(self) -> dict[str, float]:
        return FAMILIES[self.family].params(self.tau, self.extras)

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.log_lik

    @property
    def bic(self) -> float:
        return self.k * math.log(max(self.n_eff, 1)) - 2 * self.log_lik

    @property
    def aicc(self) -> float:
        d = self.n_eff - self.k - 1
        return self.aic + 2 * self.k * (self.k + 1) / d if d > 0 else math.inf

    @property
    def hqc(self) -> float:
        return 2 * self.k * math.log(max(math.log(max(self.n_eff, 3)), 1e-9)) - 2 * self.log_lik


def fit(family: str, u, v, method: str = "tau", w=None, tau: float | None = None) -> Fit:
    """``tau``: inversion of the sample tau (extras profiled by likelihood), which may be given;
    ``mle``: maximum pseudo-likelihood in all parameters."""
    f, w = FAMILIES[family], weights_of(w, len(u))
    if f.independent:
        return Fit(family, 0.0, {}, 0.0, float(w.sum()), method)
    lo, hi = f.tau_range
    tau = f.clip_tau(stats.kendall_tau(u, v, w) if tau is None else tau)

    def loss(t, e) -> float:
        try:
            ll = log_likelihood(f, f.params(f.clip_tau(t), e), u, v, w)
        except ValueError:
            return 1e12
        return -ll if math.isfinite(ll) else 1e12

    if not f.extras:
        if method == "mle":
            pad = 0.01 * (hi - lo)
            tau, _ = numerics.golden(lambda t: loss(t, {}), max(lo + pad, tau - 0.4), min(hi - pad, tau + 0.4), 1e-6)
        return Fit(family, tau, {}, log_likelihood(f, f.params(tau), u, v, w), float(w.sum()), method)
    box = np.array([EXTRA_BOUNDS[k][:2] for k in f.extras])
    start = np.array([EXTRA_BOUNDS[k][2] for k in f.extras])

    def inside(x):
        return {k: float(np.clip(a, *b)) for k, a, b in zip(f.extras, x, box, strict=True)}

    if method == "mle":
        best, _ = numerics.nelder_mead(lambda x: loss(x[0], inside(x[1:])), [tau, *start], [0.05, *(0.1 * (box[:, 1] - box[:, 0]))], 1e-7, 150)
        tau, extras = f.clip_tau(float(best[0])), inside(best[1:])
    else:
        best, _ = numerics.nelder_mead(lambda x: loss(tau, inside(x)), start, 0.1 * (box[:, 1] - box[:, 0]), 1e-7, 80)
        extras = inside(best)
    try:
        ll = log_likelihood(f, f.params(tau, extras), u, v, w)
    except ValueError:
        ll = -math.inf
    return Fit(family, tau, extras, ll, float(w.sum()), method)


def score(c: str, f: Fit, u, v, w=None) -> float:
    """Selection score, higher is better: mle, aic, bic, cvm, huard or xvcic."""
    w = weights_of(w, len(u))
    if c == "mle":
        return f.log_lik
    if c in ("aic", "bic"):
        return -(f.aic if c == "aic" else f.bic)
    fam = FAMILIES[f.family]
    if c == "cvm":
        try:
            model = fam.cdf(u, v, f.params)
        except CopulaNotAvailableError:
            return -math.inf
        return -float((w / w.sum() * (stats.empirical_copula(u, v, u, v, w) - model) ** 2).sum())
    if c == "huard":  # log of the mean likelihood over the family's tau range
        if fam.independent:
            return 0.0
        lo, hi = fam.tau_range
        taus = np.linspace(lo + 0.01 * (hi - lo), hi - 0.01 * (hi - lo), 50)
        ll = np.array([log_likelihood(fam, fam.params(t, f.extras), u, v, w) for t in taus])
        top = ll.max()
        return float(top + math.log(np.exp(ll - top).mean())) if math.isfinite(top) else -math.inf
    if c == "xvcic":  # contiguous folds of equal weight, one neighbour purged
        cum = np.cumsum(w)
        fold = np.minimum((5 * (cum - w / 2) / cum[-1]).astype(int), 4)
        total = 0.0
        for k in range(5):
            out = fold == k
            near = out | np.roll(out, 1) | np.roll(out, -1)
            if out.any() and (~near).sum() > 5:
                g = fit(f.family, u[~near], v[~near], "tau", w[~near])
                total += log_likelihood(fam, g.params, u[out], v[out], w[out])
        return total
    raise ValueError(f"unknown criterion {c!r}")


def fit_best(u, v, families=DEFAULT_CANDIDATES, method: str = "tau", w=None, criterion: str = "aic") -> list[Fit]:
    """All families fitted, best first; failures are left out."""
    found, tau = [], stats.kendall_tau(u, v, weights_of(w, len(u)))
    for name in families:
        try:
            g = fit(name, u, v, method, w, tau)
            found.append((score(criterion, g, u, v, w), g))
        except (ValueError, CopulaNotAvailableError):
            continue
    return [g for s, g in sorted(found, key=lambda x: -x[0]) if math.isfinite(s)]


def standard_error(f: Fit, u, v, w=None) -> float:
    """Sandwich standard error of tau for fixed extras."""
    w, fam, h = weights_of(w, len(u)), FAMILIES[f.family], 1e-4
    l0, lp, lm = (fam.log_pdf(u, v, fam.params(fam.clip_tau(f.tau + s), f.extras)) for s in (0, h, -h))
    g, hess = (lp - lm) / (2 * h), (lp - 2 * l0 + lm) / h**2
    bread = -(w * hess).sum()
    return math.sqrt((w * g * g).sum()) / bread if bread > 0 else math.nan


def independence_lr_test(f: Fit) -> tuple[float, float]:
    stat = max(2 * f.log_lik, 0.0)
    return stat, numerics.chi2_sf(stat, f.k) if stat > 0 else 1.0


def bootstrap_ci(family: str, u, v, B: int = 500, alpha: float = 0.05, seed: int = 0, method: str = "tau") -> tuple[float, float]:
    """Percentile interval of tau by resampling rows."""
    rng = np.random.default_rng(seed)
    taus = []
    for _ in range(B):
        i = rng.integers(0, len(u), len(u))
        try:
            taus.append(fit(family, *stats.pseudo_observations(u[i], v[i]), method).tau)
        except ValueError:
            continue
    if len(taus) < 10:
        raise ValueError("fewer than 10 valid replicates")
    return tuple(np.quantile(taus, [alpha / 2, 1 - alpha / 2]).tolist())


def gof_replicate(family: str, tau: float, extras: dict, n: int, seed: int, method: str = "tau") -> float:
    """One parametric bootstrap replicate of the CvM statistic, refitted."""
    rng = np.random.default_rng(seed)
    f = FAMILIES[family]
    u, v = f.sample(rng.random(n), rng.random(n), f.params(tau, extras))
    u, v = stats.pseudo_observations(u, v)
    g = fit(family, u, v, method)
    return stats.cvm_statistic(u, v, lambda a, b: f.cdf(a, b, g.params))


def cv_loglik(family: str, u, v, K: int = 5, seed: int = 0, method: str = "tau") -> float:
    fold = np.random.default_rng(seed).permutation(len(u)) % K
    total = 0.0
    for k in range(K):
        g = fit(family, u[fold != k], v[fold != k], method)
        total += log_likelihood(FAMILIES[family], g.params, u[fold == k], v[fold == k])
    return total


def dpd_fit(family: str, u, v, alpha: float = 0.3, w=None) -> float:
    """Density-power-divergence estimate of tau (robust to outliers)."""
    f, w = FAMILIES[family], weights_of(w, len(u))
    x, q = numerics.gauss_legendre(48)
    gu, gv = np.meshgrid(x, x)
    gw = np.outer(q, q)

    def loss(t: float) -> float:
        p = f.params(t)
        power = (np.exp((1 + alpha) * f.log_pdf(gu, gv, p)) * gw).sum()
        return float(power - (1 + 1 / alpha) * (w * np.exp(alpha * f.log_pdf(u, v, p))).sum() / w.sum())

    lo, hi = f.tau_range
    pad = 0.02 * (hi - lo)
    return numerics.golden(loss, lo + pad, hi - pad, 1e-5)[0]


class EmpiricalBeta:
    """The empirical beta copula of a sample."""

    def __init__(self, x, y):
        self.n = len(x)
        self.r = [np.argsort(np.argsort(z, kind="stable"), kind="stable") + 1 for z in (x, y)]

    def _beta(self, rank, t):
        return np.array([numerics.betainc(a, self.n + 1 - a, t) for a in rank])

    def cdf(self, u, v):
        return (self._beta(self.r[0], u) * self._beta(self.r[1], v)).mean(axis=0)

    def pdf(self, u, v):
        def dens(rank, t):
            a = rank[:, None].astype(float)
            b = self.n + 1 - a
            return np.exp(numerics.lgamma(a + b) - numerics.lgamma(a) - numerics.lgamma(b) + (a - 1) * np.log(t) + (b - 1) * np.log1p(-t))

        return (dens(self.r[0], np.asarray(u)) * dens(self.r[1], np.asarray(v))).mean(axis=0)


@dataclass(frozen=True)
class BivariateLaw:
    """A copula with two margins."""

    left: Margin
    right: Margin
    family: str
    tau: float
    extras: dict[str, float] = field(default_factory=dict)

    def _f(self):
        f = FAMILIES[self.family]
        return f, f.params(self.tau, self.extras)

    def log_pdf(self, x, y):
        f, p = self._f()
        return f.log_pdf(self.left.cdf(x), self.right.cdf(y), p) + self.left.logpdf(x) + self.right.logpdf(y)

    def cdf(self, x, y):
        f, p = self._f()
        return f.cdf(self.left.cdf(x), self.right.cdf(y), p)

    def conditional_cdf(self, y, x):
        """P(Y <= y | X = x)."""
        f, p = self._f()
        return f.h(self.right.cdf(y), self.left.cdf(x), p)

    def conditional_pdf(self, y, x):
        """Density of Y at y given X = x."""
        return np.exp(self.log_pdf(x, y) - self.left.logpdf(x))

    def conditional_ppf(self, q, x):
        """Quantile of Y given X = x."""
        f, p = self._f()
        return self.right.ppf(f.inv_h(np.asarray(q, float), self.left.cdf(x), p))

    def over(self, df: DataFrame, x: str, y: str) -> DataFrame:
        """Adds ``log_pdf`` and ``conditional`` (P(Y <= y | X = x)) to rows, as expressions."""
        f, p = self._f()
        u, v = clamp(self.left.cdf(Sql(x))), clamp(self.right.cdf(Sql(y)))
        d = df.withColumn("__u", F.expr(str(u))).withColumn("__v", F.expr(str(v)))
        a, b = Sql("__u"), Sql("__v")
        joint = f.shape.log_pdf(a, b, p) + self.left.logpdf(Sql(x)) + self.right.logpdf(Sql(y))
        return d.withColumn("log_pdf", F.expr(str(joint))).withColumn("conditional", F.expr(str(f.shape.h(b, a, p)))).drop("__u", "__v")

    def sample_conditional(self, x, seed: int = 0):
        """One draw of Y for each given X."""
        return self.conditional_ppf(np.random.default_rng(seed).random(len(x)), np.asarray(x, float))

    def sample(self, n: int, seed: int = 0):
        f, p = self._f()
        rng = np.random.default_rng(seed)
        u, v = f.sample(rng.random(n), rng.random(n), p)
        return self.left.ppf(u), self.right.ppf(v)

    @classmethod
    def fit(cls, x, y, family: str = "Gauss", left: str = "norm", right: str = "norm", method: str = "tau") -> BivariateLaw:
        """Margins by moments first, then the copula on their probabilities."""
        a, b = fit_moments(left, x.mean(), x.var()), fit_moments(right, y.mean(), y.var())
        g = fit(family, stats.clip01(a.cdf(x)), stats.clip01(b.cdf(y)), method)
        return cls(a, b, family, g.tau, g.extras)
