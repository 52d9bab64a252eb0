"""Special functions and small optimisers in numpy (no scipy here)."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from .ops import norm_cdf, norm_ppf  # noqa: F401

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x):
    return _lgamma(x)


_legendre = cache(np.polynomial.legendre.leggauss)  # an eigenvalue problem for every call


def gauss_legendre(n: int, a: float = 0.0, b: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    x, w = _legendre(n)
    return 0.5 * (b - a) * x + 0.5 * (a + b), 0.5 * (b - a) * w


def betainc(a, b, x):
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            f = f * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    out = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def gammainc(a, x):
    """Regularised lower incomplete gamma function: series or continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) - x - lgamma(a))
    term, total = 1 / a, 1 / a
    small = x < a + 1
    for k in range(1, 2000):
        term = term * x / (a + k)
        total = total + np.where(small, term, 0)
        if np.all(np.abs(term[small] if small.ndim else term) < 1e-17 * np.abs(total[small] if small.ndim else total)):
            break
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for k in range(1, 2000):
        an = -k * (k - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1)[~small] < 1e-15):
            break
    return np.where(x <= 0, 0.0, np.where(small, front * total, 1 - front * h))


def chi2_sf(x: float, df: float) -> float:
    return float(1 - gammainc(df / 2, x / 2))


def t_cdf(x, df):
    x = np.asarray(x, float)
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_logpdf(x, df):
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(np.asarray(x, float) ** 2 / df)


def invert(cdf, p, lo: float, hi: float, steps: int = 80):
    """Vectorised bisection for an increasing function on [lo, hi]."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, lo), np.full(p.shape, hi)
    for _ in range(steps):
        m = 0.5 * (a + b)
        low = cdf(m) < p
        a, b = np.where(low, m, a), np.where(low, b, m)
    return 0.5 * (a + b)


def t_ppf(p, df):
    """Student quantile: bisection on the compactified line."""
    p = np.asarray(p, float)
    y = invert(lambda y: t_cdf(np.tan(np.pi * (y - 0.5)), df), p, 1e-14, 1 - 1e-14, 60)
    x = np.tan(np.pi * (y - 0.5))
    for _ in range(3):
        x = x - np.clip((t_cdf(x, df) - p) / np.exp(t_logpdf(x, df)), -1, 1)
    return x


def golden(f, lo: float, hi: float, tol: float = 1e-7, grid: int = 17) -> tuple[float, float]:
    """Minimum of a function on an interval: a coarse grid, then golden section."""
    xs = np.linspace(lo, hi, grid)
    ys = np.array([f(x) for x in xs])
    i = int(np.nanargmin(np.where(np.isfinite(ys), ys, np.inf))) if np.isfinite(ys).any() else 0
    a, b = xs[max(i - 1, 0)], xs[min(i + 1, grid - 1)]
    r = (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if not fc > fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    x = 0.5 * (a + b)
    y = f(x)
    return (x, y) if y <= ys[i] or not np.isfinite(ys[i]) else (float(xs[i]), float(ys[i]))


def nelder_mead(f, x0, step=0.1, tol: float = 1e-8, limit: int = 600) -> tuple[np.ndarray, float]:
    """Simplex search for a minimum."""
    n = len(x0)
    pts = [np.asarray(x0, float)]
    for i in range(n):
        p = pts[0].copy()
        p[i] += step if np.isscalar(step) else step[i]
        pts.append(p)
    val = [f(p) for p in pts]
    for _ in range(limit):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        y = f(far)
        if y < val[0]:
            out = mid + 2 * (mid - pts[-1])
            z = f(out)
            pts[-1], val[-1] = (out, z) if z < y else (far, y)
        elif y < val[-2]:
            pts[-1], val[-1] = far, y
        else:
            inner = mid + 0.5 * ((far if y < val[-1] else pts[-1]) - mid)
            z = f(inner)
            if z < min(y, val[-1]):
                pts[-1], val[-1] = inner, z
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], val[i]
