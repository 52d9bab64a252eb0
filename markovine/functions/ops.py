"""One definition of a formula for numpy arrays and for SQL text.

Kernels are written with Python operators and the functions below.  Given numpy
values they compute; given ``Sql`` values they write an expression that Spark and
other SQL engines evaluate alike, so that a kernel runs inside whole-stage code
generation and can be checked against another engine.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 2.220446049250313e-16


class Sql:
    """SQL text with arithmetic."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    @staticmethod
    def of(x) -> str:
        return x.text if isinstance(x, Sql) else f"CAST({float(x)!r} AS DOUBLE)"

    def _two(self, other, op: str, swap: bool = False) -> Sql:
        a, b = Sql.of(self), Sql.of(other)
        return Sql(f"({b} {op} {a})" if swap else f"({a} {op} {b})")

    def __add__(self, o):
        return self._two(o, "+")

    def __radd__(self, o):
        return self._two(o, "+", True)

    def __sub__(self, o):
        return self._two(o, "-")

    def __rsub__(self, o):
        return self._two(o, "-", True)

    def __mul__(self, o):
        return self._two(o, "*")

    def __rmul__(self, o):
        return self._two(o, "*", True)

    def __truediv__(self, o):
        return self._two(o, "/")

    def __rtruediv__(self, o):
        return self._two(o, "/", True)

    def __neg__(self):
        return Sql(f"(-{self.text})")

    def __pow__(self, o):
        return Sql(f"power({self.text}, {Sql.of(o)})")

    def __lt__(self, o):
        return self._two(o, "<")

    def __le__(self, o):
        return self._two(o, "<=")

    def __gt__(self, o):
        return self._two(o, ">")

    def __ge__(self, o):
        return self._two(o, ">=")


def col(name: str) -> Sql:
    return Sql(name)


def _unary(name: str, fn):
    def apply(x):
        return Sql(f"{name}({x.text})") if isinstance(x, Sql) else fn(x)

    return apply


exp = _unary("exp", np.exp)
log = _unary("ln", np.log)
sqrt = _unary("sqrt", np.sqrt)
absolute = _unary("abs", np.abs)


def where(cond, a, b):
    if isinstance(cond, Sql):
        return Sql(f"(CASE WHEN {cond.text} THEN {Sql.of(a)} ELSE {Sql.of(b)} END)")
    return np.where(cond, a, b)


def maximum(a, b):
    return Sql(f"greatest({Sql.of(a)}, {Sql.of(b)})") if isinstance(a, Sql) or isinstance(b, Sql) else np.maximum(a, b)


def minimum(a, b):
    return Sql(f"least({Sql.of(a)}, {Sql.of(b)})") if isinstance(a, Sql) or isinstance(b, Sql) else np.minimum(a, b)


def expm1(x):
    return exp(x) - 1.0 if isinstance(x, Sql) else np.expm1(x)


def log1p(x):
    return log(1.0 + x) if isinstance(x, Sql) else np.log1p(x)


def clamp(u):
    """Into [EPS, 1 - EPS], as every probability that enters a copula."""
    return minimum(maximum(u, EPS), 1.0 - EPS)


def poly(x, coefficients):
    """Horner's rule, highest power first."""
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


# The double-precision rational approximation of the normal tail (Hart).
_HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's algorithm AS 241 for the normal quantile.
_Q_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_Q_B = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
_Q_C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
_Q_D = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
_Q_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
_Q_F = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def norm_cdf(x):
    """The standard normal distribution function."""
    a = minimum(absolute(x), 38.0)
    e = exp(-0.5 * a * a)
    near = e * poly(a, _HART_P) / poly(a, _HART_Q)
    far = e / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / math.sqrt(2 * math.pi)
    tail = where(a < 7.07106781186547, near, far)
    return where(x > 0.0, 1.0 - tail, tail)


def norm_logpdf(x):
    return -0.5 * x * x - 0.5 * math.log(2 * math.pi)


def norm_crps(x):
    """Continuous ranked probability score of a standard normal forecast."""
    return x * (2.0 * norm_cdf(x) - 1.0) + 2.0 * exp(norm_logpdf(x)) - 1.0 / math.sqrt(math.pi)


def norm_ppf(p):
    """The standard normal quantile."""
    q = p - 0.5
    r0 = 0.180625 - q * q
    centre = q * poly(r0, _Q_A) / poly(r0, _Q_B)
    r = sqrt(maximum(-log(maximum(minimum(p, 1.0 - p), 1e-300)), 1e-300))
    mid = poly(r - 1.6, _Q_C) / poly(r - 1.6, _Q_D)
    out = poly(r - 5.0, _Q_E) / poly(r - 5.0, _Q_F)
    tail = where(r <= 5.0, mid, out)
    return where(absolute(q) <= 0.425, centre, where(q < 0.0, -tail, tail))
