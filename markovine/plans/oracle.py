"""The definitions behind the queries, written out as SQL for another engine.

Nothing here uses the kernels that the queries run: copulas are given by their textbook
distribution functions (densities and conditionals by differences of them) or textbook
densities, margins by the normal density, chains by the recursions over rows.
"""

from __future__ import annotations

import math

from .model import Model

# ------------------------------------------------------------------ copulas

#: Distribution functions in ``{u}``, ``{v}`` with parameters named as the families name them.
CDF = {
    "Prod": "{u} * {v}",
    "FGM": "{u} * {v} * (1 + {theta} * (1 - {u}) * (1 - {v}))",
    "CubSec": "{u} * {v} * (1 + 2 * {theta} * (1 - {u}) * (1 - {v}) * (1 + {u} + {v} - 2 * {u} * {v}))",
    "Clayton": "power(power({u}, -{theta}) + power({v}, -{theta}) - 1, -1 / {theta})",
    "GH": "exp(-power(power(-ln({u}), {theta}) + power(-ln({v}), {theta}), 1 / {theta}))",
    "Frank": "-ln(1 + (exp(-{theta} * {u}) - 1) * (exp(-{theta} * {v}) - 1) / (exp(-{theta}) - 1)) / {theta}",
    "Joe": "1 - power(power(1 - {u}, {theta}) + power(1 - {v}, {theta}) - power((1 - {u}) * (1 - {v}), {theta}), 1 / {theta})",
    "A12": "1 / (1 + power(power(1 / {u} - 1, {theta}) + power(1 / {v} - 1, {theta}), 1 / {theta}))",
    "A14": "power(1 + power(power(power({u}, -1 / {theta}) - 1, {theta}) + power(power({v}, -1 / {theta}) - 1, {theta}), 1 / {theta}), -{theta})",
    "AMH": "{u} * {v} / (1 - {theta} * (1 - {u}) * (1 - {v}))",
    "Plackett": "((1 + ({theta} - 1) * ({u} + {v})) - sqrt(power(1 + ({theta} - 1) * ({u} + {v}), 2) - 4 * {u} * {v} * {theta} * ({theta} - 1))) / (2 * ({theta} - 1))",
    "Galambos": "{u} * {v} * exp(power(power(-ln({u}), -{theta}) + power(-ln({v}), -{theta}), -1 / {theta}))",
    "Tawn": "exp((1 - {psi_u}) * ln({u}) + (1 - {psi_v}) * ln({v}) - power(power(-{psi_u} * ln({u}), {theta}) + power(-{psi_v} * ln({v}), {theta}), 1 / {theta}))",
    "BB1": "power(1 + power(power(power({u}, -{theta}) - 1, {delta}) + power(power({v}, -{theta}) - 1, {delta}), 1 / {delta}), -1 / {theta})",
    "BB6": "1 - power(1 - exp(-power(power(-ln(1 - power(1 - {u}, {theta})), {delta6}) + power(-ln(1 - power(1 - {v}, {theta})), {delta6}), 1 / {delta6})), 1 / {theta})",
    "BB7": "1 - power(1 - power(power(1 - power(1 - {u}, {theta7}), -{theta}) + power(1 - power(1 - {v}, {theta7}), -{theta}) - 1, -1 / {theta}), 1 / {theta7})",
    "BB8": "(1 - power(1 - (1 - power(1 - {delta8} * {u}, {theta})) * (1 - power(1 - {delta8} * {v}, {theta})) / (1 - power(1 - {delta8}, {theta})), 1 / {theta})) / {delta8}",
}


def number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def cdf(family: str, params: dict[str, float], u: str, v: str) -> str:
    """The distribution function of a family, rotations and survival copulas included."""
    if family.endswith("270"):
        return f"({u} - {cdf(family[:-3], params, u, f'(1 - {v})')})"
    if family.endswith("90"):
        return f"({v} - {cdf(family[:-2], params, f'(1 - {u})', v)})"
    if family in ("SClayton", "SGH", "SJoe", "SBB1"):
        return f"({u} + {v} - 1 + {cdf(family[1:], params, f'(1 - {u})', f'(1 - {v})')})"
    text = CDF["Tawn" if family.startswith("Tawn") else family]
    return "(" + text.format(u=u, v=v, **{k: number(x) for k, x in params.items()}) + ")"


#: Weights of a first derivative by differences at -2, -1, 1 and 2 steps.
_OFFSETS = "(VALUES (-2, 1 / 12.0), (-1, -8 / 12.0), (0, 0.0), (1, 8 / 12.0), (2, -1 / 12.0))"
_STEP = 3e-4


def kernel_sql(families: list[tuple[str, dict[str, float]]], points: str) -> str:
    """``family, part, n, pdf, h, cdf``: means over the points ``part, u, v``, from the
    distribution functions."""
    step = number(_STEP)
    parts = " UNION ALL ".join(f"SELECT '{f}' AS family, id, a, b, wa, wb, {cdf(f, p, 'u', 'v')} AS c FROM g" for f, p in families)
    return (
        f"WITH q AS MATERIALIZED (SELECT row_number() OVER () AS id, part, u, v FROM ({points}) p0), g AS MATERIALIZED (SELECT id, q.u + a * {step} AS u, q.v + b * {step} AS v, a, b, CAST(wa AS DOUBLE) AS wa, CAST(wb AS DOUBLE) AS wb FROM q CROSS JOIN {_OFFSETS} x(a, wa) CROSS JOIN {_OFFSETS} y(b, wb)), "
        f"c AS ({parts}), k AS (SELECT family, id, sum(wa * wb * c) / ({step} * {step}) AS pdf, sum(CASE WHEN b = 0 THEN wa * c ELSE 0 END) / {step} AS h, max(CASE WHEN a = 0 AND b = 0 THEN c END) AS cdf FROM c GROUP BY family, id) "
        "SELECT family, part, count(*) AS n, round(avg(pdf), 3) AS pdf, round(avg(h), 4) AS h, round(avg(cdf), 6) AS cdf FROM k JOIN q USING (id) GROUP BY family, part"
    )


def hilbert(side: int, row: str, col: str) -> tuple[str, str]:
    """CTE steps and the place of a cell on Hilbert's curve of a square of a power of two, from
    quadrant to quadrant: which one the cell is in, then the cell turned as that quadrant is."""
    text, s = f"SELECT *, {col} AS hx, {row} AS hy, CAST(0 AS BIGINT) AS hd FROM ({{0}}) h0", side // 2
    while s:
        rx, ry = f"CAST(hx & {s} > 0 AS INTEGER)", f"CAST(hy & {s} > 0 AS INTEGER)"
        text = f"SELECT * EXCLUDE (rx, ry, hx, hy, hd), CASE WHEN ry = 1 THEN hx WHEN rx = 1 THEN {side - 1} - hy ELSE hy END AS hx, CASE WHEN ry = 1 THEN hy WHEN rx = 1 THEN {side - 1} - hx ELSE hx END AS hy, hd + {s * s} * xor(3 * rx, ry) AS hd FROM (SELECT *, {rx} AS rx, {ry} AS ry FROM ({text}) h{s}) k{s}"
        s //= 2
    return text, "hd"


def frank_theta(tau: float) -> float:
    """By bisection on tau = 1 - 4 (1 - D(theta)) / theta, the integral by Simpson's rule."""

    def of(a: float) -> float:
        n = 2000
        f = lambda t: t / math.expm1(t) if t else 1.0
        s = sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(a * k / n) for k in range(n + 1))
        return 1 - 4 / a * (1 - s / (3 * n))

    lo, hi = 1e-3, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if of(mid) < tau else (lo, mid)
    return lo


def density(family: str, tau: float, u: str, v: str) -> str:
    """Textbook densities of the families in the models, from Kendall's tau."""
    if family == "Prod":
        return "1.0"
    if family == "FGM":
        return f"(1 + {number(4.5 * tau)} * (1 - 2 * {u}) * (1 - 2 * {v}))"
    if family == "Clayton":
        t = 2 * tau / (1 - tau)
        return f"({number(1 + t)} * power({u} * {v}, {number(-1 - t)}) * power(power({u}, {number(-t)}) + power({v}, {number(-t)}) - 1, {number(-2 - 1 / t)}))"
    if family == "Frank":
        t = frank_theta(tau)
        k = number(1 - math.exp(-t))
        return f"({number(t)} * {k} * exp({number(-t)} * ({u} + {v})) / power({k} - (1 - exp({number(-t)} * {u})) * (1 - exp({number(-t)} * {v})), 2))"
    if family == "GH":
        t = 1 / (1 - tau)
        s = f"(power(-ln({u}), {number(t)}) + power(-ln({v}), {number(t)}))"
        return f"(exp(-power({s}, {number(1 / t)})) / ({u} * {v}) * power(ln({u}) * ln({v}), {number(t - 1)}) * power({s}, {number(2 / t - 2)}) * (1 + {number(t - 1)} * power({s}, {number(-1 / t)})))"
    raise KeyError(family)


# ------------------------------------------------------------------ normal law

def normal_cdf(z: str, terms: int = 110) -> str:
    """Half plus the density times z + z^3 / 3 + z^5 / (3 * 5) + .., nested from the inside:
    exact to rounding up to seven standard deviations."""
    nest = "1.0"
    for k in range(terms, 0, -1):
        nest = f"(1.0 + sq / {2 * k + 1}.0 * {nest})"
    nest = nest.replace("sq", "power(least(abs(z), 7.0), 2)")
    series = f"{number(1 / math.sqrt(2 * math.pi))} * exp(-0.5 * power(least(abs(z), 7.0), 2)) * least(abs(z), 7.0) * {nest}"
    return f"(0.5 + sign(z) * least(0.5 - 1e-16, {series}))".replace("z", z)


def normal_pdf(y: str, m: float, s: float) -> str:
    return f"(exp(-0.5 * power(({y} - {number(m)}) / {number(s)}, 2)) / {number(s * math.sqrt(2 * math.pi))})"


def logistic_pdf(y: str, m: float, s: float) -> str:
    z = f"(-abs({y} - {number(m)}) / {number(s)})"
    return f"(exp({z}) / ({number(s)} * power(1 + exp({z}), 2)))"


# ------------------------------------------------------------------ chains


def columns(model: Model, y: str = "y") -> dict[str, str]:
    """Densities ``f`` and probabilities ``u`` of an observation per state pair, for normal
    margins (densities for logistic ones too); a missing observation has density one."""
    out = {}
    for i in range(model.K):
        for j in range(model.K):
            m = model.margin(i, j)
            pdf = (normal_pdf if m.dist == "norm" else logistic_pdf)(y, m.loc, m.scale)
            out[f"f{i}{j}"] = f"CASE WHEN {y} IS NULL THEN 1.0 ELSE {pdf} END"
            if model.uses_copula:
                z = f"(({y} - {number(m.loc)}) / {number(m.scale)})"
                out[f"u{i}{j}"] = normal_cdf(z)
    return out


def step(model: Model, i: int, j: int, left: str, right: str) -> str:
    """Weight of going from state i at row ``left`` to j at row ``right``: p(i, j) f_ij(left)
    over its sum in j, times f_ji(right) and the copula density of the two."""
    if model.is_pair:
        whole = " + ".join(f"{number(model.p[i, k])} * {left}.f{i}{k}" for k in range(model.K))
        w = f"{number(model.p[i, j])} * {left}.f{i}{j} / ({whole})"
    else:
        w = number(model.p[i, j] / model.p[i].sum())
    w += f" * {right}.f{j}{i}"
    if model.uses_copula and model.copula(i, j).name != "Prod":
        c = model.copula(i, j)
        w += " * " + density(c.name, c.tau, f"{left}.u{i}{j}", f"{right}.u{j}{i}")
    return f"({w})"


def start(model: Model, i: int, row: str) -> str:
    if model.is_pair:
        return "(" + " + ".join(f"{number(model.p[i, k])} * {row}.f{i}{k}" for k in range(model.K)) + ")"
    return f"({number(model.p[:, i].sum())} * {row}.f{i}0)"


def rows(model: Model, source: str, evidence: list[str] | None = None) -> str:
    """CTEs that give every row its densities; ``evidence`` are factors per state."""
    cols = columns(model)
    if evidence:
        cols = {k: f"({v}) * ({evidence[int(k[1])]})" if k[0] == "f" else v for k, v in cols.items()}
    return f"rws AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM ({source}) q)"


def filter_sql(model: Model, source: str, evidence: list[str] | None = None) -> str:
    """CTEs ``rws`` and ``fwd(series_id, n, b.., ll)`` over a query with ``series_id, n, y``."""
    K = model.K
    keep = ", ".join(f"r.{x}" for x in columns(model))
    c = "(" + " + ".join(f"s.b{i}" for i in range(K)) + ")"
    first = ", ".join(f"{start(model, i, 'r')} AS b{i}" for i in range(K))
    nxt = ", ".join("(" + " + ".join(f"s.b{i} * {step(model, i, j, 's', 'r')}" for i in range(K)) + f") / {c}" for j in range(K))
    return (
        f"{rows(model, source, evidence)}, fwd AS (SELECT r.series_id, r.n, {keep}, {first}, CAST(0 AS DOUBLE) AS ll FROM rws r WHERE r.n = 0 "
        f"UNION ALL SELECT r.series_id, r.n, {keep}, {nxt}, s.ll + ln({c}) FROM fwd s JOIN rws r ON r.series_id = s.series_id AND r.n = s.n + 1)"
    )


def smooth_sql(model: Model, source: str, evidence: list[str] | None = None) -> str:
    """``filter_sql`` and CTEs ``bwd`` and ``post(series_id, n, g0..)``."""
    K = model.K
    keep = ", ".join(f"r.{x}" for x in columns(model))
    c = "(" + " + ".join(f"s.e{i}" for i in range(K)) + ")"
    back = ", ".join("(" + " + ".join(f"s.e{j} * {step(model, i, j, 'r', 's')}" for j in range(K)) + f") / {c} AS e{i}" for i in range(K))
    ones = ", ".join(f"CAST(1 AS DOUBLE) AS e{i}" for i in range(K))
    total = "(" + " + ".join(f"f.b{i} * b.e{i}" for i in range(K)) + ")"
    g = ", ".join(f"f.b{i} * b.e{i} / {total} AS g{i}" for i in range(K))
    return (
        filter_sql(model, source, evidence)
        + f", bwd AS (SELECT r.series_id, r.n, {keep}, {ones} FROM rws r JOIN (SELECT series_id, max(n) AS n FROM rws GROUP BY series_id) m USING (series_id, n) "
        f"UNION ALL SELECT r.series_id, r.n, {keep}, {back} FROM bwd s JOIN rws r ON r.series_id = s.series_id AND r.n = s.n - 1), "
        f"post AS (SELECT f.series_id, f.n, {g} FROM fwd f JOIN bwd b ON f.series_id = b.series_id AND f.n = b.n)"
    )


def log_lik_sql(model: Model, source: str) -> str:
    """Total log-likelihood of all series, as a query of one value ``ll``."""
    K = model.K
    c = " + ".join(f"b{i}" for i in range(K))
    return f"WITH RECURSIVE {filter_sql(model, source)} SELECT sum(ll + ln({c})) AS ll FROM fwd JOIN (SELECT series_id, max(n) AS n FROM fwd GROUP BY series_id) z USING (series_id, n)"
