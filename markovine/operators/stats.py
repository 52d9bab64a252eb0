"""Sample statistics and tests on arrays; the grouped operators run these per key."""

from __future__ import annotations

import math

import numpy as np

from ..functions import numerics
from ..functions.ops import EPS, norm_crps


def mid_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties get their mean rank."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    upper = np.cumsum(counts)
    return (upper - (counts - 1) / 2)[inverse]


def pseudo_observations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    return mid_ranks(x) / (n + 1), mid_ranks(y) / (n + 1)


def weighted_ecdf(y: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weighted distribution function over (total weight + 1); ties get the upper end."""
    order = np.argsort(y, kind="stable")
    total = np.concatenate([[0.0], np.cumsum(w[order])])
    return total[np.searchsorted(y[order], at, "right")] / (total[-1] + 1)


def weighted_pseudo_obs(x, y, w):
    return weighted_ecdf(x, w, x), weighted_ecdf(y, w, y)


def _concordance(rank: np.ndarray, w: np.ndarray) -> float:
    """Weight of pairs in order less that of pairs out of order, for ranks visited in order:
    halves are counted apart and against each other by sorting, small parts at once."""
    n = len(rank)
    if n <= 256:
        s = np.sign(rank[None, :] - rank[:, None])
        return float(w @ (np.triu(s, 1) @ w))
    m = n // 2
    left = np.argsort(rank[:m], kind="stable")
    sums = np.concatenate([[0.0], np.cumsum(w[:m][left])])
    ordered = rank[:m][left]
    below, upto = (sums[np.searchsorted(ordered, rank[m:], side)] for side in ("left", "right"))
    return float(w[m:] @ (below - (sums[-1] - upto))) + _concordance(rank[:m], w[:m]) + _concordance(rank[m:], w[m:])


def kendall_tau(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
    """Weighted Kendall tau-b (tau-a without ties) in O(n log^2 n): pairs in order of x are
    counted by halves, and those that tie in x are taken back."""
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    keep = w > 0
    x, y, w = np.asarray(x, float)[keep], np.asarray(y, float)[keep], w[keep]
    if len(x) < 2:
        return math.nan
    order = np.lexsort((y, x))
    xs, ws = x[order], w[order]
    rank = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    score = _concordance(rank, ws)
    # inside a tie of x all pairs but ties of y counted as in order
    cuts = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
    both = np.concatenate([[True], (xs[1:] != xs[:-1]) | (rank[1:] != rank[:-1])])
    cells = np.flatnonzero(both)
    same_x, same_xy = np.add.reduceat(ws, cuts), np.add.reduceat(ws, cells)
    score -= ((same_x**2).sum() - (same_xy**2).sum()) / 2

    def untied(v):
        s = np.bincount(np.unique(v, return_inverse=True)[1], weights=w)
        return (w.sum() ** 2 - (s**2).sum()) / 2

    scale = math.sqrt(untied(x) * untied(y))
    return score / scale if scale > 0 else math.nan


def _below(rank: np.ndarray, w: np.ndarray, ends: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Weight of the ranks under each limit among as many first ones as each end says: ranks are
    parted by one bit after the other, the highest first."""
    low, high, out = np.zeros_like(ends), ends, np.zeros(len(ends))
    for bit in range(len(rank).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        weight = np.concatenate([[0.0], np.cumsum(np.where(one, 0.0, w))])
        up = (limits >> bit) & 1 == 1
        out += np.where(up, weight[high] - weight[low], 0.0)
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        order = np.argsort(one, kind="stable")
        rank, w = rank[order], w[order]
    return out


def empirical_copula(u, v, at_u, at_v, w=None) -> np.ndarray:
    """Weighted share of points at or below each query point: few points are compared, many
    are counted by bits of their ranks in O(n log n)."""
    u, v, at_u, at_v = (np.asarray(x, float) for x in (u, v, at_u, at_v))
    w = np.ones(len(u)) if w is None else np.asarray(w, float)
    if len(u) * len(at_u) <= 1 << 18:
        return ((u[None] <= at_u[:, None]) & (v[None] <= at_v[:, None])) @ w / w.sum()
    order, ordered = np.argsort(u, kind="stable"), np.sort(v)
    rank = np.searchsorted(ordered, v[order], "left")
    return _below(rank, w[order], np.searchsorted(u[order], at_u, "right"), np.searchsorted(ordered, at_v, "right")) / w.sum()


def cvm_statistic(u, v, cdf) -> float:
    """Sum of squared differences of the empirical and the model copula at the points."""
    return float(((empirical_copula(u, v, u, v) - cdf(u, v)) ** 2).sum())


def exchangeability_statistic(u, v) -> float:
    return float(len(u) * ((empirical_copula(u, v, u, v) - empirical_copula(u, v, v, u)) ** 2).mean())


def radial_symmetry_statistic(u, v) -> float:
    s = u + v - 1 + empirical_copula(u, v, 1 - u + 1e-12, 1 - v + 1e-12)  # ranks are on a lattice
    return float(len(u) * ((empirical_copula(u, v, u, v) - s) ** 2).mean())


def rosenblatt_statistic(a, b) -> float:
    return float(len(a) * ((empirical_copula(a, b, a, b) - a * b) ** 2).mean())


def neyman_components(u: np.ndarray, order: int = 4) -> np.ndarray:
    """Sums of the first orthonormal shifted Legendre polynomials over root n."""
    z = 2 * np.asarray(u) - 1
    return np.array([math.sqrt(2 * k + 1) * np.polynomial.legendre.legval(z, [0] * k + [1]).sum() for k in range(1, order + 1)]) / math.sqrt(len(u))


def neyman_test(u: np.ndarray, alpha: float = 0.05, order: int = 4) -> dict:
    if len(u) < 8:
        raise ValueError("at least 8 values are needed")
    v = neyman_components(u, order)
    p = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in v])
    low = min(1.0, order * p.min())
    return {"components": v, "p_values": p, "p_value": low, "reject": low < alpha}


def ks_distance(u: np.ndarray) -> float:
    s = np.sort(u)
    n = len(s)
    return float(max((np.arange(1, n + 1) / n - s).max(), (s - np.arange(n) / n).max()))


def ks_pvalue(d: float, n: int) -> float:
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return float(min(max(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)), 0.0), 1.0))


def mks_statistic(a: np.ndarray, cdf=None, b: np.ndarray | None = None) -> float:
    """Multivariate Kolmogorov-Smirnov distance on the grid of upper corners: per axis
    points are taken in descending order and the other coordinates' running maxima form
    the corners of the empty regions."""

    def below(sample, points):
        return np.array([(sample <= p).all(axis=1).mean() for p in points])

    both = a if b is None else np.vstack([a, b])
    corners = [both]
    for axis in range(both.shape[1]):
        s = both[np.argsort(-both[:, axis], kind="stable")][::-1]
        corners.append(np.maximum.accumulate(s, axis=0))
    grid = np.vstack(corners)
    other = cdf(grid) if b is None else below(b, grid)
    return float(np.abs(below(a, grid) - other).max())


def mks_critical(n: int, d: int, alpha: float = 0.05, asymptotic: bool = False) -> float:
    return math.sqrt(-math.log(alpha / (2 * (1 if asymptotic else n + 1) * d)) / (2 * n))


def ljung_box(x: np.ndarray, lags: int = 10) -> tuple[float, float]:
    x = x - x.mean()
    n = len(x)
    if n <= lags + 1:
        return math.nan, math.nan
    d = (x * x).sum()
    q = n * (n + 2) * sum(((x[k:] * x[:-k]).sum() / d) ** 2 / (n - k) for k in range(1, lags + 1))
    return float(q), numerics.chi2_sf(q, lags)


def hac_variance(z: np.ndarray, bandwidth: int) -> float:
    """Bartlett sum of autocovariances (not centred), over n."""
    n = len(z)
    s = (z * z).sum()
    for h in range(1, min(bandwidth, n - 1) + 1):
        s += 2 * (1 - h / (bandwidth + 1)) * (z[h:] * z[:-h]).sum()
    return float(max(s, 0.0) / n)


def newey_west_bandwidth(z: np.ndarray) -> int:
    n = len(z)
    pilot = min(int(4 * (n / 100) ** (2 / 9)), n - 1)
    cov = [(z * z).sum() / n] + [(z[h:] * z[:-h]).sum() / n for h in range(1, pilot + 1)]
    s0 = cov[0] + 2 * sum(cov[1:])
    s1 = 2 * sum(h * c for h, c in enumerate(cov) if h)
    if s0 <= 0:
        return 1
    return max(1, min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1))


def _correction(k_a: int, k_b: int, n: float, correction: str) -> float:
    return {"none": 0.0, "akaike": float(k_a - k_b), "schwarz": 0.5 * (k_a - k_b) * math.log(n)}[correction]


def vuong_test(la, lb, w=None, k_a=1, k_b=1, correction="none", bandwidth: int | str = "auto", alpha=0.05) -> dict:
    """Non-nested likelihood-ratio test with frequency weights and HAC variance."""
    m = np.asarray(la) - np.asarray(lb)
    w = np.ones(len(m)) if w is None else np.asarray(w, float)
    n = w.sum()
    mean = (w * m).sum() / n
    z = np.sqrt(w) * (m - mean)
    band = newey_west_bandwidth(z) if bandwidth == "auto" else bandwidth
    sd = math.sqrt(hac_variance(z, band) * len(z) / n)
    if sd < 1e-12 * max(1.0, abs(mean)):
        return {"statistic": 0.0, "p_value": 1.0, "preferred": None}
    stat = math.sqrt(n) * (mean - _correction(k_a, k_b, n, correction) / n) / sd
    p = math.erfc(abs(stat) / math.sqrt(2))
    return {"statistic": stat, "p_value": p, "preferred": None if p >= alpha else ("a" if stat > 0 else "b")}


def clarke_test(la, lb, w=None, k_a=1, k_b=1, correction="none", alpha=0.05) -> dict:
    """Weighted sign test on the log-likelihood differences."""
    m = np.asarray(la) - np.asarray(lb)
    w = np.ones(len(m)) if w is None else np.asarray(w, float)
    n = w.sum()
    b = float((w * (m - _correction(k_a, k_b, n, correction) / n > 0)).sum())
    if np.all(w == np.round(w)):
        k, total = int(round(min(b, n - b))), int(n)
        logs = [math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) - total * math.log(2) for i in range(k + 1)]
        p = min(1.0, 2 * sum(map(math.exp, logs)))
    else:
        p = math.erfc(abs(b - n / 2) / math.sqrt(n / 4) / math.sqrt(2))
    return {"statistic": b / n, "p_value": p, "preferred": None if p >= alpha else ("a" if b > n / 2 else "b")}


def adjust(p: list[float], how: str | None) -> list[float]:
    """Bonferroni or Holm adjusted p-values."""
    n = len(p)
    if how in (None, "none"):
        return list(p)
    if how == "bonferroni":
        return [min(1.0, n * x) for x in p]
    order = np.argsort(p)
    out, top = [0.0] * n, 0.0
    for k, i in enumerate(order):
        top = max(top, min(1.0, (n - k) * p[i]))
        out[i] = top
    return out


def multipliers(n: int, rng: np.random.Generator, block: int = 1, law: str = "normal") -> np.ndarray:
    """Multipliers with Bartlett-smoothed dependence over ``block`` neighbours."""
    raw = rng.standard_normal(n + 2 * block) if law == "normal" else rng.choice([-1.0, 1.0], n + 2 * block)
    if block <= 1:
        return raw[:n]
    k = 1 - np.abs(np.arange(-block + 1, block)) / block
    k = k / math.sqrt((k * k).sum())
    return np.convolve(raw, k, "valid")[:n]


def auto_block_length(u: np.ndarray, v: np.ndarray) -> int:
    return max(1, max(newey_west_bandwidth(x - x.mean()) for x in (u, v)))


def _process(u, v, points):
    """Columns of the empirical process at some points, with the margins' influence."""
    a, b = points
    ind = (u[:, None] <= a[None]) & (v[:, None] <= b[None])
    h = 1 / math.sqrt(len(u))
    c = lambda x, y: empirical_copula(u, v, x, y)
    d1 = (c(np.minimum(a + h, 1), b) - c(np.maximum(a - h, 0), b)) / (np.minimum(a + h, 1) - np.maximum(a - h, 0))
    d2 = (c(a, np.minimum(b + h, 1)) - c(a, np.maximum(b - h, 0))) / (np.minimum(b + h, 1) - np.maximum(b - h, 0))
    return ind - d1[None] * (u[:, None] <= a[None]) - d2[None] * (v[:, None] <= b[None])


def symmetry_test(x, y, kind: str = "exchangeability", B: int = 200, seed: int = 0, block: int | str = "auto") -> dict:
    """Multiplier bootstrap of the exchangeability or radial symmetry statistic."""
    u, v = pseudo_observations(np.asarray(x, float), np.asarray(y, float))
    n, rng = len(u), np.random.default_rng(seed)
    own = _process(u, v, (u, v))
    if kind == "exchangeability":
        stat, other = exchangeability_statistic(u, v), _process(u, v, (v, u))
    else:
        stat = radial_symmetry_statistic(u, v)
        # the survival copula's process is that of the reflected sample
        other = _process(1 - u, 1 - v, (u, v))
    diff = own - other
    diff = diff - diff.mean(axis=0)
    m = auto_block_length(u, v) if block == "auto" else block
    count = 0
    for _ in range(B):
        z = multipliers(n, rng, m)
        count += ((z - z.mean()) @ diff / math.sqrt(n)) @ ((z - z.mean()) @ diff / math.sqrt(n)) / n >= stat
    return {"statistic": stat, "p_value": (1 + int(count)) / (B + 1), "block_length": m}


# --------------------------------------------------------------------- metrics


def error_rate(truth: np.ndarray, guess: np.ndarray, K: int | None = None) -> tuple[float, list[int]]:
    """Share of wrong labels under the best renaming of the guesses, and the true label of
    each."""
    from .missing import assignment

    K = K or int(max(truth.max(), guess.max())) + 1
    table = np.zeros((K, K))
    np.add.at(table, (truth, guess), 1)
    best = assignment(-table.T).tolist()
    return 1 - sum(table[best[j], j] for j in range(K)) / len(truth), best


def crps_from_samples(y: float, draws: np.ndarray) -> float:
    """Fair CRPS of a sample of draws."""
    s = np.sort(draws)
    n = len(s)
    spread = (s * (2 * np.arange(1, n + 1) - n - 1)).sum() / (n * (n - 1)) if n > 1 else 0.0
    return float(np.abs(s - y).mean() - spread)


def crps_gaussian(y, mean, sd):
    return sd * norm_crps((y - mean) / sd)


def clip01(x):
    return np.clip(x, EPS, 1 - EPS)
