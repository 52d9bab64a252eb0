"""Nodes for missing rows, laid per gap.

A missing observation is integrated by the midpoint rule in a variable in which what is
integrated is smooth and nowhere narrower than a few steps: sums over equal steps of a
bell-shaped function are exact to many digits once the step is about its width, so the
step follows the *conditional width*, the spread of an observation given its neighbour.  Where
dependence is almost deterministic this is a small part of the margin's spread, and nodes of that
density over the whole range would be far too many.

So positions are measured in normal scores of the stationary mixture, and each missing row
has a density of nodes of its own: a coarse one everywhere, which serves paths that change
their state inside the gap, and the fine one in windows around where a path can be that keeps
its state.  A window follows a state's conditional median and spread step by step from
the observation before the gap, from the one after it, and where both meet; outside of it
steps grow in proportion to the distance, as a jump of the density would spoil the sums.  Twice the nodes halve all steps, so that
a comparison of both tells the error (``series.node_check``).
"""

from __future__ import annotations

import numpy as np

from ..functions import numerics
from ..functions.ops import EPS, norm_cdf, norm_ppf

#: Normal scores that are covered (probabilities near one have fewer digits than those near zero), and
#: points of the mesh between them.
LOW, HIGH, MESH = -8.0, 6.5, 2901
#: A step as a share of the conditional width at 64 nodes; half-width of a window in spreads; how much
#: steps grow with the distance from it.
STEP, WINDOW, GROWTH = 0.8, 5.0, 0.2
#: Share of a value's density below which a pair of states does not count at that value.
RARE = 1e-4
#: Conditional widths of a copula, in scores of its own margins and within two of them, from which on
#: the reference grid is as good, unless an observation beside a gap has a score beyond FAR.
STRONG, FAR = 0.11, 2.0
#: Up to this many times the given nodes all rows have the same fine nodes everywhere, so that weights
#: between them are worked out once for all series of a task.
FULL = 7


class LocalGrids:
    """Grids of one model."""

    def __init__(self, model, kernels, nodes: int):
        self.model, self.k, self.nodes = model, kernels, nodes
        keys = [(i, j) for i in range(model.K) for j in range(model.K if model.is_pair else 1)]
        mass = np.array([model.p[i, j] if model.is_pair else model.pi[i] for i, j in keys])
        laws = [model.margin(i, j) for i, j in keys]
        self.mass, self.laws = mass / mass.sum(), laws
        self.z = np.linspace(LOW, HIGH, MESH)
        lo, hi = min(f.ppf(1e-17).item() for f in laws), max(f.ppf(1 - 1e-13).item() for f in laws)
        self.y = numerics.invert(self._cdf, norm_cdf(self.z), lo, hi, 90)
        self._conditionals()

    def _cdf(self, y):
        return sum(a * f.cdf(y) for a, f in zip(self.mass, self.laws, strict=True))

    def _pdf(self, y):
        return sum(a * f.pdf(y) for a, f in zip(self.mass, self.laws, strict=True))

    def score(self, y) -> np.ndarray:
        """Normal scores of observations."""
        return norm_ppf(np.clip(self._cdf(np.asarray(y, float)), 1e-15, 1 - 1e-11))

    def _conditionals(self) -> None:
        """Medians and spreads of a neighbour's score given a score, per dependent pair, and the
        fine density of nodes."""
        at = np.linspace(LOW, HIGH, 291)
        y = np.interp(at, self.z, self.y)
        self.pairs, least = {}, np.full(len(at), 1.0)
        whole = np.maximum(self._pdf(y), 1e-300)
        for (i, j), (fam, p) in self.k.cop.items():
            if fam.independent:
                continue
            u = np.clip(self.model.margin(i, j).cdf(y), EPS, 1 - EPS)
            other = self.model.margin(j, i)
            low, mid, high = (self.score(other.ppf(np.clip(fam.inv_h(np.full(len(u), q), u, p), EPS, 1 - EPS))) for q in (0.158655, 0.5, 0.841345))
            spread = np.clip((high - low) / 2, 0.002, 1.0)
            self.pairs[(i, j)] = mid, spread, np.gradient(mid, at)
            # a state that hardly ever has such values needs no nodes there
            share = self.model.p[i, j] * self.model.margin(i, j).pdf(y) / whole
            least = np.where(share > RARE, np.minimum(least, spread), least)
        # the least of the neighbourhood, then smooth over neighbours, so that the density of nodes is
        near = np.lib.stride_tricks.sliding_window_view(np.pad(np.log(least), 6, mode="edge"), 13).min(axis=1)
        kernel = np.hanning(35)[1:-1] / np.hanning(35).sum()
        least = np.exp(np.convolve(np.pad(near, 16, mode="edge"), kernel, mode="valid"))
        #: Whether the reference grid, whose nodes are the same for all rows, is too coarse.
        v = norm_cdf(np.linspace(-2, 2, 61))
        own = [(norm_ppf(fam.inv_h(np.full(61, 0.841345), v, p)) - norm_ppf(fam.inv_h(np.full(61, 0.158655), v, p))).min() / 2 for fam, p in self.k.cop.values() if not fam.independent]
        self.strong = min(own, default=1.0) < STRONG
        self.at = at
        self.fine = 1 / (STEP * 64 / self.nodes * np.interp(self.z, at, least))
        self.coarse = self.nodes / (2 * HIGH)
        # where the fine density is affordable over the whole range there is no need for windows, and
        # all rows have the same nodes
        self.row = self.reference = None
        self.whole = float(np.trapezoid(self.fine, self.z)) <= FULL * self.nodes

    def path(self, z: float, steps: int) -> list[list[tuple[float, float]]]:
        """Per step and state that may stay: where a path from score ``z`` is, and its spread."""
        out, now = [], {k: (float(z), 0.0) for k in self.pairs if k[0] == k[1]}
        for _ in range(steps):
            for k, (m, v) in now.items():
                mid, spread, slope = (float(np.interp(m, self.at, x)) for x in self.pairs[k])
                now[k] = mid, slope * slope * v + spread * spread
            out.append([(m, v**0.5) for m, v in now.values()])
        return out

    def gap(self, before: float | None, after: float | None, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(nodes, log weights)`` of each row of a gap between two observations (``None``: the
        series' end)."""
        ahead = self.path(self.score(before), length) if before is not None else [[]] * length
        back = self.path(self.score(after), length)[::-1] if after is not None else [[]] * length
        out = []
        for left, right in zip(ahead, back, strict=True):
            windows = left + right
            for (m, s), (n, t) in zip(left, right):  # where both meet
                a, b = 1 / (s * s), 1 / (t * t)
                windows.append(((a * m + b * n) / (a + b), (a + b) ** -0.5))
            out.append(self.nodes_of(windows))
        return out

    def nodes_of(self, windows: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        z = self.z
        if self.whole:
            density = (self.fine**4 + self.coarse**4) ** 0.25
        else:
            power = np.full(MESH, self.coarse**4)
            for m, s in windows:  # steps grow with the distance from a window
                out = np.sqrt((z - m) ** 2 + (WINDOW * s) ** 2) - WINDOW * s
                power += (1 / self.fine + GROWTH * out) ** -4.0
            density = power**0.25
        d = z[1] - z[0]
        bend = np.gradient(density, d)
        place = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2 * d - d * d / 12 * np.diff(bend))])
        count = int(np.ceil(place[-1]))
        # equal steps of a place in which the whole range has a whole number of nodes, each found between
        # two points of the mesh by a cubic with the right slopes
        step = place[-1] / count
        want = (np.arange(count) + 0.5) * step
        i = np.clip(np.searchsorted(place, want, "right") - 1, 0, MESH - 2)
        wide = place[i + 1] - place[i]
        t, s0, s1 = (want - place[i]) / wide, wide / density[i] / d, wide / density[i + 1] / d
        at = z[i] + d * (t * t * (3 - 2 * t) + s0 * t * (1 - t) ** 2 - s1 * t * t * (1 - t))
        rate = d / wide * (6 * t * (1 - t) + s0 * (1 - t) * (1 - 3 * t) + s1 * t * (3 * t - 2))
        y = np.interp(at, z, self.y)
        g = np.maximum(self._pdf(y), 1e-300)
        y = np.clip(y - (self._cdf(y) - norm_cdf(at)) / g, self.y[np.maximum(i - 1, 0)], self.y[np.minimum(i + 2, MESH - 1)])
        slope = np.exp(-0.5 * at * at) / np.sqrt(2 * np.pi) / np.maximum(self._pdf(y), 1e-300)
        return y, np.log(np.maximum(slope * rate * step, 1e-300))


def runs(miss: np.ndarray) -> list[tuple[int, int]]:
    """First row and length of each run of missing rows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], miss, [False]]).astype(int)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
