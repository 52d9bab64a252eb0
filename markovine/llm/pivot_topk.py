"""Exact top-k inner products through a pivot-distance index.

Components become ``floor(scale * x)``, so scores are integers and exact.  The largest
inner product is the nearest neighbour after one more component lifts every vector to
the largest norm ``M``: ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``.  Vectors are keyed by
their nearest pivot and their distance to it.  In a segment the vectors of a pivot
are cut into annuli, sorted by distance; a query starts with the annulus its own
distance falls in and expands to both sides.  By the triangle inequality nothing in
an annulus ``[lo, hi]`` is nearer than ``max(lo - d, d - hi)``, so the expansion stops
once that exceeds the distance of the k-th best score.  The stopping radius starts
from exact scores against a bounded sample of vectors and shrinks as results come; with
the first radius, blocks of queries are matched to the segments they can reach before any
vector is sent.

On vectors without cluster structure (the synthetic ones are uniform on a sphere) the
bounds exclude little, and the cost approaches that of all queries against all rows;
results are exact in any case.

Cases: vectors null or with null or non-finite components, and rows without an id, take
no part; a vector shorter than the longest is filled up with zeros; equal vectors are one candidate
with their smallest ids; a query never finds its own id, rows that repeat an id are
one candidate, with the best of their scores; fewer candidates than ``k`` give them all; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_search
from .vector_search import Plan, Segment, best

PIVOTS, SEEDS, ANNULUS = 32, 2048, 256


def quantized(scale: float):
    def as_key(x: np.ndarray) -> np.ndarray:
        return np.floor(scale * x.astype("<f8")) + 0.0  # integers below 2^53 are exact; no minus zero

    return as_key


class PivotPlan(Plan):
    def __init__(self, pivots: np.ndarray, norm2: float, seeds: np.ndarray, seed_counts: np.ndarray, keep: int):
        self.pivots, self.norm2, self.seeds, self.seed_counts, self.keep = pivots, norm2, seeds, seed_counts, keep

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to the lifted pivots, of lifted data or of queries."""
        own = (x * x).sum(axis=1)
        dot = x @ self.pivots.T
        if lifted:
            lift = np.sqrt(np.maximum(self.norm2 - own, 0))
            dot = dot + lift[:, None] * np.sqrt(np.maximum(self.norm2 - (self.pivots**2).sum(axis=1), 0))[None]
            own = np.full(len(x), self.norm2)
        return np.sqrt(np.maximum(own[:, None] + self.norm2 - 2 * dot, 0))

    def _near(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._near(self.distances(x, lifted=True))

    def place_query(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._near(self.distances(x, lifted=False))

    def floor(self, q: np.ndarray) -> np.ndarray:
        """A lower bound of each query's k-th best score: a seed stands for as many ids as it has."""
        floor = np.full(len(q), -np.inf)
        if len(self.seeds):
            scores = q @ self.seeds.T
            order = np.argsort(-scores, axis=1)
            enough = np.cumsum(self.seed_counts[order], axis=1) >= self.keep
            has = enough.any(axis=1)
            at = order[np.arange(len(q)), enough.argmax(axis=1)]
            floor[has] = scores[np.arange(len(q)), at][has]
        return floor

    def radius(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        own = (q * q).sum(axis=1)
        slack = 1e-9 * np.sqrt(self.norm2 + own.max(initial=0) + 1)
        return np.sqrt(np.maximum(own + self.norm2 - 2 * floor, 0)) + slack

    def reach(self, q: np.ndarray) -> list[tuple[int, float, float]]:
        d, r = self.distances(q, lifted=False), self.radius(q, self.floor(q))[:, None]
        low, high = (d - r).min(axis=0), (d + r).max(axis=0)
        return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(low, high, strict=True))]

    def __call__(self, q: np.ndarray, seg: Segment) -> list[tuple[np.ndarray, np.ndarray]]:
        floor = self.floor(q)
        reach = self.distances(q, lifted=False)
        own = (q * q).sum(axis=1)
        # annuli of this segment: runs of one pivot, cut by distance
        edges = np.flatnonzero(np.concatenate([[True], np.diff(seg.major) != 0, [True]]))
        annuli = [(int(seg.major[a]), i, min(i + ANNULUS, int(b))) for a, b in zip(edges, edges[1:], strict=False) for i in range(int(a), int(b), ANNULUS)]
        lo = np.array([seg.minor[i] for _, i, _ in annuli])
        hi = np.array([seg.minor[j - 1] for _, _, j in annuli])
        d = reach[:, [p for p, _, _ in annuli]]
        gap = np.maximum(np.maximum(lo[None] - d, d - hi[None]), 0)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in q]
        slack = 1e-9 * np.sqrt(self.norm2 + own.max(initial=0) + 1)
        # annuli in the order in which queries reach them: each round takes every query's next one
        order = np.argsort(gap, axis=1, kind="stable")
        active = np.arange(len(q))
        for step in range(len(annuli)):
            if not len(active):
                break
            nxt = order[active, step]
            radius = np.sqrt(np.maximum(own[active] + self.norm2 - 2 * floor[active], 0))
            alive = ~(gap[active, nxt] > radius + slack)
            active, nxt = active[alive], nxt[alive]
            for a in np.unique(nxt):
                who = active[nxt == a]
                _, i, j = annuli[a]
                scores = q[who] @ seg.data[i:j].T
                for w, s in zip(who.tolist(), scores, strict=True):
                    rows = np.flatnonzero(s >= floor[w])
                    if len(rows):
                        ids, own_scores = seg.expand(i + rows, s[rows])
                        ids, own_scores = best(np.concatenate([found[w][0], ids]), np.concatenate([found[w][1], own_scores]), self.keep)
                        found[w] = ids, own_scores
                        if len(ids) == self.keep:
                            floor[w] = max(floor[w], own_scores[-1])
        return found


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, k: int = 20, queries: str = "id % 20 = 0", segment: int = 8192, block: int = 512) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score long``: each query's ``k`` largest integer
    inner products.  ``queries`` is an SQL condition on ``id``."""

    def prepare(rows: DataFrame, unique: DataFrame) -> Plan:
        drawn = unique.orderBy(F.xxhash64("key"), "key").limit(SEEDS).select("key", "ids").collect()
        seeds = np.array([np.frombuffer(r["key"], "<f8") for r in drawn]) if drawn else np.zeros((0, 1))
        # ids that only one of them has: no id may count twice towards a query's first bound
        own = Counter(i for r in drawn for i in r["ids"])
        counts = np.array([sum(own[i] == 1 for i in r["ids"]) for r in drawn], dtype=np.int64)
        square = F.expr("aggregate(vec, 0D, (s, x) -> s + floor({0} * x) * floor({0} * x))".format(scale))
        norm2 = rows.agg(F.max(square)).first()[0] or 0.0
        return PivotPlan(seeds[:PIVOTS], float(norm2), seeds, counts, k + 1)

    return vector_search.run(df, id_col, vec_col, quantized(scale), True, prepare, k, queries, "bigint", segment, block)
