"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``trees`` trees gives every vector a long hash string of ``bits`` random
hyperplane signs, and keeps a segment's strings in a sorted array, stored with it.  A query descends:
a binary search in each array finds its longest-prefix matches.  Then all trees ascend
together, the matching ranges of the arrays growing bit by bit, until they
hold ``share`` of the segment's vectors (counted with repeats); the union of the
ranges are the candidates, which are scored exactly.  Prefix lengths thus vary with
how crowded the data is around a query.

For the largest inner product vectors are lifted to the largest norm by one more
component, which queries hold at zero.  Hyperplanes are drawn from a fixed seed, so
the index needs no fitting sample; every vector is indexed.

``share`` fixes recall.  The synthetic vectors are uniform on a sphere, where the
nearest of a query are hardly nearer than the rest; the default is set for a recall
above 0.9 there, and on clustered vectors much less will do (the tests hold a share of
0.05 to a recall of 0.9).

Cases: vectors null, all zero, or with null or non-finite components, and rows without an
id, take no part; a vector shorter than the longest is filled up with zeros; equal vectors are one
candidate with their smallest ids; rows that repeat an id are one candidate, with the best
of their scores; a query never finds its own id; fewer candidates
than ``k`` give them all (at least ``4 * (k + 1)`` vectors of a segment are candidates, or all of
them); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_search
from .vector_search import Plan, Segment, best

TREES, BITS, SHARE = 56, 32, 1.1


class ForestPlan(Plan):
    def __init__(self, dims: int, norm2: float, trees: int, bits: int, share: float, keep: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, dims + 1, bits))
        self.norm2, self.trees, self.bits, self.share, self.keep = norm2, trees, bits, share, keep

    def strings(self, x: np.ndarray, lifted: bool, trees: int | None = None) -> np.ndarray:
        """Hash strings as numbers, ``trees x rows``; the first bit is the highest."""
        lift = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0)) if lifted else np.zeros(len(x))
        full = np.hstack([x, lift[:, None]])
        power = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack([((full @ p > 0) * power).sum(axis=1, dtype=np.uint64) for p in self.planes[:trees]])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors are dealt to segments by the first tree's string."""
        return np.zeros(len(x), dtype=np.int32), self.strings(x, True, 1)[0].astype(np.float64)

    def index(self, x: np.ndarray) -> bytes:
        """The sorted strings of every tree, each after its tree's number so that they are one
        sorted array, then the rows in their order."""
        strings = self.strings(x, True)
        order = np.argsort(strings, axis=1, kind="stable").astype("<i4")
        return (np.take_along_axis(strings, order, axis=1) | self.numbers()).astype("<u8").tobytes() + order.tobytes()

    def numbers(self) -> np.ndarray:
        return (np.arange(self.trees, dtype=np.uint64) << np.uint64(self.bits))[:, None]

    def reach(self, q: np.ndarray) -> list[tuple[int, float, float]]:
        return [(0, -np.inf, np.inf)]  # a neighbour may have any string in one tree

    def __call__(self, q: np.ndarray, seg: Segment) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(seg.data)
        cut = 8 * n * self.trees
        strings, order = np.frombuffer(seg.index[:cut], "<u8"), np.frombuffer(seg.index[cut:], "<i4").reshape(self.trees, n)
        asked = self.strings(q, False) | self.numbers()
        need = max(self.share * n, 4.0 * self.keep)

        def ranges(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the strings lie that share ``level`` bits with each query's, per tree."""
            rest = (np.uint64(1) << (self.bits - level).astype(np.uint64)) - np.uint64(1)
            return np.searchsorted(strings, asked & ~rest, "left"), np.searchsorted(strings, asked | rest, "right")

        # all trees ascend together: ranges only grow, so the level where a query stops is found by halving
        deep, top = np.zeros(len(q), dtype=np.int64), np.full(len(q), self.bits)
        while (deep < top).any():
            level = (deep + top + 1) // 2
            low, high = ranges(level)
            enough = (high - low).sum(axis=0) >= need
            deep, top = np.where(enough, level, deep), np.where(enough, top, level - 1)
        low, high = ranges(deep)
        start = n * np.arange(self.trees)[:, None]
        low, high = low - start, high - start
        whole = (high - low == n).any(axis=0)
        scores = _dot(q, seg.data) if (high - low).sum() >= n * len(q) / 8 else None
        out = []
        seen = np.zeros(n, dtype=bool)
        for i in range(len(q)):
            if whole[i]:
                rows = np.arange(n)
            else:
                seen[:] = False
                for t in range(self.trees):
                    seen[order[t, low[t, i] : high[t, i]]] = True
                rows = np.flatnonzero(seen)
            own = _dot(q[i : i + 1], seg.data[rows])[0] if scores is None else scores[i, rows]
            out.append(best(*seg.expand(rows, own), self.keep))
        return out


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def _as_double(x: np.ndarray) -> np.ndarray:
    return x.astype("<f8") + 0.0


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, queries: str = "id % 20 = 0", trees: int = TREES, bits: int = BITS, share: float = SHARE, segment: int = 8192, block: int = 512) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score double``: each query's ``k`` nearest found."""

    def prepare(rows: DataFrame, unique: DataFrame) -> Plan:
        square = F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)")
        seen = rows.agg(F.max(square).alias("norm2"), F.max(F.size("vec")).alias("dims")).first()
        return ForestPlan(seen["dims"] or 1, seen["norm2"] or 0.0, trees, bits, share, k + 1)

    return vector_search.run(df, id_col, vec_col, _as_double, False, prepare, k, queries, "double", segment, block)
