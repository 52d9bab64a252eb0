"""Weighted distribution functions over a whole table.

A sorted prefix sum over all rows would be one task.  Here equal values are summed first (before the
shuffle), values are cut at sampled quantiles into ranges, the sums of the ranges (a bounded number of
rows) are added up, and prefix sums run inside the ranges.  The cuts decide only how
work is dealt; results are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import Model
from .engine import NODES
from .series import in_batches

#: Ranges of values, and how far their sizes may be from equal.
RANGES, SLACK = 256, 0.001


def weighted_cdf(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``key, y, cdf`` for every distinct value of ``key, y, w``: the weight of values up to ``y`` over the
    key's whole weight and one.  Rows without a value or a weight do not count."""
    each = rows.where("y IS NOT NULL AND w IS NOT NULL AND NOT isnan(y)").groupBy("key", "y").agg(F.sum("w").alias("w"))
    cuts = sorted(set(each.approxQuantile("y", [k / ranges for k in range(1, ranges)], SLACK))) if ranges > 1 else []

    @F.pandas_udf("int")
    def part(y: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), y.to_numpy(), "left").astype(np.int32))

    dealt = each.withColumn("part", part("y") if cuts else F.lit(0))
    sums = dealt.groupBy("key", "part").agg(F.sum("w").alias("own"))  # ranges times keys rows
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "part", F.coalesce(F.sum("own").over(earlier), F.lit(0.0)).alias("before"), F.sum("own").over(Window.partitionBy("key")).alias("whole"))
    upto = Window.partitionBy("key", "part").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("upto", F.sum("w").over(upto)).join(sums, ["key", "part"])
    return out.select("key", "y", ((F.col("before") + F.col("upto")) / (F.col("whole") + 1.0)).alias("cdf"))


def margin_samples(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    """``key, y, w``: what each margin is estimated on.  A state's margin takes every observed row with the
    state's posterior; a pair's takes the left rows of pairs (i, j) and the right rows of pairs (j, i), with
    half of the pair's posterior each."""

    def batch(pdf, b):
        g = b.gamma()
        out = []
        if not model.is_pair:
            out = [(f"{i}", b.y[~b.miss], g[~b.miss, i]) for i in range(model.K)]
        else:
            inner = np.ones(b.N, bool)
            inner[b.starts + b.sizes - 1] = False
            xi = np.where(inner[:-1, None, None], b.xi(), 0.0)
            left, right = ~b.miss[:-1] & inner[:-1], ~b.miss[1:] & inner[:-1]
            for i in range(model.K):
                for j in range(model.K):
                    out.append((f"{i},{j}", np.concatenate([b.y[:-1][left], b.y[1:][right]]), 0.5 * np.concatenate([xi[left, i, j], xi[right, j, i]])))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "key": np.repeat([k for k, _, _ in out], [len(y) for _, y, _ in out]), "y": np.concatenate([y for _, y, _ in out]), "w": np.concatenate([w for _, _, w in out])})

    return in_batches(df, model, batch, "key string, y double, w double", nodes).select("key", "y", "w")


def margin_cdfs(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    """Posterior-weighted distribution functions of all margins, ``key, y, cdf``."""
    return weighted_cdf(margin_samples(df, model, nodes))
