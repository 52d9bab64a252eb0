"""Choosing starts, margin families and models.

``kmeans_start`` finds groups of observations by Lloyd's rounds, each one aggregation over
the table.  ``margin_scores`` fits and scores candidate families of every state by one pass
of weighted sums and one of likelihoods and distances.  ``comparison_matrix`` sets families
against each other per group, and ``confidence_set`` keeps those that none beats.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.copulas import DEFAULT_CANDIDATES, FAMILIES
from ..functions.margins import Margin, fit_moments
from ..functions.ops import norm_ppf
from ..plans.model import Model
from . import fit as fitting
from . import stats
from .grouped import _xy, per_group
from .missing import assignment, canonical


def kmeans(df: DataFrame, K: int, max_iter: int = 50, tol: float = 1e-9) -> list[tuple[float, float, float]]:
    """``(centre, sd, share)`` of K groups of ``y``, centres ascending.  Centres start at normal
    quantiles of the table's mean and spread; missing rows take no part."""
    rows = df.select(canonical(F.col("y")).alias("y")).where("y IS NOT NULL")
    first = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if not first["n"]:
        raise ValueError("no observations")
    centres = first["m"] + first["s"] * norm_ppf((np.arange(K) + 0.5) / K)
    groups: list[tuple[float, float, float]] = []

    def packed(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": [pdf["y"].to_numpy(float).tobytes()]})

    def sums(at: np.ndarray):
        """Per task and group: rows, and sums of their distances from the centre and of the squares."""

        def run(parts):
            total = np.zeros((K, 3))
            for part in parts:
                y = np.frombuffer(part, float)
                near = np.abs(y[:, None] - at).argmin(axis=1)
                d = y - at[near]
                total += np.stack([np.bincount(near, weights=w, minlength=K) for w in (None, d, d * d)], axis=1)
            return [total]

        return run

    # many short rounds: packed once, they are spared a plan each
    held = rows.mapInPandas(packed, "y binary").rdd.map(lambda r: bytes(r["y"])).persist()
    try:
        for _ in range(max_iter):
            total = sum(held.mapPartitions(sums(centres)).collect())  # K x 3 numbers a task
            n = np.maximum(total[:, 0], 1.0)
            shift = total[:, 1] / n
            new = centres + shift
            sd = np.sqrt(np.maximum(total[:, 2] / n - shift**2, 0.0))
            groups = list(zip(new.tolist(), sd.tolist(), (total[:, 0] / first["n"]).tolist(), strict=True))
            moved, centres = float(np.abs(shift).max()), new
            if moved <= tol:
                break
    finally:
        held.unpersist()
    return sorted(groups)


def kmeans_start(df: DataFrame, model: Model, max_iter: int = 50) -> Model:
    """A start whose state margins are those of k-means groups; a group becomes the state
    whose mean in ``model`` is nearest, all groups taken together."""
    K = model.K
    groups = kmeans(df, K, max_iter)
    means = [np.mean([model.margin(i, j).moments()[0] for j in range(K)]) for i in range(K)]
    named = assignment(np.abs(np.array(means)[:, None] - np.array([g[0] for g in groups])[None]))
    margins = {}
    for key, m in model.margins.items():
        centre, sd, _ = groups[named[key[0]]]
        margins[key] = fit_moments(m.dist, centre, max(sd, 1e-6) ** 2, m.params)
    return replace(model, margins=margins)


def margin_scores(df: DataFrame, K: int, families: tuple[str, ...] = ("norm", "logistic"), bins: int = 1024) -> DataFrame:
    """``state, family, log_lik, distance, params``: candidates fitted by the moments of ``y``
    under the posterior weights ``gamma``, with their weighted log-likelihood and Kolmogorov
    distance (at ``bins`` equal steps over the range of ``y``)."""
    rows = df.select(canonical(F.col("y")).alias("y"), "gamma").where("y IS NOT NULL")
    sums = rows.select("y", F.posexplode("gamma").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s1"), F.sum(F.col("w") * F.col("y") ** 2).alias("s2")).collect()  # K rows
    ends = rows.agg(F.min("y"), F.max("y")).first()
    laws: dict[tuple[int, str], Margin] = {}
    weight = {}
    for r in sums:
        mean = r["s1"] / r["n"]
        weight[r["i"]] = r["n"]
        for f in families:
            laws[r["i"], f] = fit_moments(f, mean, r["s2"] / r["n"] - mean**2)
    edges = np.linspace(ends[0], ends[1], bins + 1)[1:] if sums else np.zeros(0)

    def run(batches):
        for pdf in batches:
            y = pdf["y"].to_numpy(float)
            g = np.array(pdf["gamma"].tolist(), float).reshape(-1, K)
            at = np.minimum(np.searchsorted(edges, y, "left"), bins - 1)
            ll = pd.DataFrame([(i, f, -1, float((g[:, i] * law.logpdf(y)).sum())) for (i, f), law in laws.items()], columns=["state", "family", "bin", "v"])
            counts = [pd.DataFrame({"state": i, "family": "", "bin": np.arange(bins), "v": np.bincount(at, weights=g[:, i], minlength=bins)}) for i in range(K)]
            yield pd.concat([ll, *counts])

    parts = rows.mapInPandas(run, "state int, family string, bin int, v double").groupBy("state", "family", "bin").agg(F.sum("v").alias("v")).toPandas()  # K * (families + bins) rows
    out = []
    for (i, f), law in laws.items():
        own = parts[(parts["state"] == i) & (parts["bin"] >= 0)].sort_values("bin")["v"].to_numpy()
        distance = float(np.abs(np.cumsum(own) / weight[i] - law.cdf(edges)).max())
        ll = float(parts[(parts["state"] == i) & (parts["family"] == f)]["v"].sum())
        out.append((i, f, ll, distance, {k: float(v) for k, v in law.params.items()}))
    return df.sparkSession.createDataFrame(out, "state int, family string, log_lik double, distance double, params map<string,double>")


def select_margins(df: DataFrame, K: int, families: tuple[str, ...] = ("norm", "logistic"), criterion: str = "mle") -> dict[int, Margin]:
    """The best family of each state, by ``mle`` or ``kolmogorov``."""
    key = {"mle": F.desc("log_lik"), "kolmogorov": F.asc("distance")}[criterion]
    best = margin_scores(df, K, families).withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy(key, "family"))).where("place = 1")
    return {r["state"]: Margin(r["family"], dict(r["params"])) for r in best.collect()}  # K rows


def kolmogorov_distance(df: DataFrame, law: Margin) -> DataFrame:
    """``series_id, distance``: the largest gap between a series' empirical distribution and
    ``law``, by window functions where the law runs as SQL."""
    from ..functions.ops import Sql

    rows = df.select("series_id", canonical(F.col("y")).alias("y")).where("y IS NOT NULL")
    w = Window.partitionBy("series_id")
    n = F.count(F.lit(1)).over(w)
    # of equal values the first and the last place count
    low, high = (F.rank().over(w.orderBy("y")) - 1) / n, F.count(F.lit(1)).over(w.orderBy("y").rangeBetween(Window.unboundedPreceding, 0)) / n
    p = F.expr(str(law.cdf(Sql("y"))))
    return rows.select("series_id", F.greatest(F.abs(high - p), F.abs(p - low)).alias("d")).groupBy("series_id").agg(F.max("d").alias("distance"))


def comparison_matrix(df: DataFrame, families: tuple[str, ...] = DEFAULT_CANDIDATES, bandwidth: int | str = "auto", alpha: float = 0.05, how: str | None = "holm") -> DataFrame:
    """Per group, ``a, b, statistic, p_value, adjusted, preferred`` of every pair of families
    after tau inversion (Vuong)."""

    def one(pdf):
        u, v = stats.pseudo_observations(*_xy(pdf))
        logs = {f: FAMILIES[f].log_pdf(u, v, fitting.fit(f, u, v).params) for f in families}
        rows = []
        for i, a in enumerate(families):
            for b in families[i + 1 :]:
                r = stats.vuong_test(logs[a], logs[b], bandwidth=bandwidth)
                rows.append({"a": a, "b": b, "statistic": r["statistic"], "p_value": r["p_value"]})
        for r, p in zip(rows, stats.adjust([r["p_value"] for r in rows], how), strict=True):
            r["adjusted"] = p
            r["preferred"] = None if p >= alpha else (r["a"] if r["statistic"] > 0 else r["b"])
        return rows

    return per_group(df, one, "a string, b string, statistic double, p_value double, adjusted double, preferred string")


def confidence_set(matrix: DataFrame) -> DataFrame:
    """``g, family``: families that no other is preferred to."""
    sides = matrix.select("g", F.explode(F.array("a", "b")).alias("family"), "preferred")
    beaten = F.max((F.col("preferred").isNotNull() & (F.col("preferred") != F.col("family"))).cast("int"))
    return sides.groupBy("g", "family").agg(beaten.alias("beaten")).where("beaten = 0").select("g", "family")
