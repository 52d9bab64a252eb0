"""Dependence statistics per group: ``g, x, y[, w]`` in, one row per group out.

Groups are the parallel dimension; inside a group the numpy kernels sort instead of
comparing all pairs where the statistic allows it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions.copulas import DEFAULT_CANDIDATES, FAMILIES
from ..functions.ops import norm_cdf
from . import fit as fitting
from . import stats
from .series import ROWS, _runs, rng_of, tasks, whole_runs


def per_group(df: DataFrame, fn: Callable[[pd.DataFrame], dict | list[dict]], schema: str) -> DataFrame:
    kind = df.schema["g"].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for pdf in whole_runs(batches, ["g"], ROWS):
            starts, out = _runs(pdf, ["g"]), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
                got = fn(pdf.iloc[a:b])
                out += [{"g": pdf["g"].iat[a], **r} for r in (got if isinstance(got, list) else [got])]
            yield pd.DataFrame(out, columns=["g", *names])

    # many small groups go through Python together
    order = [F.col(c).asc_nulls_last() for c in ("n", "x", "y") if c in df.columns]
    return df.repartition(tasks(df), "g").sortWithinPartitions("g", *order).mapInPandas(run, f"g {kind}, {schema}")


def _xy(pdf):
    return pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)


def pseudo_observations(df: DataFrame) -> DataFrame:
    """Adds ``u, v``: mid-ranks over (n + 1), by window functions."""

    def mid(c: str):
        below = F.rank().over(Window.partitionBy("g").orderBy(c))
        ties = F.count(F.lit(1)).over(Window.partitionBy("g", c))
        return (below + (ties - 1) / 2) / (F.count(F.lit(1)).over(Window.partitionBy("g")) + 1)

    return df.withColumn("u", mid("x")).withColumn("v", mid("y"))


def weighted_ecdf(df: DataFrame, value: str = "x", weight: str = "w") -> DataFrame:
    """Adds ``ecdf``: weight up to and with the value over (total + 1)."""
    w = Window.partitionBy("g")
    up = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("ecdf", up / (F.sum(weight).over(w) + 1))


def kendall(df: DataFrame, weight: str | None = None) -> DataFrame:
    return kendalls(df, {"tau": weight})


def kendalls(df: DataFrame, weights: dict[str, str | None]) -> DataFrame:
    """Several taus of each group in one pass: names of columns and the weights they take."""

    def one(pdf):
        x, y = _xy(pdf)
        return {name: stats.kendall_tau(x, y, pdf[w].to_numpy(float) if w else None) for name, w in weights.items()}

    return per_group(df, one, ", ".join(f"{name} double" for name in weights))


def copula_statistics(df: DataFrame, family: str = "FGM") -> DataFrame:
    """Cramer-von Mises distance to independence, exchangeability and radial symmetry, and the distance
    to independence of what the ``family``, fitted by tau, leaves of the dependence."""
    f = FAMILIES[family]

    def one(pdf):
        x, y = _xy(pdf)
        u, v = stats.pseudo_observations(x, y)
        return {
            "cvm": stats.cvm_statistic(u, v, lambda a, b: a * b),
            "exchangeability": stats.exchangeability_statistic(u, v),
            "radial_symmetry": stats.radial_symmetry_statistic(u, v),
            "rosenblatt": stats.rosenblatt_statistic(u, f.h(v, u, f.params(f.clip_tau(stats.kendall_tau(x, y))))),
        }

    return per_group(df, one, "cvm double, exchangeability double, radial_symmetry double, rosenblatt double")


def tau_fits(df: DataFrame, families=("Gauss", "Clayton", "GH", "FGM")) -> DataFrame:
    """Families fitted by inverting the sample tau (clipped into each family's range)."""

    def one(pdf):
        x, y = _xy(pdf)
        tau = stats.kendall_tau(x, y)
        return [{"family": f, "tau": tau, "theta": FAMILIES[f].params(tau)["theta"]} for f in families]

    return per_group(df, one, "family string, tau double, theta double")


def fit_best(df: DataFrame, families=DEFAULT_CANDIDATES, method: str = "tau", criterion: str = "aic") -> DataFrame:
    def one(pdf):
        u, v = stats.pseudo_observations(*_xy(pdf))
        ranked = fitting.fit_best(u, v, families, method, criterion=criterion)
        return [{"place": i + 1, "family": r.family, "tau": r.tau, "log_lik": r.log_lik, "aic": r.aic, "bic": r.bic} for i, r in enumerate(ranked)]

    return per_group(df, one, "place int, family string, tau double, log_lik double, aic double, bic double")


def gof_replicates(df: DataFrame, family: str, B: int = 99, seed: int = 0) -> DataFrame:
    """``g, statistic, tau, t``: a group's CvM statistic beside that of every replicate, a row each."""
    def observed(pdf):
        u, v = stats.pseudo_observations(*_xy(pdf))
        r = fitting.fit(family, u, v)
        return {"statistic": stats.cvm_statistic(u, v, lambda a, b: FAMILIES[family].cdf(a, b, r.params)), "tau": r.tau, "size": len(u)}

    base = per_group(df, observed, "statistic double, tau double, size int")
    # there are few groups and many replicates: each is dealt by itself
    each = base.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B)))).repartition(4 * tasks(df), "g", "b")

    def replicate(batches):
        for pdf in batches:
            hits = []
            for g, tau, size, b in zip(pdf["g"], pdf["tau"], pdf["size"], pdf["b"], strict=True):
                s = int(rng_of(seed, f"{g}:{b}").integers(1 << 31))
                hits.append(fitting.gof_replicate(family, tau, {}, int(size), s))
            yield pdf.assign(t=hits)[["g", "statistic", "tau", "t"]]

    kind = df.schema["g"].dataType.simpleString()
    return each.mapInPandas(replicate, f"g {kind}, statistic double, tau double, t double")


def gof_bootstrap(df: DataFrame, family: str, B: int = 99, seed: int = 0) -> DataFrame:
    """Parametric bootstrap of the CvM statistic."""
    runs = gof_replicates(df, family, B, seed)
    ok = F.sum(F.when(~F.isnan("t"), 1).otherwise(0))
    over = F.sum(F.when(~F.isnan("t") & (F.col("t") >= F.col("statistic")), 1).otherwise(0))
    return runs.groupBy("g", "statistic", "tau").agg(((1 + over) / (1 + ok)).alias("p_value"))


def ljung_box(df: DataFrame, lags: int = 5) -> DataFrame:
    """``q`` per group over ``n``-ordered ``x``: lagged products by window functions."""
    w = Window.partitionBy("g")
    d = df.withColumn("z", F.col("x") - F.avg("x").over(w))
    o = w.orderBy("n")
    sums = [F.sum(F.col("z") * F.col(f"z{k}")).alias(f"s{k}") for k in range(1, lags + 1)]
    for k in range(1, lags + 1):
        d = d.withColumn(f"z{k}", F.lag("z", k).over(o))
    a = d.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("z") * F.col("z")).alias("s0"), *sums)
    q = sum(((F.col(f"s{k}") / F.col("s0")) ** 2 / (F.col("m") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return a.select("g", (F.col("m") * (F.col("m") + 2) * q).alias("q"))


def neyman(df: DataFrame, u: str = "u") -> DataFrame:
    """Orthonormal Legendre components of probabilities."""
    z = 2 * F.col(u) - 1
    polys = [z, (3 * z * z - 1) / 2, (5 * z * z * z - 3 * z) / 2, (35 * z * z * z * z - 30 * z * z + 3) / 8]
    return df.groupBy("g").agg(*((F.sum(p) * float(np.sqrt(2 * k + 1)) / F.sqrt(F.count(F.lit(1)))).alias(f"v{k}") for k, p in enumerate(polys, 1)))


def vuong(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two families compared per group after tau inversion: Vuong and Clarke."""

    def one(pdf):
        u, v = stats.pseudo_observations(*_xy(pdf))
        tau = stats.kendall_tau(u, v)
        la, lb = (FAMILIES[f].log_pdf(u, v, fitting.fit(f, u, v, tau=tau).params) for f in (a, b))
        r, c = stats.vuong_test(la, lb), stats.clarke_test(la, lb)
        return {"statistic": r["statistic"], "p_value": r["p_value"], "clarke": c["statistic"], "clarke_p": c["p_value"]}

    return per_group(df, one, "statistic double, p_value double, clarke double, clarke_p double")


def kernel_means(points: DataFrame, families: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """``family, part, n, pdf, h, cdf``: means of density, conditional and joint distribution of
    families with given parameters over points ``part, u, v``; tasks send sums."""

    def run(batches):
        for pdf in batches:
            for part, rows in pdf.groupby("part"):
                u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
                out = [(name, part, len(u), float(np.exp(f.log_pdf(u, v, p)).sum()), float(f.h(v, u, p).sum()), float(f.cdf(u, v, p).sum())) for name, p in families for f in [FAMILIES[name]]]
                yield pd.DataFrame(out, columns=["family", "part", "n", "pdf", "h", "cdf"])

    sums = points.mapInPandas(run, f"family string, part {points.schema['part'].dataType.simpleString()}, n long, pdf double, h double, cdf double")
    n = F.sum("n")
    return sums.groupBy("family", "part").agg(n.alias("n"), *((F.sum(k) / n).alias(k) for k in ("pdf", "h", "cdf")))


def tau_reached(taus: DataFrame, families: list[tuple[str, float]], extras: dict, close: float = 0.01) -> DataFrame:
    """``g, family, tau, reached``: every family at a group's ``tau`` (times the family's sign, clipped
    into its range), and whether its density has that tau by quadrature."""

    def run(batches):
        x, w = numerics.gauss_legendre(160)
        t = np.clip(x**3 / (x**3 + (1 - x) ** 3), 1e-5, 1 - 1e-5)  # denser towards the corners
        w = w * 3 * x**2 * (1 - x) ** 2 / (x**3 + (1 - x) ** 3) ** 2
        u, v = (z.reshape(-1) for z in np.meshgrid(t, t))
        mass, e = np.outer(w, w).reshape(-1), 1e-6
        up, down = np.minimum(v + e, 1 - 1e-12), np.maximum(v - e, 1e-12)
        for pdf in batches:
            got = []
            for name, sign, tau in zip(pdf["family"], pdf["sign"], pdf["tau"], strict=True):
                f = FAMILIES[name]
                c = f.clip_tau(sign * tau)
                p = f.params(c, extras.get(name))
                other = (f.cdf(u, up, p) - f.cdf(u, down, p)) / (up - down)
                got.append((c, bool(abs(1 - 4 * float((f.h(v, u, p) * other * mass).sum()) - c) < close)))
            yield pd.DataFrame({"g": pdf["g"], "family": pdf["family"], "tau": [c for c, _ in got], "reached": [r for _, r in got]})

    each = F.explode(F.array(*(F.struct(F.lit(n).alias("family"), F.lit(s).alias("sign")) for n, s in families)))
    rows = taus.select("g", "tau", each.alias("f")).select("g", "tau", "f.family", "f.sign").repartition("g", "family")
    return rows.mapInPandas(run, f"g {taus.schema['g'].dataType.simpleString()}, family string, tau double, reached boolean")


def elliptical_means(pairs: DataFrame, tau: float, df: float) -> DataFrame:
    """``family, part, n, log_pdf``: mean log densities of the Gauss and the Student copula where
    their own margins have the quantiles ``x, y``."""

    def run(batches):
        for pdf in batches:
            for part, rows in pdf.groupby("part"):
                x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
                gauss = FAMILIES["Gauss"].log_pdf(norm_cdf(x), norm_cdf(y), FAMILIES["Gauss"].params(tau))
                student = FAMILIES["Student"].log_pdf(numerics.t_cdf(x, df), numerics.t_cdf(y, df), FAMILIES["Student"].params(tau, {"df": df}))
                yield pd.DataFrame({"family": ["Gauss", "Student"], "part": part, "n": len(x), "log_pdf": [float(gauss.sum()), float(student.sum())]})

    sums = pairs.mapInPandas(run, f"family string, part {pairs.schema['part'].dataType.simpleString()}, n long, log_pdf double")
    return sums.groupBy("family", "part").agg(F.sum("n").alias("n"), (F.sum("log_pdf") / F.sum("n")).alias("log_pdf"))
