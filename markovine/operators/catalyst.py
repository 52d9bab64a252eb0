"""The forward filter as Catalyst expressions, for models with SQL kernels.

A series becomes an ordered array of structs of densities and probabilities, and one
``aggregate`` folds it: state ``(row, messages, log-likelihood)``, the message being
normalised at the next step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ops
from ..functions.ops import Sql
from ..plans.model import Model
from . import series


def row_columns(model: Model, y: str = "y") -> dict[str, str]:
    """SQL of ``f_ij`` (densities) and ``u_ij`` (probabilities) of one observation."""
    out = {}
    for i in range(model.K):
        for j in range(model.K):
            m = model.margin(i, j)
            out[f"f{i}{j}"] = str(m.pdf(Sql(y)))
            if model.uses_copula:
                out[f"u{i}{j}"] = str(ops.clamp(m.cdf(Sql(y))))
    return out


def transition(model: Model, i: int, j: int, left: str, right: str) -> Sql:
    """SQL of the weight from state i at row ``left`` to j at row ``right``."""
    if model.is_pair:
        total = Sql("(" + " + ".join(f"{float(model.p[i, k])!r} * {left}.f{i}{k}" for k in range(model.K)) + ")")
        w = float(model.p[i, j]) * Sql(f"{left}.f{i}{j}") / total
    else:
        w = Sql(Sql.of(float(model.A[i, j])))
    w = w * Sql(f"{right}.f{j}{i}")
    if model.uses_copula:
        c = model.copula(i, j)
        if not c.family.independent:
            w = w * ops.exp(c.family.shape.log_pdf(Sql(f"{left}.u{i}{j}"), Sql(f"{right}.u{j}{i}"), c.params))
    return w


def initial(model: Model, i: int, row: str) -> str:
    if model.is_pair:
        return "(" + " + ".join(f"{float(model.p[i, k])!r} * {row}.f{i}{k}" for k in range(model.K)) + ")"
    return f"({float(model.p.sum(axis=0)[i])!r} * {row}.f{i}0)"


def forward(df: DataFrame, model: Model) -> DataFrame:
    """``series_id, log_lik, last`` (the last filtered state probabilities).

    A missing row has density one where that integrates it out; series with missing rows
    under other models, and series whose densities underflow, go through the numpy engine, as
    do models of the mask.
    """
    if model.missingness is not None:
        return series.forward(df, model)
    cols = row_columns(model)
    seen = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf"))
    parts = ((F.when(seen, F.expr(sql)).otherwise(1.0) if name[0] == "f" else F.expr(sql)).alias(name) for name, sql in cols.items())
    rows = df.select("series_id", F.struct("n", *parts, "y", (~seen).alias("miss")).alias("r"))
    arrays = rows.groupBy("series_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    K = model.K
    c = "(" + " + ".join(f"s.b{i}" for i in range(K)) + ")"
    step = ", ".join(f"'b{j}', (" + " + ".join(f"s.b{i} * {transition(model, i, j, 's.r', 'r')}" for i in range(K)) + f") / {c}" for j in range(K))
    start = ", ".join(f"'b{i}', {initial(model, i, 'rs[0]')}" for i in range(K))
    fold = f"aggregate(slice(rs, 2, size(rs)), named_struct('r', rs[0], {start}, 'll', 0D), (s, r) -> named_struct('r', r, {step}, 'll', s.ll + ln({c})))"
    whole = F.exists("rs", lambda r: r["miss"]) & F.lit(model.needs_grid)
    out = arrays.select("series_id", "rs", F.when(~whole, F.expr(fold)).alias("s"))
    out = out.select("series_id", "rs", F.expr(f"s.ll + ln({c})").alias("log_lik"), F.array(*(F.expr(f"s.b{i} / {c}") for i in range(K))).alias("last"))
    fine = F.col("log_lik").isNotNull() & ~F.isnan("log_lik")
    rest = out.where(~fine).select("series_id", F.inline("rs")).select("series_id", "n", "y")
    return out.where(fine).select("series_id", "log_lik", "last").unionByName(series.forward(rest, model))
