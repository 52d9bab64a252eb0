"""Missingness patterns, fills and metrics on ``series_id, n, y``.

A pattern protects the first ``ceil(N * offset)`` rows of a series and removes
``floor(N * rate)`` of the others; it marks rows in a column ``miss``.  Random patterns
draw from a hash of the seed, the series and the row, so they do not depend on how the
table is partitioned.  A series that is too short for the pattern is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ops import Sql, norm_crps

TOL = 1e-9


def parse_cell(cell: Column) -> Column:
    """A CSV cell: empty, ``nan`` and ``na`` (any case, trimmed) are missing."""
    c = F.lower(F.trim(cell))
    return F.when(~c.isin("", "nan", "na"), c.try_cast("double"))


def canonical(y: Column) -> Column:
    """Non-finite values become null."""
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), F.lit(None).cast("double")).otherwise(y)


def uniform(*parts: Column | str) -> Column:
    """A uniform on [0, 1) from a hash of the parts: 52 bits of their MD5."""
    key = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def sized(df: DataFrame, rate: float, offset: float) -> DataFrame:
    """Adds ``len``, ``head`` (protected rows) and ``cut`` (rows to remove)."""
    w = Window.partitionBy("series_id")
    out = df.withColumn("len", F.count(F.lit(1)).over(w))
    head = F.ceil(F.col("len") * offset - TOL) if offset < 1 else F.lit(int(offset)).cast("long")
    out = out.withColumn("head", head.cast("long")).withColumn("cut", F.floor(F.col("len") * rate + TOL).cast("long"))
    short = F.raise_error(F.concat(F.lit("series "), F.col("series_id").cast("string"), F.lit(" is too short for the pattern")))
    return out.withColumn("cut", F.when(F.col("head") + F.col("cut") > F.col("len"), short.cast("long")).otherwise(F.col("cut")))


def _done(df: DataFrame, miss: Column) -> DataFrame:
    return df.withColumn("miss", F.coalesce(miss, F.lit(False))).drop("len", "head", "cut")


def aligned(df: DataFrame, rate: float, offset: float = 0.1) -> DataFrame:
    """One block right after the protected rows (blackout: all columns alike)."""
    d = sized(df, rate, offset)
    return _done(d, (F.col("n") >= F.col("head")) & (F.col("n") < F.col("head") + F.col("cut")))


def staircase(df: DataFrame, rate: float, column: int, shift: float | None = None, offset: float = 0.1) -> DataFrame:
    """Column ``column`` of a staircase: disjoint blocks one after the other, or blocks
    shifted by a share ``shift`` of the length that overlap."""
    d = sized(df, rate, offset)
    step = F.col("cut") if shift is None else F.floor(F.col("len") * shift + TOL)
    start = F.col("head") + step * column
    return _done(d, (F.col("n") >= start) & (F.col("n") < F.least(start + F.col("cut"), F.col("len"))))


def scattered(df: DataFrame, rate: float, offset: float = 0.1, seed: int = 0) -> DataFrame:
    """One block at a random place per series."""
    d = sized(df, rate, offset)
    start = F.col("head") + F.floor(uniform(str(seed), F.col("series_id")) * (F.col("len") - F.col("cut") - F.col("head") + 1)).cast("long")
    return _done(d, (F.col("n") >= start) & (F.col("n") < start + F.col("cut")))


def weighted_draw(df: DataFrame, rate: float, weight: Column | None = None, offset: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows without replacement, with probability in proportion to ``weight`` (a column of
    ``n``, ``head`` and ``len``): the smallest keys -ln(u) / w."""
    d = sized(df, rate, offset)
    w = F.lit(1.0) if weight is None else weight
    key = F.when(F.col("n") >= F.col("head"), -F.log(uniform(str(seed), F.col("series_id"), F.col("n")) + 1e-300) / w)
    d = d.withColumn("__key", key).withColumn("__r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("__key").asc_nulls_last(), "n")))
    return _done(d, F.col("__r") <= F.col("cut")).drop("__key", "__r")


def gaussian_position(mean: float = 0.5, sd: float = 0.2) -> Column:
    """Weight of a row by its place in the unprotected part."""
    place = (F.col("n") - F.col("head")) / F.greatest(F.col("len") - F.col("head"), F.lit(1))
    return F.exp(-0.5 * ((place - mean) / sd) ** 2)


def mcar_blocks(df: DataFrame, rate: float, block: int = 10, offset: float = 0.1, seed: int = 0) -> DataFrame:
    """``cut // block`` blocks at random places that do not overlap: a random order of the
    free cells between blocks places them."""
    d = sized(df, rate, offset)
    m = F.floor(F.col("cut") / block)
    free = F.col("len") - F.col("head") - m * block
    # slots 1..free+m: m of them, drawn by hash order, are blocks, the others single rows
    slots = F.transform(F.sequence(F.lit(1), F.greatest(free + m, F.lit(1))), lambda s: F.struct(uniform(str(seed), F.col("series_id"), s).alias("u"), s.alias("s")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(slots), F.lit(1), F.greatest(m, F.lit(0)).cast("int")), lambda x: x["s"]))
    heads = d.select("series_id", "len", "head", "cut").distinct().select("series_id", F.transform(chosen, lambda s, i: F.col("head") + s - 1 + i * (block - 1)).alias("starts"))
    d = d.join(heads, "series_id")
    return _done(d, F.exists("starts", lambda s: (F.col("n") >= s) & (F.col("n") < s + block))).drop("starts")


def _of_state(values: list[float], state: str) -> Column:
    """The value of a row's state, null without a state (which ``element_at`` of fixed values is not)."""
    return F.coalesce(*(F.when(F.col(state) == k, F.lit(v)) for k, v in enumerate(values)))


def state_dependent(df: DataFrame, rates: list[float], state: str = "x", seed: int = 0) -> DataFrame:
    """A row is missing with the rate of its state."""
    p = _of_state(rates, state)
    return df.withColumn("miss", uniform(str(seed), F.col("series_id"), F.col("n")) < p)


def state_markov(df: DataFrame, onset: list[float], persistence: list[float], state: str = "x", seed: int = 0) -> DataFrame:
    """A two-state mask chain per series: starts by ``onset``, lasts by ``persistence``."""
    a, b = _of_state(onset, state), _of_state(persistence, state)
    u = uniform(str(seed), F.col("series_id"), F.col("n"))
    w = Window.partitionBy("series_id").orderBy("n")
    d = df.withColumn("__first", F.row_number().over(w) == 1)
    # what a row does after an observed and after a missing one; where both are the same
    # the chain starts anew, else it keeps its state or turns it
    off = F.when(F.col("__first"), u < a / (1 - b + a)).otherwise(u < a)
    on = F.when(F.col("__first"), u < a / (1 - b + a)).otherwise(u < b)
    d = d.withColumn("__off", off).withColumn("__on", on)
    turns = F.sum(F.when(F.col("__off") & ~F.col("__on"), 1).otherwise(0)).over(w)
    d = d.withColumn("__turns", turns)
    anew = F.when(F.col("__off") == F.col("__on"), F.struct(F.col("__off").alias("at"), F.col("__turns").alias("turns")))
    d = d.withColumn("__anew", F.last(anew, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    miss = F.col("__anew.at") != ((F.col("__turns") - F.col("__anew.turns")) % 2 == 1)
    return d.withColumn("miss", miss).drop("__first", "__off", "__on", "__turns", "__anew")


def locf(df: DataFrame, y: str = "y") -> DataFrame:
    """Last observation carried forward; a leading gap takes the next one."""
    w = Window.partitionBy("series_id").orderBy("n")
    back = F.last(y, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(y, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(back, ahead))


def linear(df: DataFrame, y: str = "y") -> DataFrame:
    """Linear interpolation in ``n``; flat beyond the ends."""
    w = Window.partitionBy("series_id").orderBy("n")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(y).isNotNull(), F.col("n"))
    y0, n0 = F.last(y, ignorenulls=True).over(past), F.last(at, ignorenulls=True).over(past)
    y1, n1 = F.first(y, ignorenulls=True).over(future), F.first(at, ignorenulls=True).over(future)
    line = y0 + (y1 - y0) * (F.col("n") - n0) / F.when(n1 > n0, n1 - n0)
    return df.withColumn("filled", F.coalesce(F.col(y), line, y0, y1))


def mean_fill(df: DataFrame, y: str = "y") -> DataFrame:
    return df.withColumn("filled", F.coalesce(F.col(y), F.avg(y).over(Window.partitionBy("series_id"))))


def point_metrics(df: DataFrame, truth: str, guess: str, mask: Column, by: list[str]) -> DataFrame:
    """``rmse, mae, pearson`` on the masked rows."""
    d = F.col(guess) - F.col(truth)
    return df.where(mask).groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.corr(truth, guess).alias("pearson"))


def coverage(df: DataFrame, truth: str, lo: str, hi: str, mask: Column, by: list[str]) -> DataFrame:
    return df.where(mask).groupBy(*by).agg(F.avg(F.col(truth).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"))


def mutual_information(df: DataFrame, a: str, b: str, by: list[str], bins: int = 10) -> DataFrame:
    """Mutual information in nats on equal-width bins of each column's own range; the
    maximum has a bin of its own."""
    w = Window.partitionBy(*by)

    def binned(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, F.floor((F.col(c) - lo) / ((hi - lo) / bins))).otherwise(0)

    cells = df.select(*by, binned(a).alias("i"), binned(b).alias("j")).groupBy(*by, "i", "j").agg(F.count(F.lit(1)).cast("double").alias("k"))
    ki, kj, k = F.sum("k").over(Window.partitionBy(*by, "i")), F.sum("k").over(Window.partitionBy(*by, "j")), F.sum("k").over(w)
    return cells.withColumn("t", F.col("k") / k * F.log(F.col("k") * k / (ki * kj))).groupBy(*by).agg(F.sum("t").alias("mi"))


def crps_gaussian(df: DataFrame, mean: float, sd: float, y: str = "y") -> DataFrame:
    """Adds ``crps``, the continuous ranked probability score of a normal forecast."""
    d = df.withColumn("__z", (F.col(y) - mean) / sd)
    return d.withColumn("crps", sd * F.expr(str(norm_crps(Sql("__z"))))).drop("__z")


def error_split(df: DataFrame, truth: str, guess: str, mask: str, by: list[str]) -> DataFrame:
    """Error rates of labels 0 .. K - 1 on missing, observed and all rows, under the renaming
    of the guesses that is best on all rows.  Rows without a truth or a guess do not count."""
    df = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    table = df.groupBy(*by, F.col(truth).cast("int").alias("__t"), F.col(guess).cast("int").alias("__g"), F.col(mask).alias("__m")).agg(F.count(F.lit(1)).alias("__n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        K = int(max(pdf["__t"].max(), pdf["__g"].max())) + 1
        parts = np.zeros((2, K, K))
        np.add.at(parts, (pdf["__m"].to_numpy(bool).astype(int), pdf["__t"].to_numpy(), pdf["__g"].to_numpy()), pdf["__n"].to_numpy())
        name = assignment(-parts.sum(axis=0).T - 0.5 / K * np.eye(K))  # the true label of each guess; names stay on a tie
        right = parts[:, name, np.arange(K)].sum(axis=1)
        total = parts.sum(axis=(1, 2))
        share = lambda a, b: 1 - a / b if b else None
        row = {"error": share(right.sum(), total.sum()), "error_missing": share(right[1], total[1]), "error_observed": share(right[0], total[0])}
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **row}])

    return table.groupBy(*by).applyInPandas(run, f"{kinds}, error double, error_missing double, error_observed double")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest assignment of a square matrix: rows are added
    one by one along shortest augmenting paths with dual prices."""
    n = len(cost)
    price_row, price_col = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)  # row of each column, from 1; column 0 is the start
    for row in range(1, n + 1):
        owner[0], at = row, 0
        best, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            reduced = cost[owner[at] - 1] - price_row[owner[at]] - price_col[1:]
            better = ~done[1:] & (reduced < best[1:])
            best[1:][better], came[1:][better] = reduced[better], at
            nxt = int(np.where(done[1:], np.inf, best[1:]).argmin()) + 1
            step = best[nxt]
            price_row[owner[done]] += step
            price_col[done] -= step
            best[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = np.empty(n, dtype=int)
    out[owner[1:] - 1] = np.arange(n)
    return out
