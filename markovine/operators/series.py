"""Sequence operators over a table ``series_id, n, y`` (vectors: ``y array<double>``).

Series are the parallel dimension: a task gets whole series in order and steps through
many of them at once.  ``nodes`` is the size of the grid that missing rows are integrated
on where a model needs one; ``node_check`` tells whether it is large enough.  A series that is too long for one task goes through ``classify_blocks``, which
cuts it into stretches at observed rows, reduces each to a K x K transfer matrix, scans
the short list of matrices per series, and finishes the stretches in parallel.

A null, NaN or infinite ``y`` is a missing observation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import Model
from .engine import NODES, Batch, Chain, _logsumexp, flag_all, flag_outliers, mixture_summary, simulate, simulate_many


def values(pdf: pd.DataFrame) -> np.ndarray:
    """The observations of one series as floats; nulls become NaN."""
    col = pdf["y"]
    if col.dtype == object and len(col) and any(isinstance(v, (list, np.ndarray)) for v in col):
        d = max(len(v) for v in col if v is not None)
        return np.array([np.full(d, np.nan) if v is None else np.array([np.nan if x is None else x for x in v], float) for v in col])
    return col.to_numpy(float)


def per_series(df: DataFrame, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn(rows in order, observations)`` to each series."""
    kind = df.schema["series_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        out = fn(pdf, values(pdf))
        out.insert(0, "series_id", [pdf["series_id"].iloc[0]] * len(out))
        return out

    return df.groupBy("series_id").applyInPandas(run, f"series_id {kind}, {schema}")


#: Rows that a task steps through together.
ROWS = 1 << 16


def tasks(df: DataFrame) -> int:
    """How many tasks Python work is dealt to: as few bytes may be much work, their number is not left
    to the size of the data."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _runs(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for c in keys:
        names = pd.factorize(pdf[c], use_na_sentinel=False)[0]
        new[1:] |= names[1:] != names[:-1]
    return np.flatnonzero(new)


def whole_runs(batches, keys: list[str], rows: int):
    """Join batches of sorted rows into frames of about ``rows`` that end with a run of keys."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held and sum(map(len, held)) >= rows:
            pair = pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]], ignore_index=True)
            same = len(_runs(pair, keys)) == 1
            starts = _runs(pdf, keys)
            if not same or len(starts) > 1:
                # the first run of this piece may go on from what is held
                end = int(starts[1]) if same else 0
                yield pd.concat([*held, pdf.iloc[:end]], ignore_index=True)
                held, pdf = [], pdf.iloc[end:]
        held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def dealt(df: DataFrame) -> DataFrame:
    """Whole series in order, dealt to tasks: what ``in_batches`` reads, for those that read it again."""
    rows = df.select("series_id", F.col("n").cast("long").alias("n"), "y", *(["miss"] if "miss" in df.columns else []))
    return rows.repartition(tasks(df), "series_id").sortWithinPartitions("series_id", "n")


def in_batches(df: DataFrame, model: Model, fn: Callable[[pd.DataFrame, Batch], pd.DataFrame], schema: str, nodes: int = NODES, in_order: bool = False) -> DataFrame:
    """Apply ``fn(rows of whole series in order, their batch)``; it returns ``series_id`` too.  Rows that come
    from ``dealt`` are ``in_order``.

    A model of the mask takes the column ``miss`` for it, if there is one: a row without a value that
    the mask has not taken is missing all the same, but tells what a row that is there tells."""
    kind = df.schema["series_id"].dataType.simpleString()
    size, mask = ROWS, ["miss"] if model.missingness is not None and "miss" in df.columns else []

    def run(batches):
        for pdf in whole_runs(batches, ["series_id"], size):
            starts = _runs(pdf, ["series_id"])
            masked = pdf["miss"].to_numpy(bool) if mask else None
            out = fn(pdf, Batch(model, values(pdf), np.diff(np.append(starts, len(pdf))), nodes, masked=masked))
            if len(out):  # an empty column of lists has no type
                yield out

    rows = df if in_order else dealt(df)
    return rows.select("series_id", "n", "y", *mask).mapInPandas(run, f"series_id {kind}, {schema}")


def classify(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    """``n, x_hat, gamma``: posterior marginal and its most probable state (ties to the
    lowest)."""

    def batch(pdf, b):
        g = b.gamma()
        return pd.DataFrame({"series_id": pdf["series_id"], "n": pdf["n"], "x_hat": g.argmax(axis=1), "gamma": list(g)})

    return in_batches(df, model, batch, "n long, x_hat int, gamma array<double>", nodes)


def log_likelihood(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    return in_batches(df, model, lambda pdf, b: pd.DataFrame({"series_id": pdf["series_id"].iloc[b.starts].to_numpy(), "log_lik": b.log_liks()}), "log_lik double", nodes)


def pair_posteriors(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    """``n, xi``: row-major K x K posterior of the states at n and n+1."""

    def batch(pdf, b):
        xi = b.xi().reshape(-1, model.K**2)
        inner = np.ones(len(pdf), bool)
        inner[b.starts + b.sizes - 1] = False
        return pd.DataFrame({"series_id": pdf["series_id"][inner], "n": pdf["n"][inner], "xi": list(xi[inner[:-1]])})

    return in_batches(df, model, batch, "n long, xi array<double>", nodes)


def classify_pairs(df: DataFrame, model: Model) -> DataFrame:
    """Rows 2k and 2k + 1 as pairs that do not depend on each other: ``pair``, the row-major
    ``joint`` posterior of both states and ``log_lik``.  A last row without a partner and
    pairs with a missing row have none."""

    def batch(pdf, b):
        m = b.model
        n = pdf["n"].to_numpy()
        last = np.zeros(len(n), bool)
        last[b.starts + b.sizes - 1] = True
        at = np.flatnonzero((n % 2 == 0) & ~last & ~b.miss)
        at = at[~b.miss[at + 1]] if len(at) else at
        if not len(at):
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[:0], "pair": n[at], "joint": [], "log_lik": np.zeros(0)})
        w = np.log(np.maximum(m.p, 1e-300)) + b.logf[at] + np.swapaxes(b.logf[at + 1], 1, 2)
        for (i, j), (fam, p) in b.k.cop.items():
            if not fam.independent:
                w[:, i, j] += fam.log_pdf(b.cdf[at, i, j], b.cdf[at + 1, j, i], p)
        total = _logsumexp(w.reshape(len(at), b.model.K**2), 1)
        joint = np.exp(w.reshape(len(at), b.model.K**2) - total[:, None])
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy()[at], "pair": n[at] // 2, "joint": list(joint), "log_lik": total})

    return in_batches(df, model, batch, "pair long, joint array<double>, log_lik double")


def simulate_pairs(spark, model: Model, series: int, pairs: int, seed: int = 0) -> DataFrame:
    """``series_id, n, x, y`` of independent pairs: rows 2k and 2k + 1 depend on each other
    alone."""

    def run(batches):
        for pdf in batches:
            for s in pdf["id"]:
                rng = rng_of(seed, s)
                drawn = [simulate(model, 2, rng) for _ in range(pairs)]
                yield pd.DataFrame({"series_id": s, "n": np.arange(2 * pairs), "x": np.concatenate([x for x, _ in drawn]), "y": list(np.concatenate([y for _, y in drawn]))})

    kind = "array<double>" if model.d > 1 else "double"
    return spark.range(series).mapInPandas(run, f"series_id long, n long, x int, y {kind}")


def sample_posterior(df: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """A draw of the path and of missing observations; the draw depends on the seed and
    the series alone."""

    def one(pdf, y):
        x, z = Chain(model, y).sample(rng_of(seed, pdf["series_id"].iloc[0]))
        return pd.DataFrame({"n": pdf["n"].to_numpy(), "x": x, "y": list(z)})

    return per_series(df, one, f"n long, x int, y {'array<double>' if model.d > 1 else 'double'}")


def rng_of(seed: int, key) -> np.random.Generator:
    import zlib

    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def impute(df: DataFrame, model: Model, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), nodes: int = NODES) -> DataFrame:
    """``n, mean, sd, quantiles`` of each missing observation."""

    def batch(pdf, b):
        at, mean, sd, qs = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)], []
        if model.d == 1 and not model.needs_grid:
            rows = np.flatnonzero(b.miss)
            m, s, q = mixture_summary(model, b.gamma()[rows], quantiles)
            at, mean, sd, qs = [rows], [m], [s], list(q)
        else:
            for first, chain in b.around_gaps():
                for i, *r in chain.impute(quantiles):
                    at.append([first + i])
                    mean.append([r[0]])
                    sd.append([r[1]])
                    qs.append(r[2])
        rows = np.concatenate(at).astype(int)
        return pd.DataFrame({"series_id": pdf["series_id"].to_numpy()[rows], "n": pdf["n"].to_numpy()[rows], "mean": np.concatenate(mean), "sd": np.concatenate(sd), "quantiles": qs})

    return in_batches(df, model, batch, "n long, mean double, sd double, quantiles array<double>", nodes)


def node_check(df: DataFrame, model: Model, nodes: int = NODES, limit: float = 1e-3) -> DataFrame:
    """``log_lik`` with ``nodes`` and with twice as many, their ``gap`` and whether it is
    ``fine``, for every series with missing rows."""
    seen = F.max(F.col("y").isNull().cast("int")) == 1
    if model.d == 1:
        seen = F.max((F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).cast("int")) == 1
    some = df.join(df.groupBy("series_id").agg(seen.alias("gap")).where("gap").select("series_id"), "series_id")
    few, many = log_likelihood(some, model, nodes), log_likelihood(some, model, 2 * nodes).withColumnRenamed("log_lik", "finer")
    return few.join(many, "series_id").withColumn("gap", F.abs(F.col("finer") - F.col("log_lik"))).withColumn("fine", F.col("gap") <= limit)


def forward(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    """``log_lik, last`` (the last filtered state probabilities) of each series."""

    def batch(pdf, b):
        alpha, _ = b.forward()
        ends = b.starts + b.sizes - 1
        last, total = alpha[ends], np.add.reduceat(b.forward()[1], b.starts)
        for at, chain in b.rest():
            s = np.searchsorted(b.starts, at.start)
            last[s], total[s] = chain.filtered()[-1], chain.log_lik
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[b.starts].to_numpy(), "log_lik": total, "last": list(last)})

    return in_batches(df, model, batch, "log_lik double, last array<double>", nodes)


def forecast(df: DataFrame, model: Model, h: int, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95), nodes: int = NODES) -> DataFrame:
    """``step, state, mean, sd, quantiles`` of the next ``h`` observations.

    A mask model tells about the states of the rows that are there, not of those to come.
    """

    def batch(pdf, b):
        n, ends = len(b.starts), b.starts + b.sizes - 1
        alpha, _ = b.forward()
        own = pdf["series_id"].to_numpy()[b.starts]
        state, mean, sd, qs = np.empty((n, h, model.K)), np.empty((n, h)), np.empty((n, h)), [[None] * h for _ in range(n)]
        if model.d == 1 and not model.needs_grid:
            now = alpha[ends].copy()
            for at, chain in b.rest():
                now[np.searchsorted(b.starts, at.start)] = chain.filtered()[-1]
            for k in range(h):
                now = now @ model.A
                state[:, k] = now
                mean[:, k], sd[:, k], q = mixture_summary(model, now, quantiles)
                for s in range(n):
                    qs[s][k] = q[s]
        else:
            tail = np.full((h, b.y.shape[1]) if b.y.ndim == 2 else h, np.nan)
            for s in range(n):
                end = int(ends[s])
                if b.served[s] and not b.miss[end]:  # what is past is in the last row's message
                    with np.errstate(divide="ignore"):
                        chain = Chain(model.with_missingness(None), np.concatenate([b.y[end : end + 1], tail]), nodes, before=np.log(alpha[end]))
                else:
                    masked = None if b.masked is None else np.concatenate([b.masked[b.starts[s] : end + 1], np.zeros(h, bool)])
                    chain = Chain(model, np.concatenate([b.y[b.starts[s] : end + 1], tail]), nodes, blind=h, masked=masked)
                state[s] = chain.gamma()[-h:]
                for k, r in enumerate(chain.impute(quantiles)[-h:]):
                    mean[s, k], sd[s, k], qs[s][k] = r[1], r[2], r[3]
        return pd.DataFrame({"series_id": np.repeat(own, h), "step": np.tile(np.arange(1, h + 1), n), "state": list(state.reshape(-1, model.K)), "mean": mean.reshape(-1), "sd": sd.reshape(-1), "quantiles": [q for own_qs in qs for q in own_qs]})

    return in_batches(df, model, batch, "step int, state array<double>, mean double, sd double, quantiles array<double>", nodes)


def predictive_pit(df: DataFrame, model: Model, nodes: int = NODES) -> DataFrame:
    """``n, pit, p_value, log_predictive``."""

    def batch(pdf, b):
        pit, log_predictive = b.pit()
        return pd.DataFrame({"series_id": pdf["series_id"], "n": pdf["n"], "pit": pit, "p_value": 2 * np.minimum(pit, 1 - pit), "log_predictive": log_predictive})

    return in_batches(df, model, batch, "n long, pit double, p_value double, log_predictive double", nodes)


def outliers(df: DataFrame, model: Model, alpha: float = 0.01, sequential: bool = True, correction: str | None = None) -> DataFrame:
    """``n, p_value, outlier``."""

    def one(pdf, y):
        p, flag = flag_outliers(model, y, alpha, sequential, correction)
        return pd.DataFrame({"n": pdf["n"].to_numpy(), "p_value": p, "outlier": flag})

    def batch(pdf, b):
        pit, _ = b.pit()
        p = 2 * np.minimum(pit, 1 - pit)
        flag = np.zeros(len(p), bool)
        for a, n in zip(b.starts, b.sizes, strict=True):
            flag[a : a + n] = flag_all(p[a : a + n], b.miss[a : a + n], alpha, correction)
        return pd.DataFrame({"series_id": pdf["series_id"], "n": pdf["n"], "p_value": p, "outlier": flag})

    if not sequential:
        return in_batches(df, model, batch, "n long, p_value double, outlier boolean")
    return per_series(df, one, "n long, p_value double, outlier boolean")


def simulate_series(spark, model: Model, series: int, n: int, seed: int = 0) -> DataFrame:
    """``series_id, n, x, y`` of independent draws."""

    def run(batches):
        for pdf in batches:
            for s in pdf["id"]:
                x, y = simulate(model, n, rng_of(seed, s))
                yield pd.DataFrame({"series_id": s, "n": np.arange(n), "x": x, "y": list(y)})

    kind = "array<double>" if model.d > 1 else "double"
    return spark.range(series).mapInPandas(run, f"series_id long, n long, x int, y {kind}")


def simulate_like(df: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """``series_id, n, x, y``: an independent draw for every series of ``df``, of its length."""
    kind = df.schema["series_id"].dataType.simpleString()

    def draw(some):
        keys, sizes = zip(*some, strict=True)
        x, y = simulate_many(model, np.array(sizes), [rng_of(seed, k) for k in keys])
        return pd.DataFrame({"series_id": np.repeat(np.array(keys), sizes), "n": np.concatenate([np.arange(n) for n in sizes]), "x": x, "y": list(y)})

    def run(batches):
        for pdf in batches:
            some, held = [], 0
            for s, n in zip(pdf["series_id"], pdf["len"], strict=True):
                some.append((s, int(n)))
                held += int(n)
                if held >= ROWS:
                    yield draw(some)
                    some, held = [], 0
            if some:
                yield draw(some)

    sizes = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("len"))
    return sizes.mapInPandas(run, f"series_id {kind}, n long, x int, y {'array<double>' if model.d > 1 else 'double'}")


# ---------------------------------------------------------------- long series


def blocks(df: DataFrame, block: int) -> DataFrame:
    """``series_id, n, y, block, last``: stretches of about ``block`` rows that begin at an
    observed row (the first one at row 0), each holding the next one's first row too.

    Only one row per ``block`` rows of a series goes through the window.
    """
    y = F.col("y")
    if df.schema["y"].dataType.simpleString() == "array<double>":
        seen = y.isNotNull() & ~F.exists(y, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    else:
        seen = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    rows = df.select("series_id", F.col("n").cast("long").alias("n"), "y", F.floor(F.col("n") / block).alias("part"))
    # a part without any observed row belongs to the stretch before it
    start = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.min(F.when(seen, F.col("n"))))
    parts = rows.groupBy("series_id", "part").agg(start.cast("long").alias("start"))
    order = Window.partitionBy("series_id").orderBy("part")
    parts = parts.select("series_id", "part", "start", F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.max("start").over(Window.partitionBy("series_id")).alias("final"))
    rows = rows.join(parts, ["series_id", "part"])
    own = F.when(F.col("n") >= F.col("start"), F.col("start")).otherwise(F.col("earlier"))
    shared = (F.col("n") == F.col("start")) & F.col("earlier").isNotNull()
    rows = rows.withColumn("block", F.explode(F.when(shared, F.array("earlier", "start")).otherwise(F.array(own))))
    return rows.select("series_id", "n", "y", "block", (F.col("block") == F.col("final")).alias("last"))


def classify_blocks(df: DataFrame, model: Model, block: int = 8192, nodes: int = NODES) -> DataFrame:
    """``classify`` for series of any length; ``n`` must count from 0 without holes.

    Stretches meet at observed rows, where a message has K numbers whatever lies between,
    so gaps, masks and vectors are served as in ``classify``.
    """
    kind = df.schema["series_id"].dataType.simpleString()
    rows = blocks(df, block)

    size, keys = ROWS, ["series_id", "block"]

    def reduce(batches):
        for pdf in whole_runs(batches, keys, size):
            starts = _runs(pdf, keys)
            b = Batch(model, values(pdf), np.diff(np.append(starts, len(pdf))), nodes)
            first, last = (pdf["block"].to_numpy() == 0)[starts], pdf["last"].to_numpy(bool)[starts]
            m, a, c = ([np.zeros(0)] * len(starts) for _ in range(3))
            # ends of a series may be missing, so they send a message, not a matrix
            for s in np.flatnonzero(first != last).tolist():
                chain = Chain(model, b.y[starts[s] : starts[s] + b.sizes[s]], nodes)
                if first[s]:
                    a[s] = chain.forward()[0][-1][0]
                elif chain.N > 1:
                    c[s] = _logsumexp((chain.step(0) + chain.backward()[1][None, None]).reshape(model.K, -1), 1)
            middle = np.flatnonzero(~first & ~last)
            if len(middle):
                own = np.concatenate([np.arange(starts[s], starts[s] + b.sizes[s]) for s in middle.tolist()])
                for s, x in zip(middle.tolist(), Batch(model, b.y[own], b.sizes[middle], nodes).transfers(), strict=True):
                    m[s] = x.reshape(-1)
            yield pd.DataFrame({"series_id": pdf["series_id"].to_numpy()[starts], "block": pdf["block"].to_numpy()[starts], "m": m, "a": a, "b": c})

    ordered = rows.repartition("series_id", "block").sortWithinPartitions("series_id", "block", "n")
    mats = ordered.mapInPandas(reduce, f"series_id {kind}, block long, m array<double>, a array<double>, b array<double>")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, K = pdf.sort_values("block"), model.K
        ms = [np.asarray(m, float).reshape(K, K) for m in pdf["m"].iloc[1:-1]]
        a, b = [np.zeros(0)], [np.zeros(0)]
        if len(pdf) > 1:
            a.append(np.asarray(pdf["a"].iloc[0], float))
            end = np.asarray(pdf["b"].iloc[-1], float)
            b.append(end if len(end) else np.zeros(K))
            for m in ms:
                z = _logsumexp(a[-1][:, None] + m, 0)
                a.append(z - z.max())
            for m in ms[::-1]:
                z = _logsumexp(m + b[-1][None], 1)
                b.append(z - z.max())
        return pd.DataFrame({"series_id": pdf["series_id"], "block": pdf["block"], "a": a, "b": b[::-1]})

    ends = mats.groupBy("series_id").applyInPandas(scan, f"series_id {kind}, block long, a array<double>, b array<double>")

    def finish(batches):
        for pdf in whole_runs(batches, keys, size):
            starts = _runs(pdf, keys)
            none = [math.nan] * model.K
            before, after = (np.array([list(x) if x is not None and len(x) else none for x in pdf[c].iloc[starts]], float) for c in ("a", "b"))
            g = Batch(model, values(pdf), np.diff(np.append(starts, len(pdf))), nodes, before, after).gamma()
            own = np.ones(len(pdf), bool)
            own[np.append(starts[1:], len(pdf)) - 1] = pdf["last"].to_numpy(bool)[starts]  # else the next stretch's first row
            yield pd.DataFrame({"series_id": pdf["series_id"], "n": pdf["n"], "x_hat": g.argmax(axis=1), "gamma": list(g)})[own]

    joined = rows.join(ends, keys).repartition("series_id", "block").sortWithinPartitions("series_id", "block", "n")
    return joined.mapInPandas(finish, f"series_id {kind}, n long, x_hat int, gamma array<double>")
