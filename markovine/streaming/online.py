"""The forward filter and outlier gate over a stream.

State per series: the filtered message and the last observation (which tells whether it
was missing, as a Markov mask needs), so a micro-batch adds rows in O(K) memory per key.  Rows of a series must arrive in order of ``n``; a row that
comes late (``n`` not above the last one) is reported with a null posterior, as
re-filtering would need the whole past.  Only models without a quadrature grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.engine import Kernels, _logsumexp
from ..plans.model import Model


def filter_step(model: Model, state: tuple | None, y: float) -> tuple[tuple, float]:
    """The next ``(last y, log message, log-likelihood)`` and the log predictive density."""
    k = Kernels(model)
    gap = not np.isfinite(y)
    logf = np.zeros((1, model.K, model.K)) if gap else k.logf(np.array([y]))
    if state is None:
        a = k.initial(logf)[0]
        total = 0.0
    else:
        last, message, total = state
        left = np.zeros((1, model.K, model.K)) if not np.isfinite(last) else k.logf(np.array([last]))
        w = k.state(left)[0] + logf[0].T
        if k.cop and not gap and np.isfinite(last):
            u, v = k.cdf(np.array([last]))[0], k.cdf(np.array([y]))[0]
            for (i, j), (fam, p) in k.cop.items():
                if not fam.independent:
                    w[i, j] += float(fam.log_pdf(u[i, j], v[j, i], p))
        a = _logsumexp(np.asarray(message)[:, None] + w, 0)
    if model.missingness is not None:
        past = [] if state is None else [not np.isfinite(state[0])]
        a = a + model.missingness.log_evidence(np.array([*past, gap]))[-1]
    c = float(_logsumexp(a, 0))
    return (float(y), (a - c).tolist(), total + c), c


def online_filter(stream: DataFrame, model: Model) -> DataFrame:
    """``series_id, n, filtered, log_predictive`` for a streaming ``series_id, n, y``."""
    kind = stream.schema["series_id"].dataType.simpleString()

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        own = (held[0], list(held[1]), held[2]) if held else None
        at = held[3] if held else -1
        rows = pd.concat(list(batches)).sort_values("n", kind="stable")
        out = []
        for n, y in zip(rows["n"], rows["y"], strict=True):
            if n <= at:
                out.append((key[0], n, None, None))
                continue
            value = float(y) if y is not None else float("nan")
            if model.needs_grid and not np.isfinite(value):
                raise ValueError("this model integrates missing rows on a grid")
            own, c = filter_step(model, own, value)
            at = int(n)
            out.append((key[0], n, np.exp(own[1]).tolist(), c))
        if own is not None:
            state.update((own[0], own[1], own[2], at))
        yield pd.DataFrame(out, columns=["series_id", "n", "filtered", "log_predictive"])

    return stream.groupBy("series_id").applyInPandasWithState(
        update,
        f"series_id {kind}, n long, filtered array<double>, log_predictive double",
        "last double, message array<double>, total double, at long",
        "append",
        "NoTimeout",
    )
