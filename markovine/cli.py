"""Command line: simulate, classify, classify-image, estimate, estimate-image,
missingness-lr-test."""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import functions as F

from .operators import estimate, image, missing, series
from .plans.model import Model
from .sources import tables


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("markovine").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _estimated(rows, model: Model, a) -> int:
    run = estimate.ice if a.algorithm == "ice" else estimate.sem
    est = run(rows, model, max_iter=a.max_iter, progress=lambda i, ll: print(f"{i}: {ll:.4f}"))
    est.model.save(a.out or "estimated.toml")
    if a.trace:
        with open(a.trace, "w") as f:
            json.dump({"converged": est.converged, "trace": estimate.trace_rows(est)}, f)
    for what, key, value in estimate.degenerate_states(est.model):
        print(f"degenerate {what} at {key}: {value:.4g}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="markovine")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("simulate", "classify", "classify-image", "estimate", "estimate-image", "missingness-lr-test"):
        p = sub.add_parser(name)
        p.add_argument("model")
        if name != "simulate":
            p.add_argument("data")
        p.add_argument("--out", default=None)
        p.add_argument("--series", default=None, help="column that names the series")
        if name == "simulate":
            p.add_argument("-n", type=int, default=None)
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--replicates", type=int, default=1)
        if name == "classify":
            p.add_argument("--ref", default=None, help="label column to score against")
        if name.startswith("estimate"):
            p.add_argument("--trace", default=None, help="file for the trace as JSON")
            p.add_argument("--algorithm", choices=("ice", "sem"), default="ice")
            p.add_argument("--max-iter", type=int, default=50)
    a = parser.parse_args(argv)
    model, spark = Model.load(a.model), _session()
    if a.command == "simulate":
        rows = series.simulate_series(spark, model, a.replicates, a.n or model.n_default, a.seed)
        tables.write_simulation(rows, a.out or "simulated")
        return 0
    if a.command.endswith("-image"):
        px = image.read_images(spark, a.data)
        h, w = (int(x) + 1 for x in px.agg(F.max("row"), F.max("col")).first())
        if a.command == "estimate-image":
            return _estimated(image.unfold(px, h, w), model, a)
        got = image.classify_image(px, model, h, w).select("row", "col", "x_hat").toPandas()
        labels = np.zeros((h, w), dtype=int)
        labels[got["row"], got["col"]] = got["x_hat"]
        image.png(labels, a.out or "labels.png")
        return 0
    try:
        rows = tables.read_observations(spark, a.data, getattr(a, "ref", None), a.series)
    except tables.CSVLoadError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    if a.command == "classify":
        got = series.classify(rows, model)
        tables.write_classification(got, model.K, a.out or "classified")
        if a.ref:
            # a K x K table is all that reaches the driver
            table = got.join(rows.select("series_id", "n", "x"), ["series_id", "n"]).groupBy("x", "x_hat").count().collect()
            m = np.zeros((model.K, model.K))
            for r in table:
                m[r["x"], r["x_hat"]] = r["count"]
            best = m[np.arange(model.K), missing.assignment(-m)].sum()
            print(f"error rate: {1 - best / m.sum():.4f}")
        return 0
    if a.command == "estimate":
        return _estimated(rows, model, a)
    print(estimate.missingness_lr_test(rows, model))
    return 0


if __name__ == "__main__":
    sys.exit(main())
