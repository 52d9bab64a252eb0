"""Readers and writers of observation tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.missing import canonical, parse_cell


class CSVLoadError(ValueError):
    """A CSV file without usable observations."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_observations(spark: SparkSession, path: str, ref: str | None = None, series: str | None = None) -> DataFrame:
    """CSV files with a header: column ``Y`` (or ``Y0, Y1, ..``), optionally ``n``, a label
    column and a series column.  Every cell is read as text and parsed; a cell that is
    neither a finite number nor missing is an error, as is a line with too few or too many cells.

    Without a column ``n`` rows count in the files' order, by one task per series."""
    names = spark.read.option("header", True).csv(path).columns
    shape = StructType([StructField(c, StringType()) for c in [*names, "__line"]])
    raw = spark.read.schema(shape).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").csv(path)
    torn = raw.where("__line IS NOT NULL").limit(1).collect()
    if torn:
        raise CSVLoadError(f"wrong number of cells: {torn[0]['__line']!r}")
    raw = raw.drop("__line")
    vector = sorted((c for c in raw.columns if c[:1] == "Y" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    if "Y" not in raw.columns and not vector:
        raise CSVLoadError("no column Y")
    cols = ["Y"] if "Y" in raw.columns else vector
    bad = None
    for c in cols:
        wrong = F.expr(f"coalesce(abs(try_cast(`{c}` AS double)) = double('inf'), true)") & ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "na")
        bad = wrong if bad is None else bad | wrong
    first = raw.where(bad).limit(1).collect()
    if first:
        raise CSVLoadError(f"not a number: {first[0].asDict()}")
    cells = [canonical(parse_cell(F.coalesce(c, F.lit("")))) for c in cols]
    y = cells[0] if len(cells) == 1 else F.when(sum((c.isNull().cast("int") for c in cells), F.lit(0)) == 0, F.array(*cells))
    sid = F.col(series) if series else F.lit(0).cast("long")
    out = raw.withColumn("__o", F.monotonically_increasing_id()).withColumn("y", y).withColumn("series_id", sid)
    order = F.col("n").cast("long") if "n" in raw.columns else F.col("__o")
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy(order)) - 1)
    keep = ["series_id", F.col("n").cast("long").alias("n"), "y"] + ([F.col(ref).cast("int").alias("x")] if ref else [])
    out = out.select(*keep)
    if out.where("y IS NOT NULL").isEmpty():
        raise CSVLoadError("no observations")
    return out


def write_classification(result: DataFrame, K: int, path: str) -> None:
    """``n, X_hat, gamma_0 ..`` with n from 1 and eight decimals."""
    cols = [F.format_number(F.element_at("gamma", i + 1), 8).alias(f"gamma_{i}") for i in range(K)]
    result.orderBy("series_id", "n").select("series_id", (F.col("n") + 1).alias("n"), F.col("x_hat").alias("X_hat"), *cols).write.mode("overwrite").option("header", True).csv(path)


def write_simulation(rows: DataFrame, path: str) -> None:
    """``n, X, Y`` with n from 1."""
    rows.orderBy("series_id", "n").select("series_id", (F.col("n") + 1).alias("n"), F.col("x").alias("X"), F.col("y").alias("Y")).write.mode("overwrite").option("header", True).csv(path)


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as series: one per user, ordered by time, ``y`` the log value."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("series_id"), n.cast("long").alias("n"), F.col("event_type").alias("kind"), "value", F.log("value").alias("y"))


def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``g, n, x, y, w``: consecutive values of each user, weighted by position."""
    s = events_series(spark, sf_dir)
    nxt = F.lead("value").over(Window.partitionBy("series_id").orderBy("n"))
    return s.withColumn("z", nxt).where("z IS NOT NULL").select(F.col("series_id").alias("g"), "n", F.col("value").alias("x"), F.col("z").alias("y"), (F.col("n") % 3 + 1).cast("double").alias("w"))
