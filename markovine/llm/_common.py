"""Shared helpers: table access, shared-folder tables, slices of Arrow batches.

Cases: null texts count zero bytes and null ids the empty text; an empty table is written
and read back empty; a batch with one very long text is a slice of its own.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none a temporary folder is set; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in a folder of their own, removed when the job is done; what is
    returned from inside must have been written elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def drop(self, table: DataFrame) -> None:
        """Remove one of the tables before the job is done."""
        self._remove(self.held.pop(id(table))[1])

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *error) -> None:
        self._remove(self.path)


def chunks(batch: pa.RecordBatch, text_col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes of text, so that what a worker
    holds at once does not follow the batch's row count."""
    col = batch.column(text_col)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def quoted(name: str):
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their positions, for calls that take names apart."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def keep_rows(df: DataFrame, text_col: str, decide: Callable[[str | None], bool]) -> DataFrame:
    """The rows of ``df`` whose text ``decide`` keeps, with all their columns."""
    rows, col = numbered(df), f"c{df.columns.index(text_col)}"

    def run(batches):
        for whole in batches:
            for b in chunks(whole, col):
                yield b.filter(pa.array([bool(decide(t)) for t in b.column(col).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)


def crc_of_id(id_col: str):
    """crc32 of an id written as text, as a Column; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def crc_of_value(value) -> int:
    """The same crc32 in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode())
