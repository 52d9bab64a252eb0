"""Images as series along a space-filling curve.

The curve visits every cell of any rectangle once and steps to a neighbour wherever the
sides' parity allows it.  A block has a corner, two unit directions and a length along
each.  A block much longer than wide is two blocks one after the other; any other block
is three: across its near part, along its far part, and back across the rest of the near
part.  Where a cell comes in the order follows from the sizes of the blocks it does not
lie in, so cells and positions are translated one by one, many at a time, without a
table of the whole curve.  How blocks are split is the rule of the generalised Hilbert curve
for rectangles (Jakub Cerveny, BSD 2-clause licence), which fixes the order; on squares whose
side is a power of two it is Hilbert's curve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Model
from . import series


class _Blocks:
    """One block per cell looked for: what is known of each narrows step by step."""

    def __init__(self, count: int, height: int, width: int):
        along = width >= height  # the first block runs along its longer side
        fill = lambda *v: np.tile(np.array(v, dtype=np.int64), (count, 1))
        self.corner = fill(0, 0)  # row, column
        self.u, self.v = (fill(0, 1), fill(1, 0)) if along else (fill(1, 0), fill(0, 1))
        self.long = np.full(count, max(height, width), dtype=np.int64)
        self.wide = np.full(count, min(height, width), dtype=np.int64)
        self.before = np.zeros(count, dtype=np.int64)  # cells visited before the block

    def cuts(self, at: np.ndarray):
        """For the blocks ``at``: whether they split in two, and the lengths at which they split."""
        long, wide = self.long[at], self.wide[at]
        two = 2 * long > 3 * wide
        # the first half of an odd length is the shorter one where the direction ascends
        h = (long + (self.u[at].sum(axis=1) < 0)) // 2
        k = (wide + (self.v[at].sum(axis=1) < 0)) // 2
        h = h + (two & (h % 2 == 1) & (long > 2))
        k = k + (~two & (k % 2 == 1) & (wide > 2))
        return two, h, k

    def enter(self, at: np.ndarray, two: np.ndarray, h: np.ndarray, k: np.ndarray, part: np.ndarray) -> None:
        """Go on to sub-block ``part`` (0, 1, 2) of each."""
        u, v, long, wide = self.u[at], self.v[at], self.long[at], self.wide[at]
        cases = [two & (part == 0), two & (part == 1), ~two & (part == 0), ~two & (part == 1), ~two & (part == 2)]
        pick = lambda *xs: np.select([c[:, None] if xs[0].ndim == 2 else c for c in cases], xs)
        none = np.zeros_like(h)
        ahead = pick(none, h, none, none, long - 1)  # from corner to corner
        aside = pick(none, none, none, k, k - 1)
        self.before[at] += pick(none, h * wide, none, h * k, h * k + long * (wide - k))
        self.corner[at] += ahead[:, None] * u + aside[:, None] * v
        self.u[at], self.v[at] = pick(u, u, v, u, -v), pick(v, v, u, v, -u)
        self.long[at], self.wide[at] = pick(h, long - h, k, long, k), pick(wide, wide, h, wide - k, long - h)


def position_of(row: np.ndarray, col: np.ndarray, height: int, width: int) -> np.ndarray:
    """Where cells come in the order."""
    cell = np.stack([row, col], axis=1).astype(np.int64)
    b = _Blocks(len(cell), height, width)
    at = np.arange(len(cell))
    while True:
        at = at[(b.long[at] > 1) & (b.wide[at] > 1)]
        off = cell - b.corner
        if not len(at):
            return b.before + np.where(b.wide == 1, (off * b.u).sum(axis=1), (off * b.v).sum(axis=1))
        s, t = (off[at] * b.u[at]).sum(axis=1), (off[at] * b.v[at]).sum(axis=1)
        two, h, k = b.cuts(at)
        b.enter(at, two, h, k, np.where(two, s >= h, np.where(t >= k, 1, np.where(s < h, 0, 2))))


def cell_of(position: np.ndarray, height: int, width: int) -> np.ndarray:
    """``(n, 2)`` rows and columns of positions in the order."""
    position = np.asarray(position, dtype=np.int64)
    b = _Blocks(len(position), height, width)
    at = np.arange(len(position))
    while True:
        at = at[(b.long[at] > 1) & (b.wide[at] > 1)]
        left = position - b.before
        if not len(at):
            return b.corner + left[:, None] * np.where((b.wide == 1)[:, None], b.u, b.v)
        two, h, k = b.cuts(at)
        first, second = np.where(two, h * b.wide[at], h * k), np.where(two, 1 << 62, h * k + b.long[at] * (b.wide[at] - k))
        b.enter(at, two, h, k, (left[at] >= first).astype(int) + (left[at] >= second))


def curve(height: int, width: int) -> np.ndarray:
    """``(height * width, 2)`` rows and columns in visiting order."""
    return cell_of(np.arange(height * width), height, width)


def place(height: int, width: int):
    """Where the cell ``row, col`` comes, as a Column."""

    @F.pandas_udf("long")
    def at(row: pd.Series, col: pd.Series) -> pd.Series:
        return pd.Series(position_of(row.to_numpy(), col.to_numpy(), height, width))

    return at("row", "col")


def unfold(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """``image_id, row, col, y`` to series ``series_id, n, y``."""
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    return pixels.where(inside).select(F.col("image_id").alias("series_id"), place(height, width).alias("n"), "y")


def fold(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Series rows back to cells, other columns kept."""

    @F.pandas_udf("row int, col int")
    def cell(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(cell_of(n.to_numpy(), height, width), columns=["row", "col"])

    others = [c for c in rows.columns if c not in ("series_id", "n")]
    return rows.withColumn("__cell", cell("n")).select(F.col("series_id").alias("image_id"), "__cell.row", "__cell.col", *others)


def classify_image(pixels: DataFrame, model: Model, height: int, width: int) -> DataFrame:
    return fold(series.classify(unfold(pixels, height, width), model), height, width)


def read_images(spark, path: str, color: bool = False) -> DataFrame:
    """Image files as ``image_id, row, col, y``: luma, or red, green and blue, in [0, 1]."""
    raw = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for origin, h, w, c, data in pdf.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)[..., :3][..., ::-1] / 255.0
                y = list(a.reshape(-1, a.shape[2])) if color else (a @ np.array([0.299, 0.587, 0.114]) if a.shape[2] == 3 else a[..., 0]).reshape(-1)
                r, k = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"image_id": origin, "row": r, "col": k, "y": y})

    return raw.mapInPandas(run, f"image_id string, row int, col int, y {'array<double>' if color else 'double'}")


def png(labels: np.ndarray, path: str) -> None:
    """A grey PNG of up to 256 labels."""
    import struct
    import zlib

    h, w = labels.shape
    top = max(int(labels.max()), 1)
    body = b"".join(b"\0" + bytes((labels[r] * 255 // top).astype(np.uint8)) for r in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
