"""Quality by compression: which of two dictionaries makes a text smaller.

A zstandard dictionary is trained on texts of each class.  A text is cut into pieces of
``PIECE`` bytes, which are compressed with either dictionary, so that a dictionary counts for
all of a text and not only until the text has become its own dictionary.  The difference of
the two compressed sizes, divided by the text's size, is one number: how many bytes a byte
is cheaper as good text than as bad text.  What goes into a dictionary is partly chance, so
there are ``folds`` pairs of them, each trained without one part of the sample, and a text's number
is their mean.  A logistic curve turns it into a probability; it is fitted on the numbers
that each part of the sample gets from the pair that has not seen it.

Training takes a bounded sample: ``max_per_class`` labelled ids of each class, those with the
smallest hash, and of rows that repeat an id one.  A text gives a dictionary at most ``max_pieces``
pieces, evenly spread over it; the curve is fitted on whole texts, weighted back to the
classes' true shares.  If the other parts of a fold lack a class, all of the sample serves
for its pair.  A class with too few samples for training has their bytes as its dictionary.

Cases: null and empty text have the labelled rows' share of good ones as their score; a null label
takes no part in training; if the labelled rows have one class or none the score is that class's
share (0 without rows); repeated labels of an id count once, good only if all of them are;
repeated rows give repeated results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, chunks, keep_rows

#: Bytes that are compressed at once.
PIECE = 1024


def pieces(data: bytes) -> list[memoryview]:
    """A text's consecutive pieces."""
    view = memoryview(data)
    return [view[a : a + PIECE] for a in range(0, len(data), PIECE)]


def spread(data: bytes, most: int) -> list[bytes]:
    """At most ``most`` pieces, evenly spread over the text."""
    own = pieces(data)
    at = range(len(own)) if len(own) <= most else np.linspace(0, len(own) - 1, most).round().astype(int).tolist()
    return [bytes(own[k]) for k in at]


def dictionary(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """A dictionary of about ``size`` bytes, and whether it is a trained one (else plain bytes)."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), True
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[:size], False


class Compressor:
    """Sizes of texts under pairs of dictionaries of bad and good text; travels as their bytes."""

    def __init__(self, pairs: list[tuple[tuple[bytes, bool], tuple[bytes, bool]]], level: int):
        self.pairs, self.level, self.tools = pairs, level, None

    def __getstate__(self):
        return {**self.__dict__, "tools": None}

    def tool(self, content: bytes, trained: bool):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, data: bytes, pairs: list[int] | None = None) -> tuple[int, int]:
        """Compressed bytes as bad and as good text, summed over (some of the) pairs."""
        if self.tools is None:
            self.tools = [tuple(self.tool(*d) for d in pair) for pair in self.pairs]
        own, bad, good = pieces(data), 0, 0
        for as_bad, as_good in self.tools if pairs is None else [self.tools[k] for k in pairs]:
            bad += sum([len(as_bad(x)) for x in own])
            good += sum([len(as_good(x)) for x in own])
        return bad, good


class Quality:
    """Dictionaries and curve; without dictionaries every score is ``share``."""

    def __init__(self, share: float, compressor: Compressor | None = None, offset: float = 0.0, slope: float = 0.0):
        self.share, self.compressor, self.offset, self.slope = share, compressor, offset, slope

    def measure(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of a text, and its compressed sizes as bad and as good text, summed over the pairs."""
        data = (text or "").encode("utf-8", "replace")
        return (len(data), *(self.compressor.sizes(data) if self.compressor and data else (0, 0)))

    def score(self, text: str | None) -> float:
        return self.score_of(*self.measure(text))

    def score_of(self, size: int, bad: int, good: int) -> float:
        if not size or self.compressor is None:
            return self.share
        z = self.offset + self.slope * (bad - good) / (size * len(self.compressor.pairs))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve by Newton's method; targets are kept off 0 and 1 by
    a count of one, so that separable rows have a finite slope."""
    scale = float(np.sqrt((weights * x * x).sum() / weights.sum())) or 1.0
    pos, neg = float(weights[y > 0].sum()), float(weights[y == 0].sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    X, b = np.stack([np.ones_like(x), x / scale], axis=1), np.zeros(2)

    def loss(b):
        z = X @ b
        return float((weights * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * float(b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -40, 40)))
        grad = X.T @ (weights * (p - target)) + 2e-6 * b
        step = np.linalg.solve((X * (weights * p * (1 - p))[:, None]).T @ X + 2e-6 * np.eye(2), grad)
        t, before = 1.0, loss(b)
        while loss(b - t * step) > before and t > 1e-6:
            t /= 2
        b = b - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(b[0]), float(b[1] / scale)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = 3000, max_pieces: int = 16, dictionary_size: int = 1 << 15, folds: int = 3, level: int = 3) -> Quality:
    """Fit on at most ``max_per_class`` labelled rows of each class."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    marked = marked.withColumn("y", (F.col("y") > 0).cast("int"))
    totals = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {k: totals.get(k, 0) for k in (0, 1)}
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.0
    if not n[0] or not n[1]:
        return Quality(share)
    picked = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    with Scratch(docs.sparkSession, "quality") as scratch:
        sample = scratch.written(picked[0].union(picked[1]), "ids")  # at most 2 * max_per_class rows
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text != ''")
        rows = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
        rows = scratch.written(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(folds)).cast("int")), "rows")

        def cut(batches):
            for whole in batches:
                for b in chunks(whole, "text"):
                    parts = [spread(t.encode("utf-8", "replace"), max_pieces) for t in b.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), pa.array(parts, pa.list_(pa.binary()))], names=["y", "fold", "parts"])

        # the order does not depend on the tasks
        got = sorted((zlib.crc32(r["parts"][0]), r["y"], r["fold"], [bytes(x) for x in r["parts"]]) for r in rows.select("y", "fold", "text").mapInArrow(cut, "y int, fold int, parts array<binary>").collect())
        if {y for _, y, _, _ in got} != {0, 1}:
            return Quality(share)
        pairs = []
        for k in range(folds):
            own = [[x for _, c, fold, xs in got if c == y and fold != k for x in xs] or [x for _, c, _, xs in got if c == y for x in xs] for y in (0, 1)]
            pairs.append(tuple(dictionary(xs, dictionary_size) for xs in own))
        compressor = Compressor(pairs, level)
        ref = docs.sparkSession.sparkContext.broadcast(compressor)

        def measure(batches):
            for whole in batches:
                for b in chunks(whole, "text"):
                    data = [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
                    bad, good = zip(*(ref.value.sizes(d, [k]) for d, k in zip(data, b.column("fold").to_pylist(), strict=True)), strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(x, pa.int64()) for x in ([len(d) for d in data], bad, good))], names=["y", "size", "bad", "good"])

        found = sorted(tuple(r) for r in rows.select("y", "fold", "text").mapInArrow(measure, "y int, size long, bad long, good long").collect())
    y, size, bad, good = np.array(found, dtype=np.float64).T
    weights = np.where(y > 0, n[1] / max((y > 0).sum(), 1), n[0] / max((y == 0).sum(), 1))
    offset, slope = curve((bad - good) / size, y, weights * len(y) / weights.sum())
    return Quality(share, compressor, offset, slope)


def predict(df: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``size`` in bytes, and the sum of its compressed sizes as ``bad``
    and as ``good`` text, of each row."""
    ref = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        model = ref.value
        for whole in batches:
            for b in chunks(whole, "text"):
                sizes = [model.measure(t) for t in b.column("text").to_pylist()]
                cols = [pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([model.score_of(*s) for s in sizes], pa.float64()), *cols], names=[id_col, "score", "size", "bad", "good"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, size long, bad long, good long")


def keep_good(df: DataFrame, model: Quality, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``df`` that score ``least`` or more, with all their columns."""
    ref = df.sparkSession.sparkContext.broadcast(model)
    return keep_rows(df, text_col, lambda t: ref.value.score(t) >= least)
