"""Vector code compression: product quantisation by Hamerly's form of Lloyd's algorithm.

A vector's components become integers ``floor(scale * x)`` and are cut into ``parts`` equal
consecutive parts, each with a codebook of its own.  Every round gives each part its nearest
entry (squared distance, ties to the lower index) and moves the entries to the floored
means of their parts.  All results are exact integers.

With every part is stored which entry it has, an *upper* bound of its distance to that entry
and a *lower* bound of its distance to the nearest other one.  When entries move, the upper
bound grows by the own entry's step and the lower one falls by the largest step of
another; while the upper bound is strictly below the lower one, or below half of the own entry's
distance to its nearest neighbour, the entry stays and nothing is computed.  Else the
distance to the own entry is computed and tried once more, and only then are all entries
scanned, in integers.  As bounds are rounded away from each other and must fail
strictly, a part with two entries at the same distance is always scanned, so
ties go to the lower index as in the plain algorithm.

Vectors lie in blocks of up to ``BLOCK`` rows, with bounds and entries of their parts and the sums
that the next codebooks need; a round reads the blocks of the one before and writes its own, so
nothing is shuffled but the sums, one row per entry and task.  The driver holds the codebooks, whose
size does not follow the rows.

Cases: vectors that are null or hold null or non-finite components are dropped; a vector
shorter than the longest counts as filled up with zeros, as does a length that ``parts`` does
not divide; rows without an id are kept and come last where ids are ordered; rows that repeat an
id are ordered by their components and count one by one; with fewer rows than entries the
codebooks have as many entries as there are rows; null labels are one label; an empty table
gives an empty result; extra columns are ignored.  Components so large that
a squared distance could reach ``LARGEST`` are an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Rows of a block.
BLOCK = 8192
#: Squared distances must be smaller, so that they are exact in 64-bit floats.
LARGEST = 1 << 53
#: Bounds are moved apart by this share, far more than their rounding.
SLACK = 1e-12


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, its squared distance and the least one of the others."""
    # whole numbers below 2 ** 53, so the products are exact
    d = (book * book).sum(axis=1)[None] - 2 * (x @ book.T) + (x * x).sum(axis=1)[:, None]
    at = d.argmin(axis=1)
    rows = np.arange(len(x))
    own = d[rows, at].copy()
    d[rows, at] = np.inf
    return at, own, np.minimum(d.min(axis=1), 1e300)  # a lone entry has no other


@dataclass
class Codebooks:
    """Entries ``(parts, entries, width)``, the steps of the last move, and per entry half of the
    distance to its nearest neighbour."""

    entries: np.ndarray
    steps: np.ndarray
    halves: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Codebooks:
        steps = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=2)) * (1 + SLACK)
        halves = np.full(entries.shape[:2], np.inf)
        for p, book in enumerate(entries):
            if len(book) > 1:
                gap = ((book[:, None] - book[None]) ** 2).sum(axis=2)
                np.fill_diagonal(gap, np.inf)
                halves[p] = np.sqrt(gap.min(axis=1)) / 2 * (1 - SLACK)
        return Codebooks(entries, steps, halves)

    def text(self) -> str:
        """All components by part, entry and position."""
        return ",".join(map(str, self.entries.astype(np.int64).reshape(-1).tolist()))


def assign(x: np.ndarray, p: int, books: Codebooks, at: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds of part ``p`` of some rows after a move of the entries, and how many of
    them were scanned; without earlier entries all are."""
    book = books.entries[p]
    if at is None:
        at, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
        todo = np.arange(len(x))
    else:
        step = books.steps[p]
        top = int(step.argmax()) if len(step) else 0
        others = np.where(np.arange(len(step)) == top, np.delete(step, top).max(initial=0.0), step.max(initial=0.0))
        at = at.astype(np.int64)
        upper = (upper + step[at]) * (1 + SLACK)
        lower = (lower - others[at]) - SLACK * np.abs(lower)
        bound = np.maximum(lower, books.halves[p][at])
        todo = np.flatnonzero(~(upper < bound))
        if len(todo):  # once more with the distance itself
            d = ((x[todo] - book[at[todo]]) ** 2).sum(axis=1)
            upper[todo] = np.sqrt(d) * (1 + SLACK)
            todo = todo[~(upper[todo] < bound[todo])]
    if len(todo):
        found, own, other = nearest(x[todo], book)
        at[todo], upper[todo], lower[todo] = found, np.sqrt(own) * (1 + SLACK), np.sqrt(other) * (1 - SLACK)
    return at, upper, lower, len(todo)


def sums(x: np.ndarray, at: np.ndarray, entries: int) -> np.ndarray:
    """``(entries, 1 + width)``: how many parts each entry has, and their sums."""
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    out = np.zeros((entries, x.shape[1] + 1))
    if len(used):
        out[used, 0] = np.diff(np.append(first, len(order)))
        out[used, 1:] = np.add.reduceat(x[order], first, axis=0)
    return out


_STATE = "ids binary, no_id binary, labels {label}, data binary, codes binary, upper binary, lower binary, sums array<struct<part:int,entry:int,n:long,total:array<long>>>, scanned long"


def _whole(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """``id``, ``label``, ``vec array<double>`` of the rows that are kept, and the padded length."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("vec IS NOT NULL").where(~bad)
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    length = -(-max(sizes["most"] or 1, 1) // parts) * parts
    if sizes["least"] != length:
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("vec"))))
    return rows, length


def quantise(scratch: Scratch, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> tuple[DataFrame, Codebooks, list[int]]:
    """``id, label, codes array<int>, error`` of every kept row, the final codebooks, and how many
    parts were scanned in each assignment.  The tables behind it live in ``scratch``."""
    spark = df.sparkSession
    rows, length = _whole(df, id_col, vec_col, label_col, parts)
    width = length // parts
    label = df.schema[label_col].dataType

    def whole_numbers(b: pa.RecordBatch) -> np.ndarray:
        flat = b.column("vec").flatten().to_numpy(zero_copy_only=False)
        x = np.floor(flat * scale).reshape(b.num_rows, length)
        if len(x) and 4 * width * np.abs(x).max() ** 2 >= LARGEST:
            raise ValueError("a component is too large for exact squared distances")
        return x

    # the first entries: the smallest ids, at most `entries` rows
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.transform("vec", lambda v: F.floor(v * scale))).limit(entries).collect()
    start = np.floor(np.array([r["vec"] for r in first], dtype=np.float64).reshape(len(first), length) * scale)
    books = Codebooks.of(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)))

    def block(x: np.ndarray, codes, upper, lower, books: Codebooks):
        """Codes, bounds, sums and the number of scans of one block."""
        c, u, l, total, scanned = [], [], [], [], 0
        for p in range(parts):
            part = x[:, p * width : (p + 1) * width]
            at, up, low, n = assign(part, p, books, None if codes is None else codes[p], None if upper is None else upper[p], None if lower is None else lower[p])
            s = sums(part, at, books.entries.shape[1]).astype(np.int64)
            total += [{"part": p, "entry": int(e), "n": int(s[e, 0]), "total": s[e, 1:].tolist()} for e in np.flatnonzero(s[:, 0])]
            scanned += n
            c.append(at.astype("<u2"))
            u.append(up)
            l.append(low)
        return np.array(c), np.array(u), np.array(l), total, scanned

    kinds = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def state(ids, none, labels, x, found) -> pa.RecordBatch:
        codes, upper, lower, total, scanned = found
        one = lambda a: pa.array([a.tobytes()], pa.binary())
        held = pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels)
        return pa.RecordBatch.from_arrays(
            [one(ids), one(none), held, one(x.astype("<i4")), one(codes), one(upper), one(lower), pa.array([total], pa.list_(kinds)), pa.array([scanned], pa.int64())],
            names=["ids", "no_id", "labels", "data", "codes", "upper", "lower", "sums", "scanned"],
        )

    ref = spark.sparkContext.broadcast(books)

    def begin(batches):
        held, n = [], 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = whole_numbers(whole)
            ids = whole.column("id")
            return state(np.asarray(ids.fill_null(0), "<i8"), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), "u1"), whole.column("label"), x, block(x, None, None, None, ref.value))

        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                piece = b.slice(a, BLOCK)
                if n + piece.num_rows > BLOCK:
                    yield flush()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield flush()

    kind = _STATE.format(label=f"array<{label.simpleString()}>")
    at = scratch.written(rows.mapInArrow(begin, kind), "round")
    scans = []
    for _ in range(rounds):
        # one row per entry and task; the sums of a table are decimals, which no table overflows
        grouped = at.select(F.inline("sums")).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)))
        moved = books.entries.copy()
        for r in grouped.collect():
            moved[r["part"], r["entry"]] = [int(r[f"t{k}"]) // r["n"] for k in range(width)]
        books = Codebooks.of(moved, books.entries)
        move = spark.sparkContext.broadcast(books)

        def again(batches, move=move):
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    x = np.frombuffer(row.column("data")[0].as_py(), "<i4").reshape(-1, length).astype(np.float64)
                    codes = np.frombuffer(row.column("codes")[0].as_py(), "<u2").reshape(parts, -1)
                    upper, lower = (np.frombuffer(row.column(k)[0].as_py(), "<f8").reshape(parts, -1) for k in ("upper", "lower"))
                    ids, none = (np.frombuffer(row.column(k)[0].as_py(), t) for k, t in (("ids", "<i8"), ("no_id", "u1")))
                    yield state(ids, none, row.column("labels").flatten(), x, block(x, codes, upper, lower, move.value))

        scans.append(at.agg(F.sum("scanned")).first()[0] or 0)
        before, at = at, scratch.written(at.drop("sums", "scanned").mapInArrow(again, kind), "round")
        scratch.drop(before)
    scans.append(at.agg(F.sum("scanned")).first()[0] or 0)
    last = spark.sparkContext.broadcast(books)

    def finish(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column("data")[i].as_py(), "<i4").reshape(-1, parts, width).astype(np.int64)
                codes = np.frombuffer(b.column("codes")[i].as_py(), "<u2").reshape(parts, -1)
                error = sum(((x[:, p] - last.value.entries[p].astype(np.int64)[codes[p]]) ** 2).sum(axis=1) for p in range(parts))
                ids = pa.array(np.frombuffer(b.column("ids")[i].as_py(), "<i8"), mask=np.frombuffer(b.column("no_id")[i].as_py(), "u1").astype(bool))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.T.astype(np.int32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, b.slice(i, 1).column("labels").flatten(), flat, pa.array(error, pa.int64())], names=["id", "label", "codes", "error"])

    out = at.select("ids", "no_id", "labels", "data", "codes").mapInArrow(finish, f"id long, label {label.simpleString()}, codes array<int>, error long")
    return out, books, scans


def per_label(rows: DataFrame, total: str = "label_error", hot: int = 1024) -> DataFrame:
    """Adds the sum of ``error`` over each ``label`` (nulls together).

    A label that holds a ``hot``-th of all rows or more goes by broadcast (there are at most ``hot``
    of them), the others by a join in which no key is large.  ``rows`` must be written.
    """
    sums = rows.groupBy("label").agg(F.sum("error").alias(total), F.count(F.lit(1)).alias("held"))
    least = max(rows.count() / hot, 1)
    many = sums.where(F.col("held") >= least).select(F.col("label").alias("other"), total)
    few = sums.where(F.col("held") < least).select(F.col("label").alias("other"), total)
    same = rows["label"].eqNullSafe(F.col("other"))
    return rows.join(F.broadcast(many), same).drop("other").unionByName(rows.join(few, same).drop("other"))


def digest(books: Codebooks) -> str:
    return hashlib.sha256(books.text().encode()).hexdigest()
