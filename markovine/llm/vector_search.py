"""Blocked vector search: what exact and approximate search share.

Equal vectors are searched once.  A distinct vector keeps its ``keep`` smallest ids:
with ties going to smaller ids no other id of it can be among a query's results, so
this is exact, and a vector that a third of all rows share is one candidate.  Partial
lists are cut per Arrow batch before they are shuffled.  Lists hold an id once, with its
best score, whatever rows repeat it.

Distinct vectors are range-partitioned by two keys (``major``, ``minor``) into segments of
about ``segment`` rows, which are written with their index, and distinct query vectors into
blocks of about ``block`` rows.  A kernel says which ranges of the keys a block can find
anything in; blocks and segments are matched on those ranges alone, and only the pairs
that are left send their vectors.  A segment is read once for up to ``TOGETHER`` blocks,
which stream past it, so what a task holds has a fixed size.  A kernel gives each query's
best ids in the segment; the lists of a query are merged, and every query row gets its
vector's list without itself.

Cases: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; a vector shorter than the longest counts as filled up with zeros; rows
that repeat an id are one candidate, with the best of their scores, and every such row that
is a query gets its own results, never its own id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: A kernel gets a block of query rows and a segment, and returns per query ``(ids, scores)``.
Kernel = Callable[[np.ndarray, "Segment"], list[tuple[np.ndarray, np.ndarray]]]
#: Blocks that share one reading of a segment.
TOGETHER = 64


class Segment:
    """Vectors (rows of ``data``), the ids of each, the two sort columns and the index."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, starts: np.ndarray, major: np.ndarray, minor: np.ndarray, index: bytes):
        self.data, self.ids, self.starts, self.major, self.minor, self.index = data, ids, starts, major, minor, index

    def expand(self, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows with their scores."""
        n = self.starts[rows + 1] - self.starts[rows]
        stop = np.cumsum(n)
        at = np.repeat(self.starts[rows] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)
        return self.ids[at], np.repeat(scores, n)


def best(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` best pairs of different ids, largest score first, ties to smaller ids."""
    wide = keep
    while True:
        some, best_of = ids, scores
        if len(ids) > 4 * wide:
            stay = scores >= np.partition(scores, len(scores) - wide)[len(scores) - wide]
            some, best_of = ids[stay], scores[stay]
        order = np.lexsort((some, -best_of))
        top = some[order[:keep]]
        if len(set(top.tolist())) == len(top) and (len(top) == keep or len(some) == len(ids)):
            return top, best_of[order[:keep]]
        # the first place of an id is its best
        first = np.sort(np.unique(some[order], return_index=True)[1])[:keep]
        if len(first) == keep or len(some) == len(ids):
            return some[order][first], best_of[order][first]
        wide *= 4


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``vec array<double>`` of the rows that take part, all of one length."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL").where(~bad)
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    most = max(sizes["most"] or 1, 1)
    if sizes["least"] != most:
        rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vec"))))
    return rows


def distinct(rows: DataFrame, as_key: Callable[[np.ndarray], np.ndarray], keep: int, queries: str) -> DataFrame:
    """``key binary`` (the vector's components as ``as_key`` makes them, eight bytes each),
    its ``keep`` smallest ``ids`` and whether one of its ids is a query."""

    def partial(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = b.column("vec")
            d = len(col.flatten()) // n
            keys = as_key(col.flatten().to_numpy(zero_copy_only=False).reshape(n, d))
            ids = b.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            query = b.column("query").to_numpy(zero_copy_only=False)
            lists: dict[bytes, list[int]] = {}
            asked: dict[bytes, bool] = {}
            for i in order.tolist():
                k = keys[i].tobytes()
                own = lists.setdefault(k, [])
                if len(own) < keep and (not own or own[-1] != ids[i]):
                    own.append(int(ids[i]))
                asked[k] = asked.get(k, False) or bool(query[i])
            yield pa.RecordBatch.from_arrays([pa.array(list(lists), pa.binary()), pa.array(list(lists.values()), pa.list_(pa.int64())), pa.array(list(asked.values()), pa.bool_())], names=["key", "ids", "query"])

    parts = rows.select("id", "vec", F.expr(queries).alias("query")).mapInArrow(partial, "key binary, ids array<long>, query boolean")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return parts.groupBy("key").agg(merged.alias("ids"), F.max("query").alias("query"))


def packed(rows: DataFrame, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], index: Callable[[np.ndarray], bytes], size: int, name: str) -> DataFrame:
    """Range-partition ``rows`` (``key``, ``ids``) by ``place`` of their vectors into groups of
    about ``size``, one row each: ``part``, ``data``, ``ids``, ``sizes``, ``major``, ``minor``, its
    ``index``, and ``spans`` of its keys."""
    parts = max(1, math.ceil(rows.count() / size))

    def located(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("key").to_pylist()), dtype="<f8").reshape(b.num_rows, -1)
                major, minor = place(x)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ids"), pa.array(major.astype(np.int32)), pa.array(minor.astype(np.float64))], names=["key", "ids", "major", "minor"])

    def pack(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys = pa.concat_arrays([b.column("key") for b in held]).to_pylist()
        ids = pa.concat_arrays([b.column("ids") for b in held])
        sizes = np.diff(ids.offsets.to_numpy())
        for at in range(0, len(keys), 2 * size):  # range bounds come from a sample
            cut = slice(at, at + 2 * size)
            n = len(keys[cut])
            one = ids.slice(at, n)
            cols = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])[cut] for c in ("major", "minor")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId() * 1024 + at // (2 * size)], pa.int32()),
                    pa.array([b"".join(keys[cut])], pa.binary()),
                    *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (one.flatten().to_numpy().astype("<i8"), sizes[cut].astype("<i4"), cols[0].astype("<i4"), cols[1].astype("<f8"))),
                    pa.array([index(np.frombuffer(b"".join(keys[cut]), "<f8").reshape(n, -1))], pa.binary()),
                    pa.array([[{"major": int(m), "lo": float(cols[1][cols[0] == m].min()), "hi": float(cols[1][cols[0] == m].max())} for m in np.unique(cols[0])]], pa.list_(pa.struct([("major", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))),
                ],
                names=["part", "data", "ids", "sizes", "major", "minor", "index", "spans"],
            )

    spots = rows.select("key", "ids").mapInArrow(located, "key binary, ids array<long>, major int, minor double")
    spots = written(spots, f"{name}-spots").repartitionByRange(parts, "major", "minor", "key").sortWithinPartitions("major", "minor", "key")
    out = spots.mapInArrow(pack, "part int, data binary, ids binary, sizes binary, major binary, minor binary, index binary, spans array<struct<major:int,lo:double,hi:double>>")
    return written(out, name)


class Plan:
    """What a search is made of; the two searches fill it in."""

    #: Where data and query vectors are placed: ``(major, minor)`` of each row.
    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def place_query(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.place(x)

    def index(self, x: np.ndarray) -> bytes:
        """What is stored with a segment."""
        return b""

    def reach(self, q: np.ndarray) -> list[tuple[int, float, float]]:
        """Ranges of ``minor`` per ``major`` outside of which the queries find nothing."""
        raise NotImplementedError

    def __call__(self, q: np.ndarray, seg: Segment) -> list[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError


def run(df: DataFrame, id_col: str, vec_col: str, as_key: Callable[[np.ndarray], np.ndarray], keep_zero: bool, prepare: Callable[[DataFrame, DataFrame], Plan], k: int, queries: str, score_type: str, segment: int, block: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for every query row.

    ``prepare`` gets the rows that take part and the distinct vectors, and returns the plan.
    """
    keep = k + 1  # one of them may be the query itself
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    if not keep_zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0.0))
    unique = written(distinct(rows, as_key, keep, queries), "vectors")
    ref = spark.sparkContext.broadcast(prepare(rows, unique))  # of a size that does not follow the rows
    segments = packed(unique, lambda x: ref.value.place(x), lambda x: ref.value.index(x), segment, "segments")
    blocks = packed(unique.where("query"), lambda x: ref.value.place_query(x), lambda x: b"", block, "blocks")

    def reach(batches):
        for b in batches:
            for part, data, sizes in zip(*(b.column(c).to_pylist() for c in ("part", "data", "sizes")), strict=True):
                q = np.frombuffer(data, "<f8").reshape(len(sizes) // 4, -1)
                got = ref.value.reach(q)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(got), pa.int32()), *(pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64())))], names=["block", "major", "low", "high"])

    wanted = blocks.select("part", "data", "sizes").mapInArrow(reach, "block int, major int, low double, high double")
    n_blocks, n_parts = blocks.count(), max(1, segments.count())
    deals = -(-n_parts // TOGETHER)  # a key of the join has a bounded number of segments
    spans = segments.select("part", F.pmod(F.xxhash64("part"), F.lit(deals)).cast("int").alias("deal"), F.inline("spans"))
    wanted = wanted.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    pairs = wanted.join(spans, ["major", "deal"]).where("lo <= high AND hi >= low").select("block", "part").distinct()
    salts = max(1, -(-n_blocks // TOGETHER), -(-2 * spark.sparkContext.defaultParallelism // n_parts))
    none = F.lit(None).cast("binary")
    cols = ["data", "ids", "sizes", "major", "minor", "index"]
    asked = pairs.join(blocks.select(F.col("part").alias("block"), "data"), "block").select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "data", *(none.alias(c) for c in cols[1:]))
    held = segments.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *cols)
    stream = held.unionByName(asked).repartition(min(n_parts * salts, 1 << 15), "part", "salt").sortWithinPartitions("part", "salt", "kind")

    def search(batches):
        plan, seg = ref.value, None
        kind = pa.float64() if score_type == "double" else pa.int64()
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("data")[i].as_py()
                if b.column("kind")[i].as_py() == 0:
                    sizes = np.frombuffer(b.column("sizes")[i].as_py(), "<i4").astype(np.int64)
                    seg = Segment(np.frombuffer(data, "<f8").reshape(len(sizes), -1), np.frombuffer(b.column("ids")[i].as_py(), "<i8"), np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b.column("major")[i].as_py(), "<i4"), np.frombuffer(b.column("minor")[i].as_py(), "<f8"), b.column("index")[i].as_py())
                    continue
                q = np.frombuffer(data, "<f8").reshape(-1, seg.data.shape[1])
                found = plan(q, seg)
                hits = [[(float(-s) if score_type == "double" else int(-s), int(v)) for v, s in zip(ids, scores, strict=True)] for ids, scores in found]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in q], pa.binary()), pa.array(hits, pa.list_(pa.struct([("minus", kind), ("id", pa.int64())])))], names=["key", "hits"])

    found = stream.select("part", "kind", *cols).mapInArrow(search, f"key binary, hits array<struct<minus:{score_type},id:bigint>>")
    # from the best on, what is not in the list yet, until it is full
    kind = f"array<struct<minus:{score_type},id:bigint>>"
    once = f"aggregate(hits, CAST(array() AS {kind}), (own, x) -> IF(size(own) >= {keep} OR exists(own, y -> y.id = x.id), own, concat(own, array(x))))"
    merged = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).select("key", F.expr(once).alias("hits"))
    merged = written(merged, "hits")

    def keys(batches):
        for b in batches:
            if b.num_rows:
                flat = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in as_key(flat)], pa.binary())], names=["query_id", "key"])

    asking = rows.where(queries).mapInArrow(keys, "query_id long, key binary")
    own = asking.join(merged, "key").select("query_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k).alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
