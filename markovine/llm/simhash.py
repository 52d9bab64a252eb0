"""SimHash fingerprints and exact near-duplicate groups through pigeonhole blocks.

Two 64-bit fingerprints that differ in at most ``d`` bits agree on one of ``d + 1``
blocks of bits.  Fingerprints are joined on (block, value).  A bucket above
``bucket`` rows is not compared pair by pair: its pairs agree on the block and still
differ in at most ``d`` of the *remaining* bits, so those are split into ``d + 1``
blocks again and the bucket's rows are dealt on the longer key, level by level.
With every level fewer bits stay free, so a bucket of different fingerprints ends
below ``2 ** free`` rows: the refinement loses no link, emits no pairs of a large
group and needs no cap.  Inside a small bucket Hamming distances are verified and
only a spanning forest of the links is emitted.

Exact copies are one fingerprint from the start.  Groups are connected components of
the forest's edges, found with minimum-label rounds and pointer jumping over tables
in the shared folder.

Cases: null or word-free text has fingerprint zero and is linked like any other;
rows with a null id get a fingerprint and their group's smallest non-null id (null
if there is none); repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored, whatever their names.  A fingerprint that more
than ``HOT`` rows share (at most one in ``HOT`` rows is such a fingerprint) is joined by
broadcast, so that no task gets all its rows.

``keep_dissimilar`` is for corpora, where copies count from a Jaccard similarity of 0.8
of their shingle sets on.  At 0.8 two fingerprints differ in about ten of 64 bits, a
radius at which the blocks have some six bits and no longer tell texts apart; so the
fingerprint's groups are joined by buckets of min-hashes over the same shingles, and
every link of either kind is verified on the shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import chunks, quoted, written

BITS = 64
#: Buckets of min-hashes per text, and min-hashes per bucket: a pair of similarity 0.8
#: shares one with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9997.
BANDS, ROWS = 20, 5
#: Largest bucket whose pairs are verified in one go; larger ones are refined.
BUCKET = 512
#: Rows from which on a key's rows are not brought together to be joined.
HOT = 1 << 18


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """A hash for each shingle of a text; a text shorter than ``width`` is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], dtype="<u8")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, keep: bool = False) -> DataFrame:
    """``id`` and ``fp long`` for each row, and the whole row as ``row`` if ``keep``."""
    kind = df.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")] + ([F.struct(*map(quoted, df.columns)).alias("row")] if keep else [])

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                fps = np.array([fingerprint(t, width, seed) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps), *([b.column("row")] if keep else [])], names=["id", "fp", *(["row"] if keep else [])])

    given = df.select(*cols)
    shape = StructType([given.schema["id"], StructField("fp", LongType())] + ([given.schema["row"]] if keep else []))
    return given.mapInArrow(run, shape)


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; ``n`` of ``table`` is how many of ``rows`` a key
    has.  Keys of more than ``hot`` rows are few (one in ``hot`` rows) and are broadcast."""
    heavy = table.where(F.col("n") > hot).drop("n")
    light = table.where(F.col("n") <= hot).drop("n")
    if heavy.isEmpty():
        return rows.join(light, key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def split_mask(mask: int, parts: int) -> list[int]:
    """The free bits of ``mask`` cut into ``parts`` runs, each added to ``mask``."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _links(fps: list[int], distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints of one bucket."""
    n = len(fps)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    if n <= 8:
        pairs = ((i, j) for i in range(n) for j in range(i + 1, n) if ((fps[i] ^ fps[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance)
    else:
        x = np.array(fps, dtype=np.int64).view(np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
        rows, cols = np.nonzero(np.triu(near, 1))
        pairs = zip(rows.tolist(), cols.tolist(), strict=True)
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((fps[i], fps[j]))
    return out


def block_links(fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame | None:
    """Edges ``a, b`` (both directions) whose components are those of all links among
    the distinct ``fp`` of ``fps``; None if there are none."""
    spark = fps.sparkSession
    parts = distance + 1

    def verify(batches):
        for b in batches:
            src, dst = [], []
            for group in b.column("fps").to_pylist():
                for x, y in _links(group, distance):
                    src += (x, y)
                    dst += (y, x)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["a", "b"])

    found = []
    masks, rows = [0], fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        finer = {_signed(m): [_signed(s) for s in split_mask(m, parts)] for m in masks}
        table = spark.createDataFrame([(m, s) for m, subs in finer.items() for s in subs], "mask long, sub long")
        if len(finer) == 1:
            subs = F.array(*(F.lit(s).cast("long") for s in finer[_signed(masks[0])]))
            keyed = rows.select(F.explode(subs).alias("mask"), "fp")
        else:  # at most (distance + 1) ** levels rows
            keyed = rows.join(F.broadcast(table), "mask").select(F.col("sub").alias("mask"), "fp")
        keyed = keyed.withColumn("value", F.expr("fp & mask"))
        masks = sorted({s for subs in finer.values() for s in subs})
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(keyed.join(sizes, ["mask", "value"]), "simhash-buckets")
        small = sized.where(F.col("n") <= bucket).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
        found.append(written(small.select("fps").mapInArrow(verify, "a long, b long"), "simhash-links"))
        rows = sized.where(F.col("n") > bucket).select("mask", "fp")
        # masks that still have rows: they are few after a level or two
        masks = [r["mask"] & (1 << BITS) - 1 for r in rows.select("mask").distinct().collect()]
        if not masks or BITS - min(m.bit_count() for m in masks) <= distance:
            break
    if masks:  # nothing but the last free bits differ, so all of a bucket is linked
        rest = rows.withColumn("value", F.expr("fp & mask"))
        hubs = rest.groupBy("mask", "value").agg(F.min("fp").alias("hub"))
        star = rest.join(hubs, ["mask", "value"]).where("fp <> hub")
        found.append(star.select(F.col("fp").alias("a"), F.col("hub").alias("b")).union(star.select(F.col("hub"), F.col("fp"))))
    edges = found[0]
    for e in found[1:]:
        edges = edges.union(e)
    edges = written(edges.distinct(), "simhash-edges")
    return None if edges.isEmpty() else edges


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` with the smallest node of each component; edges are symmetric.

    A round takes the smallest label among a node's neighbours and then that label's
    own label; labels only fall, and their sum stays the same when all is done.
    """
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "components")
    total = None
    while True:
        near = edges.join(labels, edges["a"] == labels["node"]).groupBy("b").agg(F.min("root").alias("root")).select(F.col("b").alias("node"), "root")
        hooked = written(labels.unionByName(near).groupBy("node").agg(F.min("root").alias("root")), "components")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = written(hooked.join(up, "root").select("node", F.least("root", "up").alias("root")), "components")
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def groups(fps: DataFrame, distance: int = 3, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """For each distinct ``fp`` of ``fps`` (``id``, ``fp``) its group: ``fp``, ``root`` (a
    fingerprint that names the group), ``component`` (the group's smallest id) and ``n``
    (rows of the fingerprint)."""
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = block_links(distinct, distance, bucket)
    if edges is None:
        return distinct.select("fp", F.col("fp").alias("root"), F.col("first").alias("component"), "n")
    linked = components(edges)
    member = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = written(member.withColumnRenamed("n", "rows"), "simhash-members")
    least = written(member.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")), "simhash-roots")
    return written(spread_join(member, least, "root", hot).select("fp", "root", "component", F.col("rows").alias("n")), "simhash-groups")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, hot: int = HOT) -> DataFrame:
    """``id_col``, ``fp long`` and ``component`` for each row."""
    fps = written(fingerprints(df, id_col, text_col, width), "simhash-fingerprints")
    found = spread_join(fps, groups(fps, distance, hot=hot).drop("root"), "fp", hot)
    return found.select(F.col("id").alias(id_col), "fp", "component")


def text_key(text: str | None) -> bytes:
    """Sixteen bytes that name a text; null is the empty text."""
    return xxhash.xxh3_128_digest((text or "").encode())


def text_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, hot: int = HOT) -> DataFrame:
    """``id``, ``key`` (``text_key``), ``component`` and ``n`` for each distinct id and text; ``n``
    rows have them.  No text leaves its task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                texts = b.column("text").to_pylist()
                fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([text_key(t) for t in texts], pa.binary()), pa.array(fps)], names=["id", "key", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, key binary, fp bigint")
    fps = written(rows.groupBy("id", "key").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "simhash-texts")
    return spread_join(fps.withColumnRenamed("n", "copies"), groups(fps.select("id", "fp"), distance, hot=hot).drop("root"), "fp", hot).select("id", "key", "component", F.col("copies").alias("n"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, hot: int = HOT) -> DataFrame:
    """The rows of ``df`` with one row of each group: that of its smallest id (a group
    without any id keeps one row; of rows that repeat that id one stays)."""
    fps = written(fingerprints(df, id_col, text_col, width, keep=True), "simhash-rows")
    ids = fps.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "copies")
    best = ids.join(groups(fps, distance, hot=hot).select("fp", "root"), "fp").groupBy("root").agg(F.min(rank).alias("best"))
    best = written(best.select("root", "best.id", "best.fp", "best.copies"), "simhash-best")
    kept = fps.join(best.select("root", F.col("id").alias("best_id"), F.col("fp").alias("best_fp")), F.expr("fp = best_fp AND id <=> best_id"))
    if not best.where("copies > 1").isEmpty():
        kept = kept.dropDuplicates(["root"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """The signed keys of the buckets a set of shingle hashes falls into."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        x = hashes[i : i + (1 << 12), None].astype(np.uint64)
        x = (x ^ x >> np.uint64(29)) * _MULTIPLY + _ADD
        least = np.minimum(least, (x ^ x >> np.uint64(32)).min(axis=0))
    digest = xxhash.xxh64_intdigest
    return [_signed(digest(part.tobytes(), b)) for b, part in enumerate(least.reshape(BANDS, ROWS))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _leader_links(rows, similarity: float):
    """Links ``(leader, member)`` of a stream of ``(bucket, key, set)`` sorted by bucket and
    rank.  A row that is similar to no leader of its bucket becomes one, so that only the
    leaders of one bucket are held and large groups of copies take linear time."""
    now, leaders = None, []
    for bucket, key, own in rows:
        if bucket != now:
            now, leaders = bucket, []
        n, new = len(own), True
        for lead, other in leaders:
            if similarity * max(n, len(other)) <= min(n, len(other)) and jaccard(other, own) >= similarity:
                new = False
                yield lead, key
        if new:
            leaders.append((key, own))


def keep_dissimilar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """The rows of ``df`` without those that have a copy of ``similarity`` or more, exact or
    near, of a smaller id (or of the same id and an earlier row).

    Groups are components of the verified links.  Two rows of one bucket that are similar
    never both stay: the later one is a leader that was compared with the earlier one, or
    is linked to an earlier leader.  Texts are joined by merging at every size.
    """
    rows = written(df.select(F.struct(*map(quoted, df.columns)).alias("row"), F.monotonically_increasing_id().alias("key")), "near-rows")

    def features(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                same, fps, keys = [], [], []
                for t in b.column("text").to_pylist():
                    h = shingle_hashes(t, width)
                    fps.append(_signed(fingerprint_of(h)))
                    h = np.unique(h)
                    same.append(_signed(xxhash.xxh64_intdigest(h.tobytes())))
                    keys.append(bands(h))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("key"), pa.array(same, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "key", "same", "fp", "bands"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    texts = rows.select(F.col("row")[id_col].alias("id"), "key", F.col("row")[text_col].alias("text"))
    found = written(texts.mapInArrow(features, f"id {kind}, key long, same long, fp long, bands array<long>"), "near-features")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    # equal shingle sets are one text from here on
    first = found.groupBy("same").agg(F.min(F.struct(rank.alias("rank"), "fp", "bands")).alias("z"))
    first = written(first.select("z.rank.id", "z.rank.key", "z.fp", "z.bands"), "near-texts")
    near = groups(first.select(F.col("key").alias("id"), "fp"), distance).select("fp", F.xxhash64(F.lit("fp"), "root").alias("bucket"))
    # a text's buckets; those with the same members are one
    held = first.select(F.explode("bands").alias("bucket"), "key").union(first.join(near, "fp").select("bucket", "key"))
    sizes = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x")).where("n > 1")
    held = held.join(sizes.groupBy("n", "m", "x").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket").distinct()
    held = written(held, "near-buckets")

    def sets(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                out = [np.unique(shingle_hashes(t, width)).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(out, pa.binary())], names=["id", "key", "hashes"])

    def verify(batches):
        stream = ((k, i, np.frombuffer(h, "<u8")) for b in batches for k, i, h in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "hashes")), strict=True))
        src, dst = [], []
        for x, y in _leader_links(stream, similarity):
            src += (x, y)
            dst += (y, x)
            if len(src) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["a", "b"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["a", "b"])

    members = texts.join(held.select("key").distinct().hint("merge"), "key", "left_semi").select("id", "key", "text").mapInArrow(sets, f"id {kind}, key long, hashes binary")
    # ranked rows of a bucket in one task
    members = held.join(members, "key").repartition("bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_last(), "key").select("bucket", "key", "hashes")
    edges = written(members.mapInArrow(verify, "a long, b long").distinct(), "near-edges")
    best = first.select("key")
    if not edges.isEmpty():
        linked = first.join(components(edges), F.col("key") == F.col("node"))
        later = linked.join(linked.groupBy("root").agg(F.min(rank).alias("best")).select("root", F.col("best.key").alias("best")), "root").where("key <> best")
        best = best.join(later.select("key"), "key", "left_anti")
    out = written(found.select("key").join(best, "key", "left_anti"), "near-dropped")
    return rows.join(out.hint("merge"), "key", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in df.columns))
