"""Best-fit packing of documents into sequences under conflict constraints.

Texts become tokens: their bytes, or the ids of a tokenizer.  Documents longer than
``capacity`` tokens are cut into full sequences and a remainder, so nothing is lost.
Remainders are packed longest first: bins are ordered by what is left in them, and each
bin carries a bitmap of the sources and one of the duplicate clusters it holds.  A piece
takes the successor of its length in that order (the tightest bin it fits in); if a
bitmap shares a bit with the piece, the search goes on to the next bin until one is
compatible, and a new bin opens only if there is none.  So no sequence holds two pieces
of one source or two documents of one cluster.

Packing is sequential, so rows are dealt by the hash of id and text into shards of about
``shard`` rows that are packed independently; a shard's last bins are its only loss.
Texts are shuffled once: the clusters of a shard's texts come to it as a small table, its
full sequences stream through its task, and only remainders are held.  The sequences are
written as Parquet files: ``shard``, ``bin``, ``tokens`` (little-endian, one or four bytes
each) and the pieces in them.

Bin search: bins are kept in one list per state of the hot source, so that a source
that holds a third of all rows does not make every search walk past the bins it
already sits in.

Cases: null text is the empty text; null sources and clusters conflict with nothing;
empty texts get a piece of length 0; null ids are dealt like any other; ties are broken
by id, then text; rows that repeat an id, or an id and its text, are packed as rows of
their own (many of them are dealt apart); an empty table gives no sequences and an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, new_path
from .simhash import text_key


class _Bins:
    """Open bins ordered by residual, with bitmaps of what they hold."""

    def __init__(self):
        self.order: dict[bool, list[tuple[int, int]]] = {False: [], True: []}  # by presence of the hot source
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, length: int, source: int, cluster: int, hot: int, capacity: int) -> tuple[int, int]:
        """The bin that takes the piece and the piece's offset in it."""
        best = None
        for has_hot, bins in self.order.items():
            if has_hot and source & hot:
                continue
            for i in range(bisect_left(bins, (length, -1)), len(bins)):
                left, b = bins[i]
                if best is not None and (left, b) >= best[0]:
                    break
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    best = (left, b), has_hot, i
                    break
        if best is None:
            b, left = len(self.used), capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        else:
            (left, b), has_hot, i = best
            self.order[has_hot].pop(i)
        at = self.used[b]
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.used[b] += length
        insort(self.order[bool(self.sources[b] & hot)], (left - length, b))
        return b, at


def pack_rows(ids: list, lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(row, piece, start in the document, length, bin, offset in the bin)`` for one shard."""
    out, rest = [], []
    bins = 0
    for r, n in enumerate(lengths):
        full = n // capacity if n else 0
        for p in range(full):
            out.append((r, p, p * capacity, capacity, bins, 0))
            bins += 1
        if n % capacity or not n:
            rest.append((n - full * capacity, r, full))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bit: dict = {}
    for s in sources:
        if s is not None:
            bit.setdefault(s, 1 << len(bit))
    dup: dict = {}
    count: dict = {}
    for c in clusters:
        if c is not None:
            count[c] = count.get(c, 0) + 1
    for c, k in count.items():
        if k > 1:  # a cluster with one row conflicts with nothing
            dup[c] = 1 << len(dup)
    held: dict = {}
    for s in sources:
        if s is not None:
            held[s] = held.get(s, 0) + 1
    hot = bit[max(held, key=lambda s: (held[s], str(s)))] if held else 0
    open_bins = _Bins()
    for n, r, p in rest:
        b, at = open_bins.place(n, bit.get(sources[r], 0), dup.get(clusters[r], 0), hot, capacity)
        out.append((r, p, lengths[r] - n, n, bins + b, at))
    return out


def write_sequences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None, tokenizer: str | None = None, capacity: int = 16_384, shard: int = 4096, path: str | None = None
) -> str:
    """Pack every row and write the sequences; returns the path.  Without ``tokenizer`` (a
    tokenizer file) a text's tokens are its bytes.  ``clusters`` are ``id``, ``key``, ``component``
    and ``n`` as ``simhash.text_components`` gives them; without them none conflict."""
    spark = df.sparkSession
    path = path or new_path(spark, "sequences")
    kind = df.schema[id_col].dataType.simpleString()
    width = 4 if tokenizer else 1
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("row"))
    shards = max(1, -(-df.count() // shard))

    def cut(batches):
        if tokenizer:
            from .token_files import encoder_of

            encode = encoder_of(tokenizer).encode_batch
        for whole in batches:
            for b in chunks(whole, "text"):
                texts = encode(b.column("text")) if tokenizer else [t.encode() for t in b.column("text").to_pylist()]
                keys = [text_key(t) for t in b.column("text").to_pylist()]
                own, piece, start, length, tokens = [], [], [], [], []
                for r, t in enumerate(texts):
                    n = len(t) // width
                    for p in range(max(1, -(-n // capacity))):
                        own.append(r)
                        piece.append(p)
                        start.append(p * capacity)
                        length.append(min(capacity, n - p * capacity))
                        tokens.append(t[p * capacity * width : (p + 1) * capacity * width])
                cols = [b.column(c).take(pa.array(own, pa.int64())) for c in ("row", "id", "source")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([keys[r] for r in own], pa.binary()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())], names=["row", "id", "source", "key", "piece", "start", "length", "tokens"])

    def fill(batches):
        now, first, held = None, 0, []
        group: dict = {}
        id_type = None

        def sequence(bins):
            """Bins of ``(id, piece, start, length, tokens)``."""
            ids = pa.array([x[0] for _, group in bins for x in group], id_type)
            stops = [0]
            for _, group in bins:
                stops.append(stops[-1] + len(group))
            flat = [x for _, group in bins for x in group]
            at = [sum(y[3] for y in group[:i]) for _, group in bins for i in range(len(group))]
            cols = [ids, pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int64()), pa.array([x[3] for x in flat], pa.int64()), pa.array(at, pa.int64())]
            pieces = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays(cols, names=["id", "piece", "start", "length", "offset"]))
            tokens = pa.array([b"".join(x[4] for x in group) for _, group in bins], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([now] * len(bins), pa.int32()), pa.array([b for b, _ in bins], pa.int32()), tokens, pieces], names=["shard", "bin", "tokens", "pieces"])

        def pack():
            got = pack_rows([x[0] for x, _, _ in held], [x[3] for x, _, _ in held], [s for _, s, _ in held], [c for _, _, c in held], capacity)
            bins: dict[int, list] = {}
            for r, _, _, _, b, _ in got:  # in the order of their offsets
                bins.setdefault(first + b, []).append(held[r][0])
            numbers = sorted(bins)
            for i in range(0, len(numbers), 256):
                yield sequence([(b, bins[b]) for b in numbers[i : i + 256]])

        for batch in batches:
            id_type = batch.schema.field("id").type
            full = []
            for shard_, key, cluster, *x, source in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "cluster", "id", "piece", "start", "length", "tokens", "source")), strict=True):
                if shard_ != now:
                    if full:
                        yield sequence(full)
                        full = []
                    if held:
                        yield from pack()
                    now, first, held, group = shard_, 0, [], {}
                if cluster is not None:
                    group[x[0], key] = cluster
                elif x[3] == capacity:
                    full.append((first, [x]))
                    first += 1
                else:
                    held.append((x, source, group.get((x[0], key))))
            if full:
                yield sequence(full)
        if held:
            yield from pack()

    pieces = rows.mapInArrow(cut, f"row long, id {kind}, source string, key binary, piece int, start long, length long, tokens binary")
    spot = ["id", "key"]
    if clusters is None:
        pieces = pieces.withColumn("parts", F.lit(1))
        named = None
    else:
        # an id and text that more rows share than a shard should hold goes to several shards
        many = clusters.where(F.col("n") > shard).select(*spot, F.ceil(F.col("n") / shard).cast("int").alias("parts"))
        if many.isEmpty():
            pieces = pieces.withColumn("parts", F.lit(1))
            clusters = clusters.withColumn("parts", F.lit(1))
        else:  # one in ``shard`` rows at most
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in spot]
            pieces, clusters = (d.alias("a").join(F.broadcast(many.alias("b")), same, "left").select("a.*", F.coalesce("b.parts", F.lit(1)).alias("parts")) for d in (pieces, clusters))
        named = clusters.where("component IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = F.pmod(F.xxhash64("id", "key", "part"), F.lit(shards)).cast("int").alias("shard")
    cols = ["source", "piece", "start", "length", "tokens"]
    stream = pieces.withColumn("part", F.pmod("row", F.col("parts")).cast("int")).select(home, *spot, F.lit(None).cast("string").alias("cluster"), *cols)
    if named is not None:
        types = {f.name: f.dataType for f in pieces.schema.fields}
        stream = named.select(home, *spot, F.col("component").cast("string").alias("cluster"), *(F.lit(None).cast(types[c]).alias(c) for c in cols)).unionByName(stream)
    stream = stream.repartition(min(shards, 1 << 15), "shard").sortWithinPartitions("shard", F.col("cluster").isNull(), F.col("length") < capacity, F.col("id").asc_nulls_first(), "tokens")
    stream.mapInArrow(fill, f"shard int, bin int, tokens binary, pieces array<struct<id:{kind},piece:int,start:bigint,length:bigint,offset:bigint>>").write.option("compression", "zstd").parquet(path)
    return path


def read_pieces(spark, path: str, width: int = 1, id_col: str = "doc_id") -> DataFrame:
    """From the files, a row per piece: ``id_col``, ``piece``, ``piece_start``, ``piece_length``,
    ``shard``, ``bin``, ``bin_offset`` and ``piece_crc32`` of its tokens; ``(shard, bin)`` names a
    sequence."""
    rows = spark.read.parquet(path).select("shard", "bin", "tokens", F.explode("pieces").alias("p"))
    own = F.crc32(F.expr(f"substring(tokens, CAST(p.offset * {width} + 1 AS INT), CAST(p.length * {width} AS INT))"))
    return rows.select(F.col("p.id").alias(id_col), F.col("p.piece").alias("piece"), F.col("p.start").alias("piece_start"), F.col("p.length").alias("piece_length"), "shard", "bin", F.col("p.offset").cast("int").alias("bin_offset"), own.alias("piece_crc32"))
