"""Language-model scores by context-tree weighting over bytes.

Text is lower-cased (A-Z) and read as bytes with an end mark.  A byte is eight binary
decisions, highest bit first; each decision is made in the context of the bits of the
byte so far and of the last ``0 .. depth`` bytes.  Every context node has a
Krichevsky-Trofimov estimate of its bit counts in the training texts, and the nodes
from the root to the deepest are mixed by their context-tree weights: a node's
weighted probability is the mean of its own estimate's and of the product of its
children's, so all depths and all prunings of the tree are weighed by how well they
code the training texts.  A text's score is the log10 of the product over its bytes.

Every context of the training texts is in the model, however rare, and the model never
stands in one place.  Texts are packed into chunks of about ``chunk`` bytes.  A chunk
asks once for each of its distinct byte strings and words, with their training counts;
requests are split into buckets by the ``TOP`` nearest context bytes, so a bucket holds
whole subtrees, builds them, and answers each chunk with the strings' probabilities.
Only sums over the nodes nearest the root (contexts of less than ``TOP`` bytes: at most
``255 * 2 ** 16`` nodes, whatever the corpus; some hundred thousand for text) go to the
driver, which weighs them and sends them out.  Strings of texts outside the training
set are requested with count zero: they form nodes without counts, which change nothing.

Words for the unigram base score go the same way: a chunk asks once for each distinct
word, a bucket of words sums their counts and answers.  Requests and answers are sorted,
compressed lists, so what is shuffled is a fraction of the text.

Cases: null text is the empty text, whose only token is the end; without training
rows every bit has probability one half and the base is uniform over nothing,
``log10(1 / (0 + 1))`` a token; a null ``learn`` condition is false; rows that repeat an
id are scored each; null ids are kept; an empty table gives an empty result; extra
columns are ignored; very long texts are chunks of their own.  Probabilities of byte
strings travel as 32-bit floats.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, chunks, written

END = 0xFF  # never part of UTF-8
DEPTH = 5
#: Nearest context bytes that decide a string's bucket.
TOP = 3
#: Bytes of text in a chunk, about.
CHUNK = 16 << 20
#: Distinct words and strings that a task holds before it sends them off.
WORDS, STRINGS = 1_000_000, 4_000_000
END_TOKEN = b""  # no word is empty
LN2 = math.log(2.0)


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # ASCII white space, x09-x0D and x20


def byte_strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """One code per byte (contexts first, nearest byte highest, then the byte) and the
    number of codes per text.  Before a text stand ``depth`` zero bytes."""
    pad = b"\0" * depth
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, bytes([END]))), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    n = len(flat) - depth
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for d in range(1, depth + 1):
        code <<= np.uint64(8)
        code |= flat[depth - d : depth - d + n]
    code <<= np.uint64(8)
    code |= flat[depth : depth + n]
    own = np.ones(len(code), dtype=bool)
    starts = np.cumsum(sizes + depth)[:-1] - depth  # pads of the texts after the first
    for d in range(depth):
        own[starts + d] = False
    return code[own], sizes


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive numbers: Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8.0
    z = 1.0 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z * (1.0 / 1680)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


_SMALL = 1 << 12
_HALF, _ONE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _of_count(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _SMALL)
    if len(large):
        out[large] = _lgamma(n[large] + shift)
    return out


def log_pe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of ``a`` zeros and ``b`` ones."""
    return _of_count(a, _HALF, 0.5) + _of_count(b, _HALF, 0.5) - _of_count(a + b, _ONE, 1.0) - math.log(math.pi)


def _weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's log weighted probability and the weight of its own estimate."""
    own = log_pe(zeros, ones)
    weighted = np.logaddexp(own, below) - LN2
    return weighted, np.exp(own - LN2 - weighted)


def grow(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The subtrees below the contexts of ``top`` bytes.

    ``codes`` are sorted and distinct.  Returns the mixed probability of each code's bits
    over the depths ``top .. depth`` (8 x codes), and per node one byte nearer the root the
    sums over its children here: ``(keys, zeros, ones, log weighted)``, a key being the
    context and the bits so far behind a one.
    """
    levels = [(codes, counts.astype(np.float64), None)]
    while len(levels) <= depth - top:
        c, n, _ = levels[-1]
        c, up = np.unique(c >> np.uint64(16) << np.uint64(8) | c & np.uint64(0xFF), return_inverse=True)  # the farthest byte goes
        levels.append((c, np.bincount(up, weights=n, minlength=len(c)), up))
    mixed = np.empty((8, len(codes)))
    sums = []
    for k in range(8):
        at = np.arange(len(codes))  # each code's place on the level
        weighted = heads = None
        for i, (c, n, up) in enumerate(levels):
            key = c >> np.uint64(8 - k)
            new = np.ones(len(c), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            node = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            bit = (c >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            both = np.bincount(node, weights=n, minlength=len(first))
            ones = np.bincount(node, weights=n * bit, minlength=len(first))
            zeros = both - ones
            q = (np.where(bit, ones[node], zeros[node]) + 0.5) / (both[node] + 1.0)
            if i == 0:
                weighted, p = log_pe(zeros, ones), q
            else:
                below = np.bincount(node[up[heads]], weights=weighted, minlength=len(first))
                weighted, w = _weigh(zeros, ones, below)
                at = up[at]
                w = w[node[at]]
                p = w * q[at] + (1 - w) * p
            heads = first
        mixed[k] = p
        c = levels[-1][0][first]
        keys = c >> np.uint64(16) << np.uint64(8) | np.uint64(1 << k) | (c & np.uint64(0xFF)) >> np.uint64(8 - k)
        keys, place = np.unique(keys, return_inverse=True)
        sums.append((keys, *(np.bincount(place, weights=x, minlength=len(keys)) for x in (zeros, ones, weighted))))
    return mixed, tuple(np.concatenate(x) for x in zip(*sums, strict=True))


class Crown:
    """The nodes nearest the root: the probability of a one is ``alpha + beta * p`` where the
    subtrees below say ``p``."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int):
        order = np.argsort(keys)
        self.top, self.keys = top, keys[order]
        levels = []
        key, zeros, ones, below = self.keys, zeros[order], ones[order], below[order]
        for d in range(top - 1, -1, -1):
            weighted, w = _weigh(zeros, ones, below)
            levels.append((w, (ones + 0.5) / (zeros + ones + 1.0)))
            if d:
                key, up = np.unique(key >> np.uint64(16) << np.uint64(8) | key & np.uint64(0xFF), return_inverse=True)
                zeros, ones, below = (np.bincount(up, weights=x, minlength=len(key)) for x in (zeros, ones, weighted))
                levels[-1] += (up,)
        self.alpha, self.beta = np.zeros(len(self.keys)), np.ones(len(self.keys))
        at = np.arange(len(self.keys))
        for w, one, *up in levels:
            self.alpha = w[at] * one[at] + (1 - w[at]) * self.alpha
            self.beta = (1 - w[at]) * self.beta
            if up:
                at = up[0][at]

    def log10(self, codes: np.ndarray, mixed: np.ndarray, depth: int) -> np.ndarray:
        """log10 of each code's last byte."""
        out = np.zeros(len(codes))
        context = codes >> np.uint64(8 * (depth + 2 - self.top)) << np.uint64(8)
        byte = codes & np.uint64(0xFF)
        for k in range(8):
            at = np.searchsorted(self.keys, context | np.uint64(1 << k) | byte >> np.uint64(8 - k))
            one = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            a, b = self.alpha[at], self.beta[at]
            out += np.log10(np.where(one, a, 1 - a - b) + b * mixed[k])
        return out


def string_logs(codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = TOP) -> np.ndarray:
    """log10 of the last byte of each of the sorted ``codes``, in one place."""
    top = min(top, depth)
    mixed, sums = grow(codes, counts, depth, top)
    keys, place = np.unique(sums[0], return_inverse=True)
    return Crown(keys, *(np.bincount(place, weights=x, minlength=len(keys)) for x in sums[1:]), top).log10(codes, mixed, depth)


# ------------------------------------------------------------------ what travels

_CODEC = pa.Codec("zstd", 1)


def pack_text(raw: bytes) -> bytes:
    return struct.pack("<q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpack_text(raw: bytes) -> bytes:
    return _CODEC.decompress(raw[8:], struct.unpack_from("<q", raw)[0], asbytes=True)


def pack_words(words: list[bytes], counts: list[int]) -> bytes:
    """Words (without white space, in order) and a count of each."""
    left = pack_text(b"\n".join(words))
    return struct.pack("<qq", len(words), len(left)) + left + _squeeze(np.array(counts, dtype="<i8"))


def unpack_words(raw: bytes) -> tuple[list[bytes], list[int]]:
    n, size = struct.unpack_from("<qq", raw)
    return unpack_text(raw[16 : 16 + size]).split(b"\n"), _restore(raw[16 + size :], "<i8", n).tolist()


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, compressed."""
    return _CODEC.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), asbytes=True) if len(x) else b""


def _restore(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(_CODEC.decompress(raw, n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def pack_strings(codes: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted codes and a 32-bit value of each."""
    left, right = _squeeze(np.diff(codes, prepend=np.uint64(0))), _squeeze(values)
    return struct.pack("<qq", len(codes), len(left)) + left + right


def unpack_strings(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<qq", raw)
    return np.cumsum(_restore(raw[16 : 16 + size], "<u8", n), dtype=np.uint64), _restore(raw[16 + size :], kind, n)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of several lists and their summed counts."""
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def bucket_of(codes: np.ndarray, depth: int, top: int, buckets: int) -> np.ndarray:
    context = codes >> np.uint64(8 * (depth + 1 - top))
    return ((context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)


class Lookup:
    """Values of known codes by hashing: slots that several codes share are left to a
    smaller table with another hash, so no code need be compared."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        multiplier = 0x9E3779B97F4A7C15
        while len(codes):
            bits = max(8, (4 * len(codes)).bit_length())
            m, shift = np.uint64(multiplier), np.uint64(64 - bits)
            slot = codes * m >> shift
            alone = np.bincount(slot.astype(np.int64), minlength=1 << bits)[slot] == 1
            table = np.full(1 << bits, np.nan, dtype=np.float32)
            table[slot[alone]] = values[alone]
            self.tables.append((m, shift, table))
            codes, values = codes[~alone], values[~alone]
            multiplier = multiplier * 0xD1342543DE82EF95 + 2 & 0xFFFFFFFFFFFFFFFF | 1

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        m, shift, table = self.tables[0]
        out = table[codes * m >> shift]
        left = np.flatnonzero(np.isnan(out))
        for m, shift, table in self.tables[1:]:
            if not len(left):
                break
            got = table[codes[left] * m >> shift]
            out[left] = got
            left = left[np.isnan(got)]
        return out


# ------------------------------------------------------------------ passes


def _packed(rows: DataFrame, kind: str, chunk: int) -> DataFrame:
    """``rows`` (``id, text, learn``) as lower-case bytes: a row per stretch of texts, numbered
    by chunk."""

    def run(batches):
        from pyspark import TaskContext

        number, held, seq = TaskContext.get().partitionId() << 24, 0, 0
        for whole in batches:
            for b in chunks(whole, "text"):
                low = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
                sizes = pc.binary_length(low).to_numpy().astype("<i8")
                raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(low)], pa.int32()), low), "")[0].as_py().encode()
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("id"))
                learn = b.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([seq], pa.int32()), pa.array([len(raw)], pa.int64()), ids, pa.array([learn], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([pack_text(raw)], pa.binary())],
                    names=["chunk", "seq", "bytes", "ids", "learn", "sizes", "raw"],
                )
                seq, held = seq + 1, held + len(raw)
                if held >= chunk:
                    number, held = number + 1, 0

    return rows.mapInArrow(run, f"chunk long, seq int, bytes long, ids array<{kind}>, learn binary, sizes binary, raw binary")


def _texts(raw: bytes, sizes: bytes) -> list[bytes]:
    raw = unpack_text(raw)
    stops = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def _requests(packs: DataFrame, depth: int, top: int, buckets: int) -> DataFrame:
    """What each chunk asks each bucket for: ``kind`` 0 for words, 1 for byte strings."""

    def run(batches):
        learned: Counter = Counter()
        other: set[bytes] = set()
        merged: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def rows(kind, blobs):
            m = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array([now] * m, pa.int64()), pa.array([kind] * m, pa.int32()), pa.array([i for i, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["chunk", "kind", "bucket", "data"])

        def flush():
            if now is None:
                return
            other.difference_update(learned)
            home: list[list[bytes]] = [[] for _ in range(buckets)]
            for group in (learned, other):
                for w in group:
                    home[zlib.crc32(w) % buckets].append(w)
            blobs = []
            for i, words in enumerate(home):
                if words:
                    words.sort()
                    blobs.append((i, pack_words(words, [learned[w] for w in words])))  # a missing word counts zero
            yield rows(0, blobs)
            learned.clear()
            other.clear()
            codes, counts = _merge(merged)
            merged.clear()
            place = bucket_of(codes, depth, top, buckets)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.int64))
            yield rows(1, [(i, pack_strings(codes[at], counts[at].astype("<u4"))) for i in range(buckets) if len(at := order[cuts[i] : cuts[i + 1]])])

        for b in batches:
            for i in range(b.num_rows):
                chunk = b.column("chunk")[i].as_py()
                if chunk != now or len(learned) + len(other) > WORDS:
                    yield from flush()
                    now = chunk
                texts = _texts(b.column("raw")[i].as_py(), b.column("sizes")[i].as_py())
                learn = np.frombuffer(b.column("learn")[i].as_py(), np.uint8)
                for trained in (1, 0):
                    own = [t for t, x in zip(texts, learn.tolist(), strict=True) if x == trained]
                    if not own:
                        continue
                    if trained:
                        for t in own:
                            learned.update(words_of(t))
                        learned[END_TOKEN] += len(own)
                    else:
                        for t in own:
                            other.update(words_of(t))
                        other.add(END_TOKEN)
                    codes, _ = byte_strings(own, depth)
                    codes.sort()
                    cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                    counts = np.diff(np.append(cut, len(codes)))
                    merged.append((codes[cut], counts * trained))
                if sum(len(c) for c, _ in merged) > STRINGS:
                    merged[:] = [_merge(merged)]
        yield from flush()

    return packs.select("chunk", "learn", "sizes", "raw").mapInArrow(run, "chunk long, kind int, bucket int, data binary")


def _word_answers(blobs: DataFrame, parts: int) -> DataFrame:
    """``chunk, data``: each chunk's words and their counts in all training texts; and rows
    without a chunk that hold a bucket's ``tokens`` and ``types``."""

    def run(batches):
        now, held = None, []
        total: Counter = Counter()

        def answer():
            for chunk, data in held:
                words, _ = unpack_words(data)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack_words(words, [total[w] for w in words])], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=names)
            sums = pa.array([sum(total.values())], pa.int64()), pa.array([sum(n > 0 for n in total.values())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), *sums], names=names)
            held.clear()
            total.clear()

        names = ["chunk", "data", "tokens", "types"]
        for b in batches:
            for bucket, chunk, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "data")), strict=True):
                if bucket != now and held:
                    yield from answer()
                now = bucket
                held.append((chunk, data))
                for w, n in zip(*unpack_words(data), strict=True):
                    if n:
                        total[w] += n
        if held:
            yield from answer()

    ordered = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "chunk long, data binary, tokens long, types long")


def _trees(blobs: DataFrame, depth: int, top: int, parts: int) -> DataFrame:
    """Per bucket its strings and their mixed probabilities (``data``, ``mixed``), and rows of
    sums for the nodes nearer the root."""

    def run(batches):
        now, parts, held = None, [], 0
        names = ["bucket", "data", "mixed", "node", "zeros", "ones", "below"]

        def build():
            codes, counts = _merge(parts)
            for i in _cuts(codes, depth, top):
                c = codes[i]
                mixed, sums = grow(c, counts[i], depth, top)
                n = len(sums[0])
                blank = [pa.array([None], pa.int64()), *(pa.array([None], pa.float64()) for _ in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack_strings(c, np.zeros(len(c), "<u4"))], pa.binary()), pa.array([mixed.astype("<f4").tobytes()], pa.binary()), *blank], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names=names)

        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist(), strict=True):
                if bucket != now:
                    if parts:
                        yield from build()
                    now, parts, held = bucket, [], 0
                codes, counts = unpack_strings(data, "<u4")
                parts.append((codes, counts.astype(np.int64)))
                held += len(codes)
                if held > STRINGS:
                    parts = [_merge(parts)]
                    held = 0
        if parts:
            yield from build()

    ordered = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "bucket int, data binary, mixed binary, node long, zeros double, ones double, below double")


def _cuts(codes: np.ndarray, depth: int, top: int, size: int = 1 << 19):
    """Slices of about ``size`` codes that hold whole contexts of ``top`` bytes."""
    context = codes >> np.uint64(8 * (depth + 1 - top))
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    at = 0
    while at < len(codes):
        k = np.searchsorted(starts, at + size)
        end = int(starts[k]) if k < len(starts) else len(codes)
        yield slice(at, end)
        at = end


def _answers(blobs: DataFrame, trees: DataFrame, crown, depth: int, parts: int) -> DataFrame:
    """``chunk, data``: each chunk's strings and their log10 probabilities."""

    def run(batches):
        known, now = [], None
        for b in batches:
            out = []
            for bucket, chunk, data, mixed in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "data", "mixed")), strict=True):
                if bucket != now:
                    now, known = bucket, []
                if mixed is not None:
                    codes, _ = unpack_strings(data, "<u4")
                    known.append((codes, crown.value.log10(codes, np.frombuffer(mixed, "<f4").reshape(8, -1), depth).astype("<f4")))
                    continue
                if len(known) > 1:
                    known.sort(key=lambda x: int(x[0][0]))
                    known = [tuple(np.concatenate(x) for x in zip(*known, strict=True))]
                codes, _ = unpack_strings(data, "<u4")
                out.append((chunk, pack_strings(codes, known[0][1][np.searchsorted(known[0][0], codes)])))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["chunk", "data"])

    asked = blobs.select("bucket", "chunk", "data", F.lit(None).cast("binary").alias("mixed"))
    said = trees.where("bucket IS NOT NULL").select("bucket", F.lit(None).cast("long").alias("chunk"), "data", "mixed")
    rows = said.unionAll(asked).repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    return rows.mapInArrow(run, "chunk long, data binary")


def score(df: DataFrame, learn: Column | str, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, chunk: int = CHUNK) -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``
    for each row of ``df``, learning from its rows for which ``learn`` holds."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    top = min(TOP, depth)
    condition = F.expr(learn) if isinstance(learn, str) else learn
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(condition, F.lit(False)).alias("learn"))
    with Scratch(spark, "ctw") as scratch:
        packs = scratch.written(_packed(rows, kind, chunk), "texts")
        size = packs.agg(F.sum("bytes")).first()[0] or 0
        buckets = min(max(8, -(-size // chunk)), 1 << 15)
        requests = scratch.written(_requests(packs, depth, top, buckets), "requests")
        blobs = requests.where("kind = 1").select("bucket", "chunk", "data")
        trees = scratch.written(_trees(blobs, depth, top, buckets), "trees")

        def gather(batches):
            cols = [[] for _ in range(4)]
            for b in batches:
                for held, c in zip(cols, ("node", "zeros", "ones", "below"), strict=True):
                    held.append(b.column(c).to_numpy(zero_copy_only=False))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).astype(t).tobytes()], pa.binary()) for c, t in zip(cols, ("<u8", "<f8", "<f8", "<f8"), strict=True)], names=["node", "zeros", "ones", "below"])

        sums = trees.where("node IS NOT NULL").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
        # at most 255 * 2 ** 16 nodes, packed
        got = sums.mapInArrow(gather, "node binary, zeros binary, ones binary, below binary").collect()
        arrays = [np.concatenate([np.frombuffer(r[i], t) for r in got] or [np.zeros(0, t)]) for i, t in enumerate(("<u8", "<f8", "<f8", "<f8"))]
        crown = spark.sparkContext.broadcast(Crown(*arrays, top))
        answers = _answers(blobs, trees, crown, depth, buckets)
        words = scratch.written(_word_answers(requests.where("kind = 0").select("bucket", "chunk", "data"), buckets), "words")
        total = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
        tokens, types = int(total["tokens"]), int(total["types"])
        none = [F.lit(None).cast(t) for t in (f"array<{kind}>", "binary")]
        said = words.where("chunk IS NOT NULL").select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("seq"), "data", none[0].alias("ids"), none[1].alias("sizes"))
        parts = said.unionAll(answers.select("chunk", F.lit(1), F.lit(0), "data", *none)).unionAll(packs.select("chunk", F.lit(2), "seq", "raw", "ids", "sizes"))
        stream = parts.repartition(buckets, "chunk").sortWithinPartitions("chunk", "kind", "seq")
        per_token = math.log10(tokens + types + 1)

        def run(batches):
            now, weight, held, lookup = None, {}, [], None
            for b in batches:
                for i in range(b.num_rows):
                    chunk, what = b.column("chunk")[i].as_py(), b.column("kind")[i].as_py()
                    if chunk != now:
                        now, weight, held, lookup = chunk, {}, [], None
                    if what == 0:
                        own, counts = unpack_words(b.column("data")[i].as_py())
                        weight.update(zip(own, np.log10(np.array(counts) + 1.0).tolist(), strict=True))
                        continue
                    if what == 1:
                        held.append(unpack_strings(b.column("data")[i].as_py(), "<f4"))
                        continue
                    if lookup is None:
                        codes, first = np.unique(np.concatenate([c for c, _ in held]), return_index=True)
                        lookup = Lookup(codes, np.concatenate([v for _, v in held])[first])
                        held = []
                    own = _texts(b.column("data")[i].as_py(), b.column("sizes")[i].as_py())
                    codes, sizes = byte_strings(own, depth)
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    scores = np.add.reduceat(lookup(codes).astype(np.float64), starts)
                    end = weight[END_TOKEN]
                    n_tokens, known, base = [], [], []
                    for t in own:
                        values = list(map(weight.__getitem__, words_of(t)))
                        n_tokens.append(len(values) + 1)
                        known.append(len(values) - values.count(0.0) + (end > 0))
                        base.append(math.fsum(values) + end - per_token * (len(values) + 1))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("ids").slice(i, 1).flatten(), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * len(own), pa.int64()), pa.array(base, pa.float64()), pa.array(scores)],
                        names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

        result = stream.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return written(result, "ctw-scores")
