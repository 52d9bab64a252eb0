"""Token-id files compressed with a Re-Pair grammar per shard.

Rows are range-partitioned and sorted by id, encoded, and cut into shards of about
``shard`` ids.  In each shard frequent pairs of neighbouring ids are replaced by new
nonterminals, round after round, until no pair occurs twice; pairs never cross a
document's end, so each document has its own stretch of the compressed sequence.
A round takes all pairs near the highest count at once; where two of them overlap the more
frequent one goes first and the other waits.  A pair that occurs once can only be repeated
after one of its symbols has changed, so a round looks at pairs that were repeated or have
a new symbol, and the rounds become short.  A shard stores the rules, the expansion length
of every nonterminal, the compressed sequence and where each document starts in it, so
one document, or one position in it, is decoded without the rest.

The file format: parquet files, one row per shard, ``part`` and ``seq`` giving the
order, ``first`` the number of ids before the shard inside its part, and ``blob`` the
shard itself (magic ``RPG2``, six little-endian 64-bit counts, then the arrays).
Spark's committer makes a file visible only when its task has succeeded.

Cases: null text is the empty text, which holds the end id alone; null ids come
first; rows that repeat an id follow one another; an empty table gives no shards and
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, new_path

#: Ids in a shard, about.
SHARD = 1 << 19
#: Most recurring stretches of text that a worker remembers, and most pieces of stretches
#: of several pieces; beyond it the memory starts anew.
CACHE_WORDS = 300_000
CACHE_PIECES = 100_000
MAGIC = b"RPG2"
NO_ID = np.iinfo(np.int64).min
# The pre-tokenisation pattern of byte-level vocabularies (white space as
# Unicode defines it), and the same for texts of ASCII and Latin letters alone, where
# the standard matcher is faster.
SPACES = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^{SPACES}{LATIN}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: ``encode_batch`` cuts texts before these characters.
CUTS = " \n.,"
_CUT = np.isin(np.arange(256), list(CUTS.encode()))
_ID = attrgetter("id")


class _Pieces(dict):
    """Ids of the pieces seen so far; a new piece is encoded when it is first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _borders(entries: pa.Array, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per string (none is empty): 0 if it ends with a letter or digit, 1 with white space, 2
    with anything else; and whether it starts with a full stop or comma."""
    stops = np.cumsum(pc.binary_length(entries).to_numpy(), dtype=np.int64)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    last, head = data[stops - 1], data[np.append(0, stops[:-1])]
    table = np.array([0 if chr(c).isalnum() else 1 if chr(c).isspace() else 2 for c in range(128)] + [2] * 128, np.int8)
    kind = table[last]
    for k in np.flatnonzero(last >= 128).tolist():
        end = words[k][-1]
        kind[k] = 0 if end.isalnum() else 1 if end.isspace() else 2
    return kind, (head == ord(".")) | (head == ord(","))


class PieceEncoder:
    """The ids of a text from the tokenizers library.

    The text is cut where the tokenizer's own pre-tokeniser cuts it and each distinct
    piece goes through the library's model once; other kinds of tokenizers get the
    whole text.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        from .bpe_stream import byte_symbols

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.symbols = dict(enumerate(byte_symbols()))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
            self.by_piece = False
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.general, self.latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        self.other = re.compile(rf"[^\x00-\x7f{LATIN}]")
        self.by_word = self.by_piece and not any(c in t for t in self.special for c in CUTS)
        self.known = _Pieces(self._piece)
        self.words: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these the space alone has another symbol
            coded = piece.replace(" ", self.symbols[32])
        else:
            coded = (piece if piece.isascii() else piece.encode().decode("latin1")).translate(self.symbols)
        ids = [t.id for t in self.tokenizer.model.tokenize(coded)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """The ids of a stretch between cuts."""
        find = self.latin if word.isascii() or not self.other.search(word) else self.general
        pieces = find.findall(word)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def _simple(self, words: list[str]) -> list[bytes]:
        """The ids of stretches that are one piece."""
        blob = "\n".join(words)  # no stretch of letters holds a line end
        blob = blob.replace(" ", self.symbols[32]) if blob.isascii() else blob.encode().decode("latin1").translate(self.symbols | {10: "\n"})
        flat: list[int] = []
        stops = [0]
        tokenize = self.tokenizer.model.tokenize
        for coded in blob.split("\n"):
            flat += map(_ID, tokenize(coded))
            stops.append(4 * len(flat))
        raw = np.array(flat, dtype="<u4").tobytes()
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def _words(self, entries: pa.Array, words: list[str], counts: list[int]) -> list[bytes]:
        """The ids of every stretch; those that occur once are not remembered."""
        got = list(map(self.words.get, words))
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        new = [k for k, ids in enumerate(got) if ids is None]
        if not new:
            return got
        single = pc.match_substring_regex(entries, f"^ ?[{LATIN}]+$").to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(entries).to_numpy(zero_copy_only=False)
        for group in ([k for k in new if single[k] and plain[k]], [k for k in new if single[k] and not plain[k]]):
            if group:
                for k, ids in zip(group, self._simple([words[k] for k in group]), strict=True):
                    got[k] = ids
        remember = self.words
        for k in new:
            if got[k] is None:
                got[k] = self._word(words[k])
            if counts[k] > 1 and len(words[k]) <= 64:
                remember[words[k]] = got[k]
        return got

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of every text (without nulls).

        Texts are cut before spaces, line ends, full stops and commas, each distinct
        stretch of the batch is encoded once, and the ids are put together again.  The
        pre-tokeniser cuts there too unless white space precedes a space or line end, or
        anything but a letter or digit precedes a full stop or comma; texts in which
        that happens, or which hold special tokens, are encoded by themselves.
        """
        if not self.by_word or not len(texts):
            return [self.encode(t) for t in texts.to_pylist()]
        alone = np.zeros(len(texts), dtype=bool)
        for t in self.special:
            alone |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        _, offsets, buffer = texts.buffers()
        offsets = np.frombuffer(offsets, "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(buffer, np.uint8)[: offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
        cut = _CUT[data]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        cut[: offsets[0]] = False
        starts = np.flatnonzero(cut)
        del cut
        if not len(starts):
            return [self.encode(t) for t in texts.to_pylist()]
        bounds = np.searchsorted(starts, offsets)
        edges = pa.py_buffer(np.append(starts, offsets[-1]).astype("<i4").tobytes())
        coded = pa.StringArray.from_buffers(len(starts), edges, buffer).dictionary_encode()
        place, entries = coded.indices.to_numpy(), coded.dictionary
        words = entries.to_numpy(zero_copy_only=False).tolist()
        kind, stop_mark = (x[place] for x in _borders(entries, words))
        joined = np.zeros(len(starts), dtype=bool)
        joined[1:] = (kind[:-1] == 1) | ((kind[:-1] == 2) & stop_mark[1:])
        some = bounds[:-1] < bounds[1:]
        joined[bounds[:-1][some]] = False  # nothing precedes a text's first stretch
        alone[some] |= np.logical_or.reduceat(joined, bounds[:-1][some])
        del kind, stop_mark, joined
        got = self._words(entries, words, np.bincount(place, minlength=len(words)).tolist())
        ids = pa.array(got, pa.large_binary()).take(coded.indices)
        stops = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset :][bounds].tolist()
        flat = memoryview(ids.buffers()[2])
        return [self.encode(texts[k].as_py()) if by_itself else bytes(flat[stops[k] : stops[k + 1]]) for k, by_itself in enumerate(alone.tolist())]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out: list[bytes] = []
        at = 0
        stretches: list[tuple[str, int | None]] = []
        if self.split is not None:
            for m in self.split.finditer(text):
                stretches.append((text[at : m.start()], self.special[m.group()]))
                at = m.end()
        stretches.append((text[at:], None))
        ids = self.known.__getitem__
        for stretch, special in stretches:
            find = self.general if self.other.search(stretch) else self.latin
            out.append(b"".join(map(ids, find.findall(stretch))))
            if special is not None:
                out.append(np.array([special], dtype="<u4").tobytes())
        return b"".join(out)


#: A round takes the pairs whose count is at least this part of the highest one.
SHARE = 64


def _by_pair(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``code``, and ``code`` sorted."""
    bits = len(code).bit_length()
    if int(code.max()).bit_length() + bits < 63:  # one sort of both is faster than a sort of places
        key = np.sort(code << bits | np.arange(len(code)))
        return key & ((1 << bits) - 1), key >> bits
    order = np.argsort(code)
    return order, code[order]


def repair(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """Compress ``ids`` (documents end before the positions ``ends``) until no pair has two
    occurrences that do not overlap.

    Returns the sequence, its document ends, the rules (left, right) of every round and the
    number of the first nonterminal.
    """
    n = len(ids)
    base = symbols = int(ids.max()) + 1 if n else 1
    number = np.int32 if 4 * n + base < 1 << 31 else np.int64  # small arrays stay in the cache
    seq = np.append(ids, 0).astype(number)
    after, before = np.arange(1, n + 2, dtype=number), np.arange(-1, n, dtype=number)  # neighbours; n is none
    stops = ends[ends > 0]
    after[stops - 1] = n
    before[0] = n
    before[stops] = n
    alive, live = np.ones(n, dtype=bool), np.flatnonzero(after[:n] < n)
    rank, mark = np.zeros(n + 1, dtype=number), np.zeros(n + 1, dtype=bool)
    rules: list[np.ndarray] = []
    while len(live):
        order, code = _by_pair(seq[live].astype(np.int64) * symbols + seq[after[live]])
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        counts = np.diff(np.append(first, len(code)))
        repeated = counts >= 2
        if not repeated.any():
            break
        # positions grouped by their pair; those of pairs that occur once drop out
        live = live[order[np.repeat(repeated, counts)]]
        codes, counts = code[first[repeated]], counts[repeated]
        taken = counts >= max(2, int(counts.max()) // SHARE)
        at = live[np.repeat(taken, counts)]
        codes, some = codes[taken], counts[taken]
        pair = np.repeat(np.arange(len(some)), some)
        # the more frequent of two overlapping pairs goes first, the smaller code on a tie
        place = np.empty(len(some), dtype=number)
        place[np.argsort(-some, kind="stable")] = np.arange(len(some), 0, -1)
        own = place[pair]
        rank[at] = own
        right, left = rank[after[at]], rank[before[at]]
        wins = (own >= right) & (own >= left)
        run = (own == right) | (own == left)
        if run.any():  # of a run of one symbol every second pair
            spot = np.flatnonzero(run)
            spot = spot[np.argsort(at[spot])]
            opens = rank[before[at[spot]]] != own[spot]
            step = np.arange(len(spot))
            wins[spot] &= (step - np.maximum.accumulate(np.where(opens, step, 0))) & 1 == 0
        rank[at] = 0
        wins &= (np.bincount(pair[wins], minlength=len(some)) >= 2)[pair]
        mark[live] = True
        if not wins.any():  # occurrences of the most frequent pair overlap one another
            mark[at[own == own.max()]] = False
            live = np.flatnonzero(mark)
            mark[live] = False
            continue
        at, pair = at[wins], pair[wins]
        used = np.zeros(len(some), dtype=bool)
        used[pair] = True
        codes = codes[used]
        rules.append(np.stack([codes // symbols, codes % symbols], axis=1))
        gone = after[at]
        seq[at] = symbols + (np.cumsum(used) - 1)[pair]
        symbols += len(codes)
        alive[gone] = False
        beyond = after[gone]
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        mark[before[at]] = True
        mark[at] = beyond < n
        mark[gone] = False
        mark[n] = False
        live = np.flatnonzero(mark)
        mark[live] = False
    kept = np.concatenate([[0], np.cumsum(alive)])
    return seq[:n][alive].astype("<u4"), kept[ends], rules, base


class Shard:
    """One shard, as bytes or decoded."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, length, rules, rounds, self.base, self.total = np.frombuffer(blob, "<i8", 6, 4).tolist()
        at = 52
        self.ids = np.frombuffer(blob, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(blob, "<i8", docs + 1, at)  # in ids
        at += 8 * (docs + 1)
        self.ends = np.frombuffer(blob, "<i8", docs, at)  # in the sequence
        at += 8 * docs
        self.rounds = np.frombuffer(blob, "<i8", rounds, at)  # rules of each round
        at += 8 * rounds
        self.rules = np.frombuffer(blob, "<u4", 2 * rules, at).reshape(rules, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(blob, "<u4", rules, at)
        at += 4 * rules
        self.seq = np.frombuffer(blob, "<u4", length, at)

    @staticmethod
    def pack(doc_ids: list[int | None], arrays: list[bytes]) -> bytes:
        counts = np.array([len(a) // 4 for a in arrays], dtype="<i8")
        starts = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        ids = np.frombuffer(b"".join(arrays), "<u4")
        seq, ends, rounds, base = repair(ids, starts[1:])
        lengths = np.ones(base, dtype=np.int64)
        for r in rounds:  # a rule's parts are older than its round
            lengths = np.concatenate([lengths, lengths[r].sum(axis=1)])
        rules = np.concatenate(rounds) if rounds else np.zeros((0, 2), dtype=np.int64)
        head = np.array([len(doc_ids), len(seq), len(rules), len(rounds), base, len(ids)], dtype="<i8")
        names = np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8")
        sizes = np.array([len(r) for r in rounds], dtype="<i8")
        return b"".join([MAGIC, *(x.tobytes() for x in (head, names, starts, ends.astype("<i8"), sizes, rules.astype("<u4"), lengths[base:].astype("<u4"), seq))])

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol's expansion, concatenated, with its start and length."""
        if not hasattr(self, "_memo"):
            lengths = np.concatenate([np.ones(self.base, dtype=np.int64), self.lengths.astype(np.int64)])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat = np.empty(int(lengths.sum()), dtype="<u4")
            flat[: self.base] = np.arange(self.base)
            self._memo = flat, starts, lengths
            at = 0
            for n in self.rounds.tolist():
                parts = self.expand(self.rules[at : at + n].reshape(-1))
                begin = starts[self.base + at]
                flat[begin : begin + len(parts)] = parts
                at += n
        return self._memo

    def expand(self, seq: np.ndarray) -> np.ndarray:
        flat, starts, lengths = self._flat()
        n = lengths[seq]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        return flat[np.repeat(starts[seq] - (stop - n), n) + np.arange(total)]

    def decode(self) -> np.ndarray:
        """All ids of the shard."""
        return self.expand(self.seq)

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's document number ``k`` alone."""
        return self.expand(self.seq[self.ends[k - 1] if k else 0 : self.ends[k]])

    def token(self, k: int, position: int) -> int:
        """One id of document ``k``, by walking down the rules along stored lengths."""
        for s in self.seq[self.ends[k - 1] if k else 0 : self.ends[k]].tolist():
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if position >= n:
                position -= n
                continue
            while s >= self.base:
                a, b = self.rules[s - self.base].tolist()
                n = 1 if a < self.base else int(self.lengths[a - self.base])
                if position < n:
                    s = a
                else:
                    position -= n
                    s = b
            return s
        raise IndexError(position)


@functools.cache
def encoder_of(tokenizer: str) -> PieceEncoder:
    """The worker's encoder; tasks that follow one another share what it remembers."""
    return PieceEncoder(tokenizer)


def write_ids(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard: int = SHARD, path: str | None = None) -> str:
    """Encode every row and write the shards in ascending id order; returns the path."""
    path = path or new_path(df.sparkSession, "token-ids")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        names: list[int | None] = []
        arrays: list[bytes] = []
        held = first = seq = 0

        def row():
            blob = Shard.pack(names, arrays)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "first", "n_ids", "blob"])

        for whole in batches:
            for b in chunks(whole, "text", 8 << 20):
                for doc, one in zip(b.column("id").to_pylist(), encoder.encode_batch(b.column("text")), strict=True):
                    one += end
                    names.append(doc)
                    arrays.append(one)
                    held += len(one) // 4
                    if held >= shard:
                        yield row()
                        first, seq = first + held, seq + 1
                        names, arrays, held = [], [], 0
        if names:
            yield row()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows.mapInArrow(run, "part int, seq int, first long, n_ids long, blob binary").write.parquet(path)
    return path


def read_ids(spark, path: str) -> DataFrame:
    """Decode the files: ``doc_id``, ``start`` (ids before the document in all files) and
    ``ids`` (little-endian unsigned 32-bit integers) per document."""
    files = spark.read.schema("part int, seq int, first long, n_ids long, blob binary").parquet(path)
    sums = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per partition written
    base, before = [], 0
    for part, n in sums:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part int, base long")

    def run(batches):
        for b in batches:
            for part, first, blob in zip(b.column("part").to_pylist(), b.column("first").to_pylist(), b.column("blob"), strict=True):
                s = Shard(blob.as_py())
                ids = s.decode()
                raw, starts = memoryview(ids.tobytes()), s.starts.tolist()
                docs = [None if d == NO_ID else d for d in s.ids.tolist()]
                for k in range(0, len(docs), 2048):
                    cut = range(k, min(k + 2048, len(docs)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[k : k + 2048], pa.int64()), pa.array([part] * len(cut), pa.int32()), pa.array([first + starts[i] for i in cut], pa.int64()), pa.array([raw[4 * starts[i] : 4 * starts[i + 1]].tobytes() for i in cut], pa.binary())],
                        names=["doc_id", "part", "start", "ids"],
                    )

    docs = files.select("part", "first", "blob").mapInArrow(run, "doc_id long, part int, start long, ids binary")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "ids")


