"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoder.  A merge list fixes how far to the right a merge decision can depend on
text not yet seen.  A rule ``(a, b)`` of rank ``r`` fires unless ``b`` (or a piece
on the right spine of ``b``, while ``b`` was being built) was taken first by a rule
``(b, c)`` of a smaller rank; that rule in turn depends on what follows ``c``.
Ranks strictly fall along such a chain, so one pass over the rules in rank order
gives the longest chain, in symbols: the *sufficient lookahead*.  The encoder keeps
a window of ``chunk + lookahead`` symbols, merges inside it and emits the tokens
that end at least ``lookahead`` symbols before the window's end; the rest starts
the next window (merging restarts exactly at any token boundary, since no merge
crossed it).  Around it, normaliser, splitter and merger are iterators: a text is read in
slices of about ``SLICE`` characters that end before a space, where neither normalisation
nor the splitter looks back, and a slice's ids are emitted before the next is read.  So
memory is constant in the length of a text and of a word, beside the text itself and the
ids asked for (four bytes each); a slice without a space goes on to the next one.

Decoder.  An incremental byte-to-text machine: token strings become bytes, and an
incremental UTF-8 decoder turns bytes into text, with U+FFFD for each maximal
invalid part.  It may be fed any split of the id sequence.

Cases: null text is the empty text and gives no ids and an empty decoding; null and
repeated ids are kept as they are, repeated rows give repeated results; merges that
occur twice in the list count where they stand last; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import chunks

#: Most words that a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 300_000
#: Characters that are normalised and split in one go.
SLICE = 1 << 16

# The pre-tokenisation pattern of the word vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [chr(b) if b in range(33, 127) or b in range(161, 173) or b in range(174, 256) else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in own]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a boundary that can still change the tokens left of it.

    ``reach[t]`` holds the widest chain that starts with a rule whose left part is
    ``t``; rules come in rank order, so only smaller ranks are in it.  A rule's right
    part can be broken up through any token on its right spine.
    """
    spine: dict[str, list[str]] = {}
    reach: dict[str, int] = {}
    widest = 1
    for a, b in merges:
        parts = spine.get(b) or [b]
        span = length[b] + max((reach.get(t, 0) for t in parts), default=0)
        reach[a] = max(reach.get(a, 0), span)
        widest = max(widest, span + length[a])
        spine.setdefault(a + b, [a + b, *parts])
    return widest


class StreamingBPE:
    """Encoder and decoder for a byte-level BPE with a word-end suffix, read from a
    tokenizer JSON file (``normalizer``: NFC, white space runs to one space, lower
    case; ``pre_tokenizer``: pattern, then bytes)."""

    def __init__(self, path: str, chunk: int = 4096):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {}
        for r, m in enumerate(merges):
            self.rank[m] = r  # of repeated rules the last one counts
        self.no_rule = len(merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        end = len(self.suffix)
        length = {t: (len(t) - end if end and t.endswith(self.suffix) and len(t) > end else len(t)) for t in {x for m in merges for x in m}}
        self.lookahead = sufficient_lookahead(merges, length)
        self.chunk = chunk
        self.symbols = byte_symbols()
        self.to_symbols = dict(enumerate(self.symbols))
        self.to_byte = {c: b for b, c in enumerate(self.symbols)}
        self.words = regex.compile(WORD_PATTERN)
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, list[int]] = {}

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = regex.sub(r"\s+", " ", text)
            # per character, so no final-sigma rule
            return text.replace("Σ", "σ").lower()
        return text.lower()

    def merge_window(self, parts: list[str]) -> list[str]:
        """All merges inside one window, smallest rank first, leftmost first."""
        rank, last = self.rank.get, self.no_rule
        ranks = [rank(p, last) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == last:
                break
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), last)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), last)
        return parts

    def stream_word(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, emitted as soon as they are stable.  ``symbols`` may be
        any iterator; at most ``chunk + lookahead`` symbols are held."""
        held: list[str] = []
        limit = self.chunk + self.lookahead
        for s in symbols:
            held.append(s)
            if len(held) >= limit:
                done, at = self.merge_window(held[:]), 0
                for t in done:
                    width = len(t)
                    if at + width > self.chunk:
                        break
                    at += width
                    yield t
                held = held[at:]
        if held:
            held[-1] += self.suffix
            yield from self.merge_window(held)

    def word_ids(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            coded = word.encode().decode("latin1").translate(self.to_symbols)
            vocab = self.vocab
            ids = [vocab[t] for t in self.stream_word(coded) if t in vocab]
            if len(word) <= 64:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def slices(self, text: str, size: int = SLICE) -> Iterator[str]:
        """``text`` in parts that begin with a space after an ASCII character."""
        at = 0
        while len(text) - at > size:
            cut = text.find(" ", at + size)
            while cut > 0 and not text[cut - 1].isascii():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def spans(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of plain text, and the ids of special tokens between them."""
        at = 0
        if self.special_split is not None:
            for m in self.special_split.finditer(text):
                yield text[at : m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:] if at else text, None

    def stream(self, text: str, size: int = SLICE) -> Iterator[list[int]]:
        """The ids, slice by slice."""
        known, word_ids = self.known, self.word_ids
        for plain, special in self.spans(text):
            for part in self.slices(plain, size):
                ids: list[int] = []
                for w in self.words.findall(self.normalize(part)):
                    ids += known.get(w) or word_ids(w)
                yield ids
            if special is not None:
                yield [special]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]


class TextDecoder:
    """Ids in, text out, with the tokens of a vocabulary joined by ``joiner``.

    A file without a ``decoder`` entry has its tokens' own strings joined by one
    space; ``byte_level=True`` turns symbols back into bytes first.  Feed any split of
    the ids; ``finish`` flushes what is open.
    """

    def __init__(self, token: dict[int, str], to_byte: dict[str, int], byte_level: bool, joiner: str = ""):
        self.byte_level, self.joiner = byte_level, joiner
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.piece: dict[int, bytes] = {}
        for i, t in token.items():
            if byte_level and all(c in to_byte for c in t):
                self.piece[i] = bytes(to_byte[c] for c in t)
            else:
                self.piece[i] = t.encode()
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        piece = self.piece
        parts = [piece[i] for i in ids if i in piece]
        if not parts:
            return ""
        joiner = self.joiner.encode()
        raw = joiner.join(parts)
        if self.begun:
            raw = joiner + raw
        self.begun = True
        return self.machine.decode(raw)

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        self.begun = False
        return out


_LOADED: dict[str, tuple[StreamingBPE, TextDecoder]] = {}


def _load(path: str) -> tuple[StreamingBPE, TextDecoder]:
    if path not in _LOADED:
        bpe = StreamingBPE(path)
        with open(path, encoding="utf-8") as f:
            decoder = json.load(f).get("decoder")
        byte_level = bool(decoder) and decoder.get("type") == "ByteLevel"
        _LOADED[path] = bpe, TextDecoder(bpe.token, bpe.to_byte, byte_level, "" if byte_level else " ")
    return _LOADED[path]


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>`` and ``decoded string`` for each row of ``df``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe, decoder = _load(tokenizer)
        for whole in batches:
            for b in chunks(whole, "text"):
                ids, decoded = [], []
                for text in b.column("text").to_pylist():
                    held, said = array("i"), []
                    for one in bpe.stream(text or ""):
                        held.extend(one)
                        said.append(decoder.feed(one))
                    said.append(decoder.finish())
                    ids.append(pa.array(np.frombuffer(held, np.int32)))
                    decoded.append("".join(said))
                sizes = [0]
                for a in ids:
                    sizes.append(sizes[-1] + len(a))
                values = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    from pyspark.sql import functions as F

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded string")
