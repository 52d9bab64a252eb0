"""Language identification by word-first backoff.

A word known from training is scored by its log frequency in each language.  An
unseen word falls back to the longest of its character n-grams that are known: at
each order, from the longest down, the word's n-grams seen in training are averaged
and the order is discounted; the first order that knows any of them decides.  A word
unknown at every order says nothing.  A text's language has the largest sum of its
words' scores and the languages' log prior; the posterior of that sum is the score.

Training reads a bounded sample of labelled rows: ``max_docs`` of each language, those
with the smallest hash of id and text, which is a random draw whatever the table's
order.  All words of the sample are known words, and all n-grams of them known n-grams.
Words and n-grams are counted on the executors.

The posterior is that of the sums divided by the square root of the number of words, as
neighbouring words are not independent; a text's best language does not depend on it.

Cases: null text and text without a letter (as Unicode defines it: digits, fractions and
Roman numeral signs are none) is ``und`` with score 0; a null label
takes no part in training; a training table without labels gives ``und`` for all;
equal sums go to the alphabetically first language; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, keep_rows, written

#: Numbers that are no digits, which the standard classes count as word characters.
NUMBERS = frozenset(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Nl", "No"))
WORD = re.compile(r"[^\W\d_]+")
#: The same for lower-case texts of Latin letters, by the shortest way.
LATIN_WORD, OTHER = re.compile("[a-zªµºß-öø-ɏ]+"), re.compile("[^\x00-ɏ]")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    if not text:
        return []
    text = text.lower()
    if not OTHER.search(text):
        return LATIN_WORD.findall(text)
    if not NUMBERS.isdisjoint(text):
        text = "".join(" " if c in NUMBERS else c for c in text)
    return WORD.findall(text)


UNKNOWN = "und"
#: Words that a worker remembers the fallback scores of.
CACHE_WORDS = 300_000


def _grams(word: str, order: int) -> list[str]:
    padded = f" {word} " if order > 1 else word  # a word's border alone tells nothing
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class LanguageModel:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, langs: list[str], prior: list[float], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], orders: tuple[int, ...], discount: float = 0.5):
        """``words`` and ``grams`` come with their counts, a column per language."""
        self.langs, self.orders, self.discount = langs, orders, discount
        self.prior = np.array(prior)
        self.row = {w: i for i, w in enumerate(words[0])}
        self.table = self._logs(words[1])
        self.gram_row = {g: i for i, g in enumerate(grams[0])}
        self.gram_table = self._logs(grams[1])

    def _logs(self, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros((0, len(self.langs)), np.float32)
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
        return (logs - logs.max(axis=1, keepdims=True)).astype(np.float32)  # only differences between languages count

    def backoff(self, word: str) -> np.ndarray:
        """The score of an unseen word, from its longest known n-grams."""
        weight = self.discount
        for order in self.orders:
            rows = [r for r in map(self.gram_row.get, _grams(word, order)) if r is not None]
            if rows:
                return weight / len(rows) * self.gram_table.take(rows, axis=0).sum(axis=0)
            weight *= self.discount
        return np.zeros(len(self.langs))


class Scorer:
    """Applies a model; remembers the fallback scores of unseen words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.unseen: dict[str, np.ndarray] = {}

    def predict(self, text: str | None) -> tuple[str, float]:
        m = self.model
        words = words_of(text)
        if not words or not m.langs:
            return UNKNOWN, 0.0
        rows = list(map(m.row.get, words))
        known = [r for r in rows if r is not None]
        total = m.table.take(known, axis=0).sum(axis=0, dtype=np.float64) if known else np.zeros(len(m.langs))
        if len(known) < len(rows):
            for w, n in Counter(w for w, r in zip(words, rows, strict=True) if r is None).items():
                s = self.unseen.get(w)
                if s is None:
                    s = m.backoff(w[:200]) if len(w) <= 200 else sum(m.backoff(w[i : i + 200]) for i in range(0, len(w), 200))
                    if len(self.unseen) >= CACHE_WORDS:
                        self.unseen.clear()
                    self.unseen[w] = s
                total = total + n * s
        best = int(np.argmax(m.prior + total))
        level = (m.prior + total - m.prior[best] - total[best]) / math.sqrt(len(words))
        return m.langs[best], min(1.0, float(1.0 / np.exp(level).sum()))  # rounding may leave the best level below 0


def _table(parts: DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """``item, lang, n`` as a sorted list of items and their counts per language."""
    place = {x: i for i, x in enumerate(langs)}

    def pack(batches):
        items, at, n = [], [], []
        for b in batches:
            items += b.column("item").to_pylist()
            at += map(place.__getitem__, b.column("lang").to_pylist())
            n += b.column("n").to_pylist()
        if items:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(items)]), *(pa.array([np.array(x, "<i8").tobytes()], pa.binary()) for x in (at, n))], names=["items", "at", "n"])

    # one row per partition; the sample bounds them all
    got = parts.mapInArrow(pack, "items string, at binary, n binary").collect()
    items = [x for r in got for x in r["items"].split("\n")]
    if not items:
        return [], np.zeros((0, len(langs)))
    names = sorted(set(items))
    spot = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), len(langs)))
    counts[[spot[x] for x in items], np.concatenate([np.frombuffer(r["at"], "<i8") for r in got])] = np.concatenate([np.frombuffer(r["n"], "<i8") for r in got])
    return names, counts


def train(df: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", max_docs: int = 1500, orders: tuple[int, ...] = (4, 3, 2, 1)) -> LanguageModel:
    """Fit on at most ``max_docs`` labelled rows of each language in ``df``."""
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs, n = sorted(share), sum(share.values())
    if not langs:
        return LanguageModel([], [], ([], np.zeros((0, 0))), ([], np.zeros((0, 0))), orders)
    # draws below a bound that somewhat more than max_docs rows keep, then exactly the first
    bound = F.create_map(*(F.lit(x) for k in langs for x in (k, float(min(1.0, (1.2 * max_docs + 50) / share[k])))))
    near = rows.where((F.col("draw") / 2.0**64 + 0.5) <= bound[F.col("lang")])
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("place") <= max_docs)

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)

        def flush():
            lang = [name for name, c in words.items() for _ in c]
            out = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([w for c in words.values() for w in c], pa.string()), pa.array([k for c in words.values() for k in c.values()], pa.int64())], names=["lang", "item", "n"])
            words.clear()
            return out

        for whole in batches:
            for b in chunks(whole, "text"):
                for name, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    words[name].update(words_of(text))
                if sum(map(len, words.values())) > 400_000:
                    yield flush()
        yield flush()

    def cut(batches):
        for b in batches:
            grams: dict[str, Counter] = defaultdict(Counter)
            for name, word in zip(b.column("lang").to_pylist(), b.column("item").to_pylist(), strict=True):
                for order in orders:  # n-grams are of word types: unseen words are new types
                    grams[name].update(_grams(word[:200], order))
            lang = [name for name, c in grams.items() for _ in c]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([g for c in grams.values() for g in c], pa.string()), pa.array([k for c in grams.values() for k in c.values()], pa.int64())], names=["lang", "item", "n"])

    shape = "lang string, item string, n long"
    words = written(near.select("lang", "text").mapInArrow(count, shape).groupBy("item", "lang").agg(F.sum("n").alias("n")), "language-words")
    grams = words.select("lang", "item").mapInArrow(cut, shape).groupBy("item", "lang").agg(F.sum("n").alias("n"))
    return LanguageModel(langs, [math.log(share[x] / n) for x in langs], _table(words, langs), _table(grams, langs), orders)


def predictor(model_ref):
    """A function from texts to (language, score), with one scorer per worker."""
    held: list[Scorer] = []

    def run(texts: list[str | None]) -> list[tuple[str, float]]:
        if not held:
            held.append(Scorer(model_ref.value))
        return [held[0].predict(t) for t in texts]

    return run


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for each row."""
    ref = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        apply = predictor(ref)
        for whole in batches:
            for b in chunks(whole, "text"):
                out = apply(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=[id_col, "lang_pred", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is identified with a score of ``least`` or more, with
    all their columns; null texts and texts without a letter go."""
    apply = predictor(df.sparkSession.sparkContext.broadcast(model))

    def identified(text: str | None) -> bool:
        lang, score = apply([text])[0]
        return lang != UNKNOWN and score >= least

    return keep_rows(df, text_col, identified)
