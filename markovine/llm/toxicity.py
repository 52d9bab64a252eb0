"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words and their first ``PREFIX`` letters (which
hold what inflected and compound insults share), hashed into ``2 ** bits`` slots.  The score
is the logistic of ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``, the pair sum computed as
half of the squared sum less the sum of squares, so that pairs such as an insult with
a mention of a group get a weight that a linear model cannot give them.

Training takes a bounded sample (``max_per_class`` labelled ids of each class, those
with the smallest hash; of rows that repeat an id one) and the terms that ``min_docs``
of its rows hold, as a rarer one only learns its rows by heart; examples are weighted back to the classes' true shares, so that the score is a
probability.  Optimisation is Adagrad on shuffled mini-batches with a fixed seed.
Long texts hold most common words, which carry no signal: a term's starting weight is
half of its smoothed log odds if they are beyond the noise and 0 otherwise.  Every term
takes part in training, as terms that are neutral alone may mean something together.

Cases: null and empty text gets the score of the bias alone; a null label takes no
part in training; if the training rows have one class or none the score is that
class's share (0 without rows); repeated labels of an id count once, toxic if any is;
repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, keep_rows

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a longer word that are a term of their own.
PREFIX = 5


def terms(text: str | None) -> set[str]:
    """The terms of a text."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


def slots(text: str | None, bits: int) -> np.ndarray:
    """The sorted distinct slots of a text's words."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    mask = (1 << bits) - 1
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(w) & mask for w in terms(text)), dtype=np.int32))


class FactorizationMachine:
    """Weights over the slots that training kept (``index`` is sorted)."""

    def __init__(self, bits: int, index: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bits, self.index, self.bias, self.linear, self.factors = bits, index, bias, linear, factors
        self.place = {s: i for i, s in enumerate(index.tolist())}
        self.word: dict[str, int] = {}

    def rows(self, text: str | None) -> list[int]:
        """Places of a text's kept slots."""
        if not text:
            return []
        mask, digest, place, word = (1 << self.bits) - 1, xxhash.xxh32_intdigest, self.place, self.word
        out = set()
        for w in terms(text):
            p = word.get(w)
            if p is None:
                p = place.get(digest(w) & mask, -1)
                if len(word) < 300_000:
                    word[w] = p
            if p >= 0:
                out.add(p)
        return sorted(out)

    def margin(self, rows: list[int]) -> float:
        if not rows:
            return self.bias
        v = self.factors[rows]
        total = v.sum(axis=0)
        return self.bias + float(self.linear[rows].sum()) + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(self.rows(text)), -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = 20, rank: int = 6, min_docs: int = 5, epochs: int = 20, rate: float = 0.05, decay: float = 2e-4, least_z: float = 3.6, seed: int = 7) -> FactorizationMachine:
    """Fit on sparse binary rows."""
    prior = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.0
    limit = np.log(max(prior, 1e-12) / max(1 - prior, 1e-12))
    none = FactorizationMachine(bits, np.zeros(0, dtype=np.int64), float(np.clip(limit, -20, 20)), np.zeros(0), np.zeros((0, rank)))
    if not 0 < prior < 1:
        return none
    items = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    used, place, docs = np.unique(items, return_inverse=True, return_counts=True)
    place = place.astype(np.int32)
    pos = np.bincount(place[labels[owner] > 0], minlength=len(used))
    neg = docs - pos
    n_pos, n_neg = labels.sum(), len(labels) - labels.sum()
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    noise = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    start = np.where(np.abs(odds) >= least_z * noise, 0.5 * odds, 0.0)
    kept = docs >= min_docs
    if not kept.any():
        return none
    renumber = np.cumsum(kept) - 1
    stay = kept[place]
    place, owner, used, start = renumber[place[stay]], owner[stay], used[kept], start[kept]
    size = len(used)
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    w0, w, v = float(limit), start, rng.normal(0, 0.01, (size, rank))
    g0, gw, gv = 1e-2, np.full(size, 1e-2), np.full((size, rank), 1e-2)
    scaled = weights / weights.mean()
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            sizes = starts[batch + 1] - starts[batch]
            own = np.repeat(np.arange(len(batch)), sizes)
            idx = place[np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))]
            vi = v[idx]
            total = np.stack([np.bincount(own, weights=vi[:, r], minlength=len(batch)) for r in range(rank)], axis=1)
            square = np.bincount(own, weights=(vi * vi).sum(axis=1), minlength=len(batch))
            z = w0 + np.bincount(own, weights=w[idx], minlength=len(batch)) + 0.5 * ((total * total).sum(axis=1) - square)
            err = scaled[batch] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) / len(batch)
            d0 = float(err.sum())
            # only the batch's terms move
            held, spot = np.unique(idx, return_inverse=True)
            dw = np.bincount(spot, weights=err[own], minlength=len(held)) + decay * w[held] / 10
            pull = err[own][:, None] * (total[own] - vi)
            dv = np.stack([np.bincount(spot, weights=pull[:, r], minlength=len(held)) for r in range(rank)], axis=1) + decay * v[held]
            g0 += d0 * d0
            gw[held] += dw * dw
            gv[held] += dv * dv
            w0 -= rate * d0 / g0**0.5
            w[held] -= rate * dw / np.sqrt(gw[held])
            v[held] -= rate * dv / np.sqrt(gv[held])
    return FactorizationMachine(bits, used, float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = 3000, bits: int = 20) -> FactorizationMachine:
    """Fit on at most ``max_per_class`` labelled rows of each class."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = marked.withColumn("y", (F.col("y") > 0).cast("int"))
    totals = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y in (0, 1):
        picked.append(marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class))
    sample = picked[0].union(picked[1])
    kind = docs.schema[id_col].dataType.simpleString()

    def featurize(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                rows = [slots(t, bits).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(rows, pa.binary())], names=["id", "y", "row"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("id", "y", "text").mapInArrow(featurize, f"id {kind}, y int, row binary")
    one = rows.groupBy("id").agg(F.min(F.struct("row", "y")).alias("z")).select("z.row", "z.y")
    # at most 2 * max_per_class short rows, in an order that does not depend on the tasks
    got = sorted(((bytes(r["row"]), r["y"]) for r in one.collect()), key=lambda r: (zlib.crc32(r[0]), r))
    y = np.array([k for _, k in got], dtype=np.float64)
    found = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weights = np.array([totals.get(int(k), 0) / found[int(k)] for k in y], dtype=np.float64)
    return fit([np.frombuffer(r, dtype=np.int32) for r, _ in got], y, weights, bits)


def predict(df: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` for each row."""
    ref = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        model = ref.value
        for whole in batches:
            for b in chunks(whole, "text"):
                out = [model.score(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.float64())], names=[id_col, "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_clean(df: DataFrame, model: FactorizationMachine, text_col: str = "text", below: float = 0.3) -> DataFrame:
    """The rows of ``df`` that score less than ``below``, with all their columns; a null or
    empty text has the score of the bias."""
    ref = df.sparkSession.sparkContext.broadcast(model)
    return keep_rows(df, text_col, lambda t: ref.value.score(t) < below)
