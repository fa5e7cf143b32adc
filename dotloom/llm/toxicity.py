"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word between, hashed to
``2 ** bits`` slots. Training is online, one document at a time in a fixed order, with a learning
rate for each coordinate and L1, so that few weights are not zero; those few, as (slot, weight)
arrays bounded by the slots, go to all executors. Scoring reads every whole text once.

The model is fitted on a bounded sample: of the labelled ids allowed for training, the
``max_train_rows`` with the smallest hash, one text each (of several the one with the smallest digest), and of
a text's distinct features the ``max_row_slots`` with the smallest hash. Scores take whole texts, and never use
labels, lang, source or id.

Defined results: null is the empty text, whose score is the intercept's; a document without a label
is scored like any other; a document with labels that disagree counts as toxic; repeated rows get a
row each; labels without both classes give a constant score, their mean (0 without labels).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, text_of, tidy, views, word_names, words_in

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PAIR = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def gram_slots(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, word pair and skip pair of the rows; repeats included."""
    data = LOWER[data]
    start, end, row = words_in(data, offs, _LETTERS)
    word = word_names(data, start, end)
    rows, grams = [row], [word]
    with np.errstate(over="ignore"):
        for step, salt in ((1, _PAIR[0]), (2, _PAIR[1])):
            if len(word) > step:
                same = row[:-step] == row[step:]
                grams.append(mix(word[:-step] * salt + word[step:] * _PAIR[2])[same])
                rows.append(row[step:][same])
    return np.concatenate(rows), (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    bits: int
    intercept: float
    slots: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.weights
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
        row, slot = gram_slots(data, offs, self.bits)
        live = table[slot] != 0
        pairs = np.unique(row[live] << self.bits | slot[live])
        total = np.bincount(pairs >> self.bits, table[pairs & ((1 << self.bits) - 1)], minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30)))


def fit_ftrl(examples: list[tuple[int, np.ndarray]], bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, passes: int = 4, least_rows: int = 3) -> Model:
    """FTRL-proximal over (label, distinct slots) in the given order; slots in fewer than ``least_rows`` rows are left out."""
    positive = sum(y for y, _ in examples)
    if not 0 < positive < len(examples):
        mean = positive / len(examples) if examples else 0.0
        return Model(bits, math.log(max(mean, 1e-9) / max(1 - mean, 1e-9)), np.zeros(0, np.int64), np.zeros(0, np.float32))
    rows = np.zeros(1 << bits, np.int32)
    for _, slots in examples:
        rows[slots] += 1
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    kept = [(y, slots[rows[slots] >= least_rows]) for y, slots in examples]

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def bias():
        return -bias_z / ((beta + math.sqrt(bias_n)) / alpha)

    for _ in range(passes):
        for y, slots in kept:
            zs, ns = z[slots], n[slots]
            w, b = weights(zs, ns), bias()
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(w.sum()) + b))))
            g = p - y
            if not g:
                continue
            more = ns + g * g
            z[slots] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[slots] = more
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w = weights(z, n)
    slots = np.flatnonzero(w)
    return Model(bits, bias(), slots, w[slots].astype(np.float32))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _features(bits: int, most: int):
    def run(batches):
        for batch in batches:
            for first, offs, data in views(text_of(batch.column("text"))):
                row, slot = gram_slots(data, offs, bits)
                pairs = np.unique(row << bits | slot)
                cuts = np.searchsorted(pairs >> bits, np.arange(len(offs)))
                slots = (pairs & ((1 << bits) - 1)).astype(np.int32)
                packed = [slots[a : min(b, a + most)].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                part = batch.slice(first, len(offs) - 1)
                yield pa.record_batch([part.column("order"), part.column("id"), part.column("label"), pa.array(packed, pa.binary())], ["order", "id", "label", "slots"])

    return run


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_train_rows: int = 8_000, bits: int = 20, max_row_slots: int = 16_384, **ftrl) -> Model:
    """Fit on the sample described above; its features, not its texts, come to the driver."""
    allowed = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    allowed = allowed.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    order = F.xxhash64("__id")
    sample = allowed.withColumn("__order", order).orderBy("__order", "__id").limit(max_train_rows)
    known = docs.select(F.col(id_col).cast("long").alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    both = known.join(F.broadcast(sample), known["__doc"] == sample["__id"])  # at most max_train_rows small rows
    # Tasks combine the texts of an id that repeats, so no task holds all of them.
    one = both.groupBy(F.col("__id").alias("id")).agg(F.min("__order").alias("order"), F.min("__label").alias("label"), F.min_by("__text", F.md5("__text")).alias("text"))
    got = one.select("order", "id", "label", "text").mapInArrow(tidy(_features(bits, max_row_slots)), "order long, id long, label int, slots binary").collect()
    examples = [(int(r.label != 0), np.frombuffer(r.slots, np.int32)) for r in sorted(got, key=lambda r: (r.order, r.id))]
    return fit_ftrl(examples, bits, **ftrl)


def _score(model):
    def run(batches):
        fitted = model.value
        table = fitted.table()
        for batch in batches:
            parts = [fitted.scores(data, offs, table) for _, offs, data in views(text_of(batch.column("text")))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = pair.mapInArrow(tidy(_score(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3, **train_options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; null ids are scored too."""
    model = train(docs, labels, text_col, id_col, **train_options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        fitted = shared.value
        table = fitted.table()
        for batch in batches:
            parts = [fitted.scores(data, offs, table) for _, offs, data in views(text_of(batch.column(text_col)))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(tidy(run), schema)
