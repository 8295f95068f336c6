"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words (ASCII white space and punctuation
separate them, A-Z lower-cased), of pairs of adjacent words and of pairs with one word between
them.  Labels and any column but the text are never features.

Training reads at most ``max_rows`` labelled rows, drawn by a seeded hash (the one bound here,
a parameter).  Their ids are a broadcast of that size, so texts are not shuffled to find
them, and texts become feature slots where they lie.  The drawn rows are dealt to ``parts`` tasks;
each runs FTRL with per-coordinate rates and L1 sparsity, and the parts' weights are averaged per
coordinate.  The weights other than zero are few (a thousand or so), so they are broadcast, and
every text is scored whole where it lies: scoring shuffles nothing.

Edge cases: labels that are null or without a document are left out, repeated labels count as
toxic if any of them is; null and empty texts get the score of the bias alone; without any usable
label every score is below 1e-15; an empty table gives an empty result; other columns stay as
they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_of, text_of
from .mixing import seeded

BITS = 20


@dataclass(frozen=True)
class Rates:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    epochs: int = 6
    toxic_weight: float = 3.0


def feature_slots(column) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of all features of a large_string column, repeats included."""
    from .words import PUNCTUATION, U, combine, word_hashes

    words, at = word_hashes(column, PUNCTUATION)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = [(text, words)]
    for gap in (1, 2):
        same = text[gap:] == text[:-gap]
        pairs = combine(np.full(len(same), gap, U), words[:-gap], words[gap:])
        found.append((text[gap:][same], pairs[same]))
    slots = np.concatenate([h for _, h in found]) >> U(64 - BITS)
    return np.concatenate([t for t, _ in found]), slots.astype(np.int64)


def feature_rows(column) -> list[np.ndarray]:
    """The distinct slots of each text."""
    from .words import column_chunks

    out = []
    for _, chunk in column_chunks(column):
        text, slots = feature_slots(chunk)
        key = np.unique(text << BITS | slots)
        cut = np.searchsorted(key >> BITS, np.arange(len(chunk) + 1))
        slots = (key & ((1 << BITS) - 1)).astype(np.int32)
        out += [slots[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return out


def ftrl(rows: list[np.ndarray], labels: list[int], rates: Rates, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) other than 0; the bias is the slot after the last hash."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * rates.l1) / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2)
        return np.where(np.abs(z[i]) <= rates.l1, 0.0, w)

    draw = np.random.default_rng(seed)
    for _ in range(rates.epochs):
        for k in draw.permutation(len(rows)):
            i = np.concatenate((rows[k], bias))
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[k]) * (rates.toxic_weight if labels[k] else 1.0)
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rates.alpha
            z[i] += g - step * w
            n[i] += g * g
    slots = np.flatnonzero(n)
    w = weights(slots)
    return slots[w != 0], w[w != 0]


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        """Of a large_string column without nulls, from its distinct features."""
        from .words import column_chunks

        table = np.zeros(1 << BITS)
        table[self.slots] = self.weights
        hit = table != 0
        out = np.zeros(len(column))
        for at, chunk in column_chunks(column):
            text, slots = feature_slots(chunk)
            found = hit[slots]
            key = np.unique(text[found] << BITS | slots[found])
            out[at: at + len(chunk)] = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], len(chunk))
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -35, 35)))


def draw_labels(labels: DataFrame, max_rows: int, seed: int, id_col: str, label_col: str) -> DataFrame:
    """(id, label, draw) of fewer than ``max_rows`` labelled ids."""
    one = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    one = one.withColumn("draw", seeded(seed, "id"))
    n = one.count()
    # six standard deviations below the bound, so that the draw stays under it
    wanted = max(1.0, max_rows - 6 * max_rows ** 0.5)
    return one if n <= wanted else one.where(F.col("draw") < F.lit(int(wanted / n * 2**60)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, rates: Rates = Rates(), parts: int = 1,
                 seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    drawn = draw_labels(labels, max_rows, seed, id_col, label_col)
    rows = (docs.select(id_of(id_col).alias("id"), text_of(text_col).alias("text"))
            .join(F.broadcast(drawn), "id")  # under max_rows rows of three numbers
            .select((F.col("draw") % parts).cast("int").alias("part"), "draw", "label", "text"))

    def slots(batches):
        import pyarrow as pa
        for b in batches:
            texts = b.column(3).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in feature_rows(texts)], pa.binary())],
                names=["part", "draw", "label", "slots"])

    def fit(rows):
        import pandas as pd
        rows = rows.sort_values(["draw", "slots"], kind="stable")
        slot, weight = ftrl([np.frombuffer(b, np.int32) for b in rows.slots], rows.label.tolist(), rates, seed)
        return pd.DataFrame({"slot": slot.astype("int32"), "weight": weight / parts})

    # ids may repeat: rows of equal features count once, and the bound holds for rows, not ids
    bounded = rows.mapInArrow(slots, "part int, draw long, label int, slots binary").distinct()
    bounded = bounded.orderBy(F.xxhash64("draw", "slots"), "draw", "slots").limit(max_rows)
    weights = (bounded.groupBy("part").applyInPandas(fit, "slot int, weight double")
               .groupBy("slot").agg(F.sum("weight").alias("weight")).orderBy("slot").toPandas())
    if not len(weights):
        return Model(np.zeros(0, np.int64), np.zeros(0), -35.0)
    slot, weight = weights.slot.to_numpy(np.int64), weights.weight.to_numpy()
    own = slot < 1 << BITS
    return Model(slot[own], weight[own], float(weight[~own].sum()))


def toxicity_score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column for ``docs``: the model's probability that the text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text):
        import pyarrow as pa
        return pa.array(sent.value.scores(text.cast(pa.large_string())))

    return score(text_of(text_col))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The rows kept out of training: crc32 of the id as text, modulo the folds, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
