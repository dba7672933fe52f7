"""Quality classifier: naive Bayes support vectors.

Indicators of word and punctuation n-grams are scaled by the log-count ratio of the
classes, and a linear hinge-loss model is fitted to them by dual coordinate
descent.  The decision value is turned into a chance by a logistic curve.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ALNUM_WORD, LOWER, SPACE_WORD, mix, slices, text_bytes, word_hashes
from weftline.llm.labelled import labelled_sample, logistic, sigmoid

#: Labelled documents to learn from, at most, and the number of indicators (n-grams are hashed onto them).
MOST_LABELLED, INDICATORS = 6_000, 1 << 18
#: Smoothing of the counts, weight of the hinge loss, passes over the sample, share of the mean weight in the blend.
SMOOTHING, COST, PASSES, BLEND = 1.0, 1.0, 12, 0.25

PUNCTUATION = SPACE_WORD & ~ALNUM_WORD


def indicators(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    """The distinct indicators of each row: single words and punctuation runs, pairs of each, and whether a word stands twice in a row."""
    raw, offsets = text_bytes(batch.column(text))
    parts = []
    for tag, (raw_bytes, table) in enumerate(((LOWER[raw], ALNUM_WORD), (raw, PUNCTUATION))):
        h, at = word_hashes(raw_bytes, offsets, table)
        h = mix(h + np.uint64(tag))
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
        if tag == 0 and len(pair):
            pair = np.where(h[:-1] == h[1:], np.uint64(7), pair)
        one, two = (h % np.uint64(INDICATORS)).astype(np.int32), (pair % np.uint64(INDICATORS)).astype(np.int32)
        parts.append((one, two, at))
    out = []
    for i in range(len(offsets) - 1):
        own = [x[at[i]:max(at[i + 1] - shift, at[i])] for one, two, at in parts for x, shift in ((one, 0), (two, 1))]
        out.append(np.unique(np.concatenate(own)))
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(max(len(r), 1)) + self.bias for r in rows])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(rows) + self.offset)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights of min 1/2 |w|^2 + COST sum hinge(y w x), x the unit-length indicators times `scale`, and a bias as one more indicator.

    One dual variable a row, from 0 to COST; each step moves one to its best value
    with the others fixed and w along with it.  The rarer class counts more, so that
    both classes weigh alike.
    """
    w, bias = np.zeros(INDICATORS), 0.0
    unit = [1 / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([(scale[r] ** 2).sum() * u * u + 1 for r, u in zip(rows, unit)])
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    top, alpha = COST * share, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = scale[r] * unit[i]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit_quality(sample: DataFrame) -> Model:
    """A model from rows (text, label) of a bounded sample; every fifth row is kept back to fit the logistic curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in indicators(batch, "text")], pa.binary())], names=["label", "row"])

    got = sorted((r["label"], bytes(r["row"])) for r in sample.mapInArrow(run, "label int, row binary").collect())
    rows = [np.frombuffer(r, np.int32) for _, r in got]
    y = np.array([1.0 if label else -1.0 for label, _ in got])
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model(np.zeros(INDICATORS), 0.0, 0.0, float(np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))))
    back = np.arange(len(rows)) % 5 == 4
    fit = [i for i in range(len(rows)) if not back[i]]
    good, bad = np.full(INDICATORS, SMOOTHING), np.full(INDICATORS, SMOOTHING)
    for i in fit:
        (good if y[i] > 0 else bad)[rows[i]] += 1
    scale = np.log(good / good.sum()) - np.log(bad / bad.sum())
    w, bias = dual_descent([rows[i] for i in fit], y[fit], scale)
    w = (1 - BLEND) * w + BLEND * np.abs(w).mean()
    model = Model(w * scale, bias, 1.0, 0.0)
    kept = np.flatnonzero(back)
    model.slope, model.offset = logistic(model.margins([rows[i] for i in kept]), (y[kept] > 0).astype(int))
    return model


def train_quality(docs: DataFrame, labels: DataFrame, usable) -> Model:
    """Fit on at most MOST_LABELLED labelled documents whose id is usable."""
    return fit_quality(labelled_sample(docs, labels, "quality", usable, MOST_LABELLED))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score), one for each row of `docs`; score is the chance of good quality, from 0 to 1.

    The score reads the text alone.  A null or empty text has no indicators and gets
    the score of the bias alone.  Repeated rows come out as often as they go in.
    Other columns are ignored.  An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.score(indicators(batch, "text")))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
