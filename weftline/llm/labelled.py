"""The bounded sample of labelled texts that the classifiers learn from."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ALNUM_WORD, LOWER, cut, mix, slices, text_bytes, word_hashes


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least hash of each text's word 5-grams (of its words, if fewer): copies and near copies mostly share it."""
    for batch in slices(batches, "text"):
        raw, offsets = text_bytes(batch.column("text"))
        words, at = word_hashes(LOWER[raw], offsets, ALNUM_WORD)
        grams = words.copy()
        for i in range(1, 5):
            grams[:len(words) - i] = mix(grams[:len(words) - i]) + words[i:]
        keys = [int(grams[a:max(b - 4, a + 1)].min().view(np.int64)) if b > a else 0 for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (text, label) of at most `most` labelled documents, one of each group of near copies.

    Of the labels with a usable id those with the least hash of the id are taken, so
    the sample does not depend on partitions and its labels fit a broadcast.  Null
    labels and null texts do not count; of several labels of an id the largest does.
    """
    own = labels.where(usable & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.col(label).cast("int")).alias("label"))
    own = own.orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(own), F.col("id") == F.col("labelled")).select("text", "label")
    keyed = rows.mapInArrow(_keyed, "text string, label int, key bigint")
    return cut(keyed.groupBy("key").agg(F.min(F.struct("text", "label")).alias("one")).select("one.*"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve from x to the chance of y = 1, by damped Newton steps; slope is never negative."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    # Targets drawn in a little, as with few cases a perfect split would otherwise give an infinite slope.
    ones, zeros = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.array([0.0, float(np.log((ones + 1) / (zeros + 1)))])

    def loss(w):
        m = z @ w
        return float(np.sum(np.logaddexp(0, m) - t * m) + ridge * w @ w)

    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        grad = z.T @ (p - t) + 2 * ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 2 * ridge * np.eye(2)
        step, now, size = np.linalg.solve(hess, grad), loss(w), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        if np.abs(size * step).max() < 1e-9:
            break
        w = w - size * step
    return max(float(w[0]) / scale, 0.0), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
