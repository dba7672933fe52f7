"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes is counted on a bounded
sample.  A byte is coded in the longest context that the tree holds; one not seen
there costs an escape and is looked for one order lower, below the last one at a
uniform cost.  The counts stay as they are, so the cost of a byte depends on the
ORDER bytes before it alone, and a text's code length is the sum over its distinct
(ORDER + 1)-grams.  The language with the shortest code wins.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, slices, text_bytes

#: Bytes of the longest context.
ORDER = 4
#: Documents, and bytes of text, that a language's tree is counted on, at most (the first of each text's bytes while learning).
MOST_DOCS, MOST_BYTES = 1_500, 3_000_000
#: Costs of grams in languages that are held at one time.
COSTS_HELD = 1 << 22
#: Bits for which a code difference counts as one unit of log-odds.
SOFTNESS = 8.0
#: Letters, and some numerals that Python counts as word characters.
WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of a letter category (numerals such as \u00bd or \u2160 are none)."""
    return bool(text) and any(m[0].isalpha() for m in WORD_CHARACTER.finditer(text))


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes before it in its text (zero before the start) and itself, in one number."""
    raw = LOWER[raw].astype(np.uint64)
    out = raw.copy()
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        back = np.zeros(len(raw), np.uint64)
        back[k:] = raw[:-k] if k < len(raw) else raw[:0]
        back[place < k] = 0
        out |= back << np.uint64(8 * k)
    return out


class _Sparse:
    """For sorted keys the languages that have them, with a number each; one language after another goes in."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        own = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.keys, at = np.unique(own, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.who = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])[order]
        self.value = np.concatenate([v for _, v in parts]).astype(np.float32)[order] if parts else np.zeros(0, np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.keys)))])
        self.languages = len(parts)

    def dense(self, wanted: np.ndarray) -> np.ndarray:
        """One row for each wanted key, one column for each language, zero without a number."""
        out = np.zeros((len(wanted), self.languages), np.float32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        n = (self.starts[at + 1] - self.starts[at]) * (self.keys[at] == wanted)
        row = np.repeat(np.arange(len(wanted)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.starts[at][row]
        out[row, self.who[place]] = self.value[place]
        return out


class Model:
    """Per order the grams with their counts, and the contexts with how many bytes and kinds of bytes follow, of each language."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.levels = []
        for k in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            seen, total, kinds = [], [], []
            for g, n in counts:
                own, back = np.unique(g & mask, return_inverse=True)
                times = np.bincount(back, n, len(own))
                contexts, at = np.unique(own >> np.uint64(8), return_inverse=True)
                seen.append((own, times))
                total.append((contexts, np.bincount(at, times, len(contexts))))
                kinds.append((contexts, np.bincount(at, minlength=len(contexts))))
            self.levels.append((_Sparse(seen), _Sparse(total), _Sparse(kinds)))

    def costs(self, wanted: np.ndarray) -> np.ndarray:
        """Bits that each language needs for the last byte of each gram."""
        bits = np.zeros((len(wanted), len(self.languages)))
        open_ = np.ones(bits.shape, bool)
        for k in range(ORDER, -1, -1):
            seen, total, kinds = self.levels[k]
            if not len(seen.keys):
                continue
            gram = wanted & np.uint64((1 << (8 * (k + 1))) - 1)
            n, d, c = total.dense(gram >> np.uint64(8)), kinds.dense(gram >> np.uint64(8)), seen.dense(gram)
            here = open_ & (n > 0)
            with np.errstate(divide="ignore"):
                code = np.log2(n + d) - np.log2(np.where(c > 0, c, np.maximum(d, 1)))
            bits += np.where(here, code, 0)
            open_ &= ~(here & (c > 0))
        return bits + 8.0 * open_

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text in each language."""
        texts = len(offsets) - 1
        out = np.zeros((texts, len(self.languages)))
        if not len(raw):
            return out
        text = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(offsets))
        keyed = np.sort(grams(raw, offsets) | text << np.uint64(8 * (ORDER + 1)))
        new = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]]))
        times = np.diff(np.concatenate([new, [len(keyed)]]))
        keyed = keyed[new]
        owner = (keyed >> np.uint64(8 * (ORDER + 1))).astype(np.int64)
        distinct, back = np.unique(keyed & np.uint64((1 << (8 * (ORDER + 1))) - 1), return_inverse=True)
        # So many grams at a time that their costs in all languages fit into memory.
        step = max(1, COSTS_HELD // max(1, len(self.languages)))
        order = np.argsort(back, kind="stable") if len(distinct) > step else np.arange(len(back))
        ends = np.searchsorted(back[order], np.arange(0, len(distinct) + step, step)) if len(distinct) > step else np.array([0, len(back)])
        for i in range(0, len(distinct), step):
            bits = self.costs(distinct[i:i + step])
            part = order[ends[i // step]:ends[i // step + 1]]
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(owner[part], bits[back[part] - i, j] * times[part], texts)
        return out


def train_language(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the trees on at most MOST_DOCS documents and about MOST_BYTES bytes of every language.

    Of each language the first documents by a hash of id and text are taken until one
    of the two bounds is reached, one at least, and MOST_BYTES characters of a text;
    equal rows are taken together.  Null languages and null texts do not count.
    """
    spark = docs.sparkSession
    lang = F.col(lang_col).cast("string")
    known = docs.where(usable & lang.isNotNull() & F.col(text_col).isNotNull())
    known = known.select(lang.alias("lang"), F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1).alias("drawn"), F.col(text_col).cast("string").alias("text"))
    found = sorted(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("drawn").alias("least")).collect(), key=lambda r: r["lang"])
    if not found:
        return Model([], [])

    def up_to(lasts: list[int]) -> DataFrame:
        table = spark.createDataFrame([(r["lang"], j, x) for j, (r, x) in enumerate(zip(found, lasts))], "lang string, language int, last bigint")
        return known.join(F.broadcast(table), "lang").where("drawn <= last")

    # Twice as many documents as are wanted hold the first MOST_DOCS; their sizes say where a language's bounds are.
    most = (1 << 63) - 1
    some = up_to([max(r["least"], min(most, most * 2 * MOST_DOCS // r["n"])) for r in found])
    sizes = some.select("language", "drawn", F.least(F.octet_length("text"), F.lit(MOST_BYTES)).alias("size")).toPandas().sort_values(["language", "drawn"])
    lasts = []
    for _, own in sizes.groupby("language"):
        before = own["size"].to_numpy(np.int64).cumsum() - own["size"].to_numpy(np.int64)
        lasts.append(int(own["drawn"].to_numpy()[:MOST_DOCS][before[:MOST_DOCS] < MOST_BYTES][-1]))
    rows = up_to(lasts).select("language", F.substring("text", 1, MOST_BYTES).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = np.array(batch.column("language"))
            for name in np.unique(own):
                raw, offsets = text_bytes(batch.column("text").take(pa.array(np.flatnonzero(own == name))))
                gram, times = np.unique(grams(raw, offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), name), pa.int32()), pa.array(gram.view(np.int64)), pa.array(times)], names=["language", "gram", "n"])

    counted = rows.mapInArrow(run, "language int, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most MOST_BYTES grams of each language
    got = got.sort_values(["language", "gram"])
    ends = np.searchsorted(got["language"].to_numpy(), np.arange(len(found) + 1))
    gram, n = got["gram"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(float)
    return Model([r["lang"] for r in found], [(gram[a:b], n[a:b]) for a, b in zip(ends, ends[1:])])


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, lang_pred, score, bits), one for each row of `docs`.

    bits is the code length in the predicted language; score, from 0 to 1, is its
    share among all languages when a difference of SOFTNESS bits is one unit of
    log-odds.  A text that is null or has no letter is "und" with score 0, and so is
    every text when the model has no language.  Equal code lengths go to the first
    language by name.  The prediction reads the text alone.  Repeated rows come out
    as often as they go in; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text"):
            letter = np.array([has_letter(t) for t in batch.column("text").to_pylist()])
            if own.languages:
                bits = own.lengths(*text_bytes(batch.column("text")))
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                score = 1 / np.exp(np.maximum((least[:, None] - bits) / SOFTNESS, -500)).sum(axis=1)
                names = [own.languages[b] if ok else "und" for b, ok in zip(best, letter)]
            else:
                least, score, names = np.zeros(len(letter)), np.zeros(len(letter)), ["und"] * len(letter)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(least)], names=["id", "lang_pred", "score", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)
