"""Toxic passages as maximal scoring segments of token log-odds.

A token scores its log-odds between toxic and clean documents under a Dirichlet
prior; words too rare to judge are scored through their first letters.  All
maximal scoring segments of a text are found in one scan.  By extreme-value theory
the best segments of chance text of n tokens exceed s with an expected number of
K n exp(-lambda s), so each text's segments turn into one p-value, and that into
the chance of being toxic.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER_TABLE, slices, tidy
from weftline.llm.labelled import fold, labelled_sample, logistic, sigmoid

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Labelled documents and tokens that the model is made of, at most.
MOST_LABELLED, MOST_TOKENS = 20_000, 50_000
#: Letters of the word beginnings that stand for rare words.
STEMS = (4, 5, 6, 8)
#: Pseudo-counts of the prior: one part for every token alike, one in proportion to its frequency.
FLAT_PRIOR, SHARED_PRIOR = 0.5, 100.0
#: What a token's log-odds must reach, in standard deviations and as such, and its largest score.
LEAST_Z, LEAST_SCORE, MOST_SCORE = 3.3, 1.5, 6.0
#: Score of every other token.
GAP = -0.2
#: Segments below this are chance.
LEAST_SEGMENT = 1.0
#: Beyond this evidence the calibration curve stays level.
MOST_EVIDENCE = 25.0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER_TABLE)) if text else []


def names_of(word: str) -> list[str]:
    """A word, and the beginnings that it shares with others, marked by a bar."""
    return [word, *(word[:k] + "|" for k in STEMS if len(word) >= k)]


def segments(places: list[int], scores: list[float], gap: float = GAP) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place), after Ruzzo and Tompa.

    Given are the places of the tokens with a positive score; every token between
    them scores `gap`.  Each candidate keeps the running total before and after it
    and the nearest earlier candidate that starts lower; a new one is joined to that
    candidate if it ends lower too.  Once no candidate starts lower all earlier ones are
    final.  Candidates that a search has passed over are never met again, so the time is linear.
    """
    final: list[tuple[float, float, int, int, int]] = []
    kept: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for place, score in zip(places, scores):
        total += gap * (place - last - 1)
        low, first = total, place
        total, last = total + score, place
        j = len(kept) - 1
        while j >= 0 and kept[j][0] >= low:
            j = kept[j][4]
        while j >= 0 and kept[j][1] < total:
            low, _, first, _, lower = kept[j]
            del kept[j:]
            j = lower
        if j < 0:
            final += kept
            kept.clear()
        kept.append((low, total, first, place, j))
    return [(high - low, first, end) for low, high, first, end, _ in final + kept]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of the task each token occurs."""
    counts = (Counter(), Counter())

    def rows():
        names = list(counts[0].keys() | counts[1].keys())
        out = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0]))]
        return pa.RecordBatch.from_arrays(out, names=["token", "toxic", "clean"])

    for batch in slices(batches, "text"):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update({n for w in set(words_of(text)) for n in names_of(w)})
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield rows()
            counts[0].clear(), counts[1].clear()
    yield rows()


class Model:
    """Token scores, chance constants and the calibration curve."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        shortest = STEMS[0]
        self.openings = {t.rstrip("|")[:shortest] for t in scores}
        self.opening = shortest
        self.rate, self.chance = 1.0, 1.0
        self.slope, self.offset = 1.0, 0.0
        self.known: dict[str, float] = {}

    def score(self, word: str) -> float:
        """The score of the word itself, else of its longest beginning that has one, else 0."""
        if (known := self.known.get(word)) is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            known = self.scores.get(word) or next((self.scores[n] for n in reversed(names_of(word)[1:]) if n in self.scores), 0.0)
            self.known[word] = known
        return known

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and scores of the words with a positive score."""
        openings, n = self.openings, self.opening
        return [(i, s) for i, w in enumerate(words) if w[:n] in openings and (s := self.score(w)) > 0]

    def passages(self, words: list[str]) -> list[tuple[float, int, int]]:
        """Every maximal segment of at least LEAST_SEGMENT."""
        hits = self.hits(words)
        return [s for s in segments([i for i, _ in hits], [s for _, s in hits]) if s[0] >= LEAST_SEGMENT]

    def weights(self, words: list[str]) -> list[float]:
        """The segments that count as evidence for the text as a whole.

        A word said again and again tells little more than said once, so here, not in the
        passages, its k-th use in the text scores 1 / k^2.
        """
        times: Counter = Counter()
        marked = []
        for i, s in self.hits(words):
            times[words[i]] += 1
            marked.append((i, s / times[words[i]] ** 2))
        return [s for s, _, _ in segments([i for i, _ in marked], [s for _, s in marked]) if s >= LEAST_SEGMENT]

    def evidence(self, words: list[str]) -> float:
        """-log p of the sum of the best segments' scores above chance; the best number of segments counts."""
        best, total = 0.0, 0.0
        chance = math.log(max(self.chance * len(words), 1e-12)) if words else 0.0
        for r, s in enumerate(sorted(self.weights(words), reverse=True), 1):
            total += self.rate * s - chance
            if total > r:
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
                best = max(best, -log_p - math.log(r + 1))
        return min(best, MOST_EVIDENCE)


def _score(sent, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            evidence, passages = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                evidence.append(model.evidence(words))
                passages.append([{"first_word": a, "last_word": b, "score": s} for s, a, b in model.passages(words)] if wanted else [])
            score = sigmoid(model.slope * np.array(evidence) + model.offset)
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array(evidence, pa.float64()), pa.array(passages, kind)],
                                             names=[*(n for n in batch.schema.names if n != "text"), "score", "evidence", "passages"])

    return run


SCORED = "score double, evidence double, passages array<struct<first_word: bigint, last_word: bigint, score: double>>"


def fit_toxicity(sample: DataFrame) -> Model:
    """A model from rows (text, label); tokens with their counts are filtered in Spark, at most MOST_TOKENS reach the driver."""
    spark = sample.sparkSession
    counts = sample.mapInArrow(tidy(_count), "token string, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = sample.groupBy("label").count().collect()
    by = {r["label"]: r["count"] for r in totals}
    toxic, clean = float(by.get(1, 0)), float(by.get(0, 0))
    bare = Model({})  # without a token to go by, every text gets the share of toxic labels, or less than half without labels
    bare.slope, bare.offset = 0.0, math.log((toxic + 0.5) / (clean + 1.0))
    if not toxic or not clean:
        return bare
    prior = FLAT_PRIOR + SHARED_PRIOR * (F.col("toxic") + F.col("clean")) / (toxic + clean) / 1000
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(t / (toxic + 2 * FLAT_PRIOR + 1 - F.col("toxic"))) - F.log(c / (clean + 2 * FLAT_PRIOR + 1 - F.col("clean")))
    strong = counts.select("token", delta.alias("delta"), (delta / F.sqrt(1 / t + 1 / c)).alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_SCORE))
    rows = strong.orderBy(F.desc("z"), "token").limit(MOST_TOKENS).collect()
    if not rows:
        return bare
    model = Model({r["token"]: min(r["delta"], MOST_SCORE) for r in rows})
    # Chance constants from the clean texts: lambda makes the mean of exp(lambda s) one, K follows from what exceeds LEAST_SEGMENT.
    sent = spark.sparkContext.broadcast(model)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text"):
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = words_of(text)
                hits = [s for _, s in own.hits(words)]
                found = own.weights(words)
                out.append((label, len(words), len(hits), sum(hits), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array([float(o[i]) for o in out], pa.float64()) for i in range(5)], names=["label", "n", "hits", "total", "found"])

    seen = sample.mapInArrow(tidy(chance), "label double, n double, hits double, total double, found double").where("label = 0")
    n, hits, total, found = seen.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in ("n", "hits", "total", "found"))).first()
    share = (hits + 0.5) / (n + 1.0)
    mean = (total + 0.5 * MOST_SCORE) / (hits + 0.5)
    low, high = 1e-3, 1.0  # of log-odds lambda is 1 at most
    for _ in range(60):
        mid = (low + high) / 2
        if share * math.exp(mid * mean) + (1 - share) * math.exp(mid * GAP) > 1:
            high = mid
        else:
            low = mid
    model.rate = low
    model.chance = (found + 0.5) / ((n + 1.0) * math.exp(-low * LEAST_SEGMENT))
    sent = spark.sparkContext.broadcast(model)
    pairs = sample.mapInArrow(tidy(_score(sent, False)), f"label int, {SCORED}").select("label", "evidence").collect()
    model.slope, model.offset = logistic(np.array([r["evidence"] for r in pairs]), np.array([r["label"] for r in pairs]))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, score, passages), one for each row of `docs`.

    score, from 0 to 1, is the chance that the text is toxic; passages lists every
    maximal segment with its first and last word (counted from 0) and score.  The
    score reads the text alone.  A null or empty text has no words and no passages
    and gets the score of a text without evidence.  Repeated rows come out as often
    as they go in; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]
    rows = docs.select(*(F.col(n).alias(f"k{j}") for j, n in enumerate(names)), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"k{j} {docs.schema[n].dataType.simpleString()}" for j, n in enumerate(names))
    out = rows.mapInArrow(tidy(_score(sent, True)), f"{kinds}, {SCORED}")
    return out.select(*(F.col(f"k{j}").alias(n) for j, n in enumerate(names)), "score", "passages")


def train_toxicity(docs: DataFrame, labels: DataFrame, usable) -> Model:
    """Fit on at most MOST_LABELLED labelled documents whose id is usable."""
    return fit_toxicity(labelled_sample(docs, labels, "toxic", usable, MOST_LABELLED))
