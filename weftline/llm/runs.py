"""Periodic runs of words, found online by dyadic square catching.

A square is a stretch of 2q words whose halves are equal; a run is a longest stretch
of period q.  The words of a text are appended one after another.  Every completed
block of 2^k words, aligned to 2^k, stands as a catcher while it lies between
2 * 2^k - 1 and 4 * 2^k - 2 words back, so two catchers of each size stand at a time,
and together the sizes cover every period.  The first half of any square of period q
holds a block of the size whose range holds q, and that block comes back q words
later: when the last 2^k words equal a standing catcher, the distance is a candidate
period.  Its stretch is compared backwards once, and from then on with each appended
word; once it is as long as two periods it is a square, and further words with the
same period only lengthen it: the squares merge into one run, closed by the first
word that differs.

Blocks get numbers from the numbers of their halves, so equal blocks are found by one
dictionary look-up a size.  A suffix whose half equals no block ends the look-ups: on
prose a word costs one or two of them, in periodic text log n.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices

#: A run is at least so many words long (and two periods).
LEAST_LENGTH = 12


class SquareCatcher:
    """Takes words one at a time; `runs()` lists the runs (start, length, period) of all so far."""

    def __init__(self, least: int = LEAST_LENGTH):
        self.least = least
        self.words: list = []
        #: For blocks of 2, 4, 8, ... words: the numbers of those that end at a place, and the number of each pair of halves.
        self.ending: list[dict[int, int]] = [{}]
        self.number: list[dict[tuple, int]] = [{}]
        #: Open stretches: period -> start.  All of them reach the last word.
        self.open: dict[int, int] = {}
        self.closed: dict[tuple[int, int], int] = {}

    def extend(self, words: Sequence) -> None:
        """Append many words: the same as `append` for each."""
        known, opened, pairs, at = self.words, self.open, self.number[0], self.ending[0]
        last = known[-1] if known else None
        before = known[-2] if len(known) > 1 else None
        for t, w in enumerate(words, len(known)):
            known.append(w)
            if opened:
                self._advance(t, w)
            if w == last and t:
                self._candidate(1, t - 1, t)
            if w == before and t > 1:
                self._candidate(2, t - 2, t)
            key = (last, w)
            block = pairs.get(key)
            if block is not None:
                at[t] = block
                self._catch(t, block)
            elif t & 1:
                at[t] = block = pairs[key] = len(pairs)
                if t & 2:
                    self._catch(t, block)
            before, last = last, w

    def append(self, word) -> None:
        self.extend((word,))

    def _catch(self, t: int, block: int) -> None:
        """Compare the last 2, 4, 8, ... words with the two standing catchers of each size, as long as their halves equal blocks.

        Where t ends blocks, they are numbered on the way and stand as catchers from then on.
        """
        level, size = 0, 2
        ending, number = self.ending, self.number
        while True:
            at = ending[level]
            r = (t + 1) % size
            e = t - r - 2 * size
            if e >= 0 and at.get(e) == block:
                self._candidate(t - e, e - size + 1, t)
            e = t - r - 3 * size if r <= size - 2 else t - r - size
            if e >= 0 and at.get(e) == block:
                self._candidate(t - e, e - size + 1, t)
            half = at.get(t - size)
            if half is None:
                return
            level, size = level + 1, 2 * size
            if level == len(number):
                number.append({})
                ending.append({})
            key = (half, block)
            block = number[level].get(key)
            if block is None:
                if (t + 1) % size:
                    return
                block = number[level][key] = len(number[level])
                ending[level][t] = block
                if (t + 1) % (2 * size):
                    return
            else:
                ending[level][t] = block

    def _candidate(self, d: int, start: int, t: int) -> None:
        """A block at `start` came back `d` words later, up to word t: open its stretch unless an open one says it all."""
        opened = self.open
        for q, s in opened.items():
            if s <= start and d % q == 0:
                return
        words = self.words
        while start and words[start - 1] == words[start - 1 + d]:
            start -= 1
        opened[d] = start

    def _advance(self, t: int, w) -> None:
        """One more word: lengthen the open stretches it fits, close the others."""
        words = self.words
        ended = [q for q in self.open if words[t - q] != w]
        for q in ended:
            self._close(q, self.open.pop(q), t)

    def _close(self, q: int, start: int, end: int) -> None:
        if end - start >= max(self.least, 2 * q):
            # One stretch found with a multiple of its period has the same ends: the smallest period names it.
            key = (start, end)
            self.closed[key] = min(q, self.closed.get(key, q))

    def runs(self) -> list[tuple[int, int, int]]:
        found = dict(self.closed)
        for q, start in self.open.items():
            end = len(self.words)
            if end - start >= max(self.least, 2 * q):
                found[start, end] = min(q, found.get((start, end), q))
        return sorted((s, e - s, q) for (s, e), q in found.items())


def word_runs(words: Sequence, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a word list, by start and then period."""
    catcher = SquareCatcher(least)
    catcher.extend(words)
    return catcher.runs()


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside all that runs repeat: a run's first period stays, what follows goes."""
    if not runs:
        return words
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, n_words, runs, collapsed), one for each row of `docs`.

    Words are what stands between ASCII white space.  `runs` is an array of structs
    (start, length, period) by start and then period: stretches of at least `least`
    words and two periods that no neighbouring word lengthens; period is the
    smallest.  `collapsed` holds the words that no run repeats, joined by a space.

    A null or empty text, or one of white space, has no words, no runs and an empty
    `collapsed`.  Runs may overlap; a word is dropped if any repeats it.  Repeated
    rows come out as often as they go in.  Columns other than the named ones are
    dropped.  An empty table gives an empty result.  Memory grows with the words of
    one text.
    """
    names = [id_col, *keep]
    kinds = [docs.schema[n].dataType.simpleString() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts, runs, rest = [], [], []
            for text in texts:
                words = (text or b"").split()  # of bytes: at ASCII white space only
                found = word_runs(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                rest.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.binary()).cast(pa.string())],
                names=[*(f"k{j}" for j in range(len(names))), "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(n).alias(f"k{j}") for j, n in enumerate(names)))
    schema = ", ".join(f"k{j} {kind}" for j, kind in enumerate(kinds))
    out = rows.mapInArrow(run, f"{schema}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.select(*(F.col(f"k{j}").alias(n) for j, n in enumerate(names)), "n_words", "runs", "collapsed")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, text_col): in a tenth of the texts, chosen by the id's digest, the words from some place on repeat the first few of them.

    The rule is fixed (it is the one the registered query states).  A null id or a text without words changes nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    split = rows.withColumn("w", F.when(F.pmod("h", F.lit(10)) == 0, words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    start = F.when(F.col("n") > 0, F.pmod(g, F.col("n"))).cast("int")
    cuts = split.withColumn("a", start).withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int"))

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))

    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return cuts.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias(text_col))
