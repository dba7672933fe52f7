"""Find and replace from a lookup table, on whole fields or on parts of them.

Parts are found by an Aho-Corasick automaton over all entries, so a text is read
once however many entries there are; at each place the longest entry wins, and the
search goes on behind it.  A lookup table too large for every task is not sent to
them: each entry goes to the rarest of its grams, the distinct texts meet it there
by their own grams, and each text is then searched for the entries it holds alone.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.types import fresh_name, name_ref

#: Bytes of a lookup table up to which it is sent to every task.
BROADCAST_BYTES = 16 << 20
#: Characters of the grams by which texts and entries of a larger table meet.
GRAM = 3


class Replacer:
    """Leftmost, longest replacement of many strings at once."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for find, put in entries:
            self.automaton.add_word(find, (len(find), put))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        if not text or not len(self.automaton):
            return text
        longest: dict[int, tuple[int, str]] = {}
        for last, (size, put) in self.automaton.iter(text):
            start = last + 1 - size
            if start not in longest or longest[start][0] <= last:
                longest[start] = (last + 1, put)
        if not longest:
            return text
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                end, put = longest[start]
                out += (text[at:start], put)
                at = end
        out.append(text[at:])
        return "".join(out)


def find_replace(df: DataFrame, field: str, lookup: DataFrame, find: str, replacement: str, whole: bool = False) -> DataFrame:
    """Replace in the text column `field` what the lookup table's column `find` holds by its `replacement`.

    With `whole` a field is replaced if it equals an entry.  Otherwise every part that
    equals an entry is replaced: from left to right, at each place by the longest
    entry, and what was put in is not searched again.  Case counts.  Entries whose `find`
    is null or empty are ignored; a null replacement is the empty text; of entries with
    one `find` the least replacement counts.  A null field stays null.  An empty
    lookup table changes nothing.
    """
    if not isinstance(df.schema[field].dataType, T.StringType):
        raise TypeError(f"column {field!r} is no text")
    entries = lookup.select(name_ref(find).cast("string").alias("find"), F.coalesce(name_ref(replacement).cast("string"), F.lit("")).alias("put"))
    # For `min` of a text Spark sorts all rows it gets, so copies go first, in a hash aggregate.
    # Without the count the optimizer would take that step for redundant.
    pairs = entries.where("find <> ''").groupBy("find", "put").agg(F.count("*").alias("copies")).where("copies > 0")
    entries = pairs.groupBy("find").agg(F.min("put").alias("put"))
    if whole:
        return _joined(df, field, entries)
    size = F.octet_length("find") + F.octet_length("put") + 32
    if (entries.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        # Bounded by BROADCAST_BYTES.
        sent = df.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.collect()])
        return _with(df, field, _replaced(sent)(name_ref(field)))
    return _joined(df, field, _by_grams(df, field, entries))


def _with(df: DataFrame, field: str, col: Column) -> DataFrame:
    return df.select(*(col.alias(c) if c == field else name_ref(c) for c in df.columns))


def _joined(df: DataFrame, field: str, entries: DataFrame) -> DataFrame:
    """The table with fields that equal `find` replaced by `put`; AQE splits a text that many rows hold."""
    was, put = fresh_name("find", df.columns), fresh_name("put", df.columns)
    told = entries.select(F.col("find").alias(was), F.col("put").alias(put))
    joined = df.join(told, name_ref(field) == name_ref(was), "left")
    return _with(joined, field, F.coalesce(name_ref(put), name_ref(field))).drop(was, put)


def _replaced(sent):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replace = Replacer(sent.value)
        for texts in batches:
            yield texts.map(replace, na_action="ignore")

    return run


def _replaced_by_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, entries = (c.to_pylist() for c in batch.columns)
        put = [Replacer((e["find"], e["put"]) for e in own)(t) for t, own in zip(texts, entries)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(put, pa.string())], names=["find", "put"])


def _letters(text: Column) -> Column:
    """The characters as an array, so that grams are put together without walking the text anew for each."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _grams(letters: Column, n: int) -> Column:
    """The distinct n-grams of an array of characters."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(letters) - n, F.lit(0))), lambda i: i + n <= F.size(letters))
    return F.array_distinct(F.transform(places, lambda i: F.concat(*(F.get(letters, i + j) for j in range(n)))))


def _by_grams(df: DataFrame, field: str, entries: DataFrame) -> DataFrame:
    """(find, put) for the distinct texts of the column that hold an entry: the text and what it becomes."""
    cut = entries.withColumn("letters", _letters(F.col("find")))
    of_entry = _grams(F.col("letters"), GRAM)
    for n in range(1, GRAM):
        of_entry = F.when(F.size("letters") == n, _grams(F.col("letters"), n)).otherwise(of_entry)
    own = cut.select("find", "put", F.explode(of_entry).alias("gram"))
    often = own.groupBy("gram").agg(F.count("*").alias("often"))
    keyed = own.join(often, "gram").groupBy("find", "put").agg(F.min(F.struct("often", "gram"))["gram"].alias("gram"))
    texts = df.select(name_ref(field).alias("text")).where("text <> ''").distinct()
    letters = texts.select("text", _letters(F.col("text")).alias("letters"))
    met = letters.select("text", F.explode(F.concat(*(_grams(F.col("letters"), n) for n in range(1, GRAM + 1)))).alias("gram"))
    held = met.join(keyed, "gram").where(F.col("text").contains(F.col("find")))
    lists = held.groupBy("text").agg(F.collect_list(F.struct("find", "put")).alias("entries"))
    return lists.mapInArrow(_replaced_by_own, "find string, put string")
