"""Word arrays as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.llm.common import LOWER_ASCII, UPPER_ASCII

#: What separates words: ASCII other than letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is; null becomes empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER_ASCII, LOWER_ASCII)


def words(text: Column) -> Column:
    """The words of a text in order; of null, none."""
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def unique_name(df, stem: str) -> str:
    """A column name that `df` does not have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
