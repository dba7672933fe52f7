"""Text functions; every input is read as text first."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.base import as_text

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim(x: Column | str) -> Column:
    """Strip all leading and trailing white space, not only blanks."""
    return F.btrim(as_text(x), F.lit(WHITE_SPACE))


def upper(x: Column | str) -> Column:
    return F.upper(as_text(x))


def lower(x: Column | str) -> Column:
    return F.lower(as_text(x))


def length(x: Column | str) -> Column:
    """Characters, not bytes."""
    return F.length(as_text(x))


def substring(x: Column | str, start: int, count: int | None = None) -> Column:
    """Zero-based start; a negative start counts from the end."""
    text = as_text(x)
    if start >= 0:
        return F.substring(text, start + 1, 2**31 - 1 if count is None else count)
    if count is None:
        # A start before the first character begins at the first character.
        return F.when(F.length(text) <= -start, text).otherwise(F.right(text, F.lit(-start)))
    return F.substring(text, start, count)


def contains(x: Column | str, needle: str) -> Column:
    """Literal search, not a pattern."""
    return as_text(x).contains(needle)


def starts_with(x: Column | str, prefix: str) -> Column:
    return as_text(x).startswith(prefix)


def ends_with(x: Column | str, suffix: str) -> Column:
    return as_text(x).endswith(suffix)


def replace(x: Column | str, old: str, new: str) -> Column:
    """Replace every occurrence of a literal."""
    return F.replace(as_text(x), F.lit(old), F.lit(new))


def concat(*parts: Column | str) -> Column:
    """Join the parts as text; one null part makes the result null."""
    if not parts:
        raise TypeError("concat needs at least one argument")
    return F.concat(*[as_text(p) for p in parts])
