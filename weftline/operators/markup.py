"""XML text to columns."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.base import as_text
from weftline.types import fresh_name, name_ref

#: Different element and attribute paths that one schema may hold.
MOST_PATHS = 5_000
#: Kinds of text, as bits that add up over all places of a path.
WHOLE, FRACTION, TRUTH, OTHER = 1, 2, 4, 8

_WHOLE = re.compile(r"[+-]?(0|[1-9][0-9]{0,17})")
_FRACTION = re.compile(r"[+-]?([0-9]{1,17}\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?")


def _kind(text: str) -> int:
    text = text.strip()
    if not text:
        return 0
    if _WHOLE.fullmatch(text):
        return WHOLE
    if _FRACTION.fullmatch(text):
        return FRACTION
    return TRUTH if text in ("true", "false") else OTHER


def _paths(text: str) -> dict[tuple[str, ...], tuple[int, bool]]:
    """Paths below the root of one document: kinds of their text, and whether one parent holds several."""
    found: dict[tuple[str, ...], tuple[int, bool]] = {}
    path: list[str] = []
    texts: list[list[str]] = []
    seen: list[set[str]] = []

    def note(at: tuple[str, ...], kind: int, again: bool) -> None:
        old = found.get(at, (0, False))
        found[at] = (old[0] | kind, old[1] or again)

    def start(name: str, attributes: dict[str, str]) -> None:
        if seen:
            note((*path[1:], name), 0, name in seen[-1])
            seen[-1].add(name)
        path.append(name)
        texts.append([])
        seen.append(set())
        for key, value in attributes.items():
            if key != "xmlns" and not key.startswith("xmlns:"):
                note((*path[1:], f"_{key}"), _kind(value), False)

    def end(_: str) -> None:
        note(tuple(path[1:]), _kind("".join(texts.pop())), False)
        path.pop()
        seen.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: texts[-1].append(data)
    parser.Parse(text, True)
    return found


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole: dict[tuple[str, ...], tuple[int, bool]] = {}
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            if text is None:
                continue
            try:
                paths = _paths(text)
            except expat.ExpatError:
                continue
            for at, (kind, again) in paths.items():
                old = whole.get(at, (0, False))
                whole[at] = (old[0] | kind, old[1] or again)
            if len(whole) > MOST_PATHS:
                raise ValueError(f"the texts hold more than {MOST_PATHS} different paths: give a schema")
    rows = [(json.dumps(at), kind, again) for at, (kind, again) in whole.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_())],
        names=["path", "kind", "again"])


def _scalar(kind: int) -> T.DataType:
    if kind == WHOLE:
        return T.LongType()
    if kind in (FRACTION, WHOLE | FRACTION):
        return T.DoubleType()
    return T.BooleanType() if kind == TRUTH else T.StringType()


def infer_xml_type(df: DataFrame, field: str) -> T.StructType:
    """Columns that fit every well-formed XML text of the field: one aggregate job over that column.

    Children and attributes (`_name`) of the root become fields, by name; elements
    that one parent holds several times anywhere become arrays; text beside
    attributes or children is `_VALUE`.  Whole numbers are bigint, numbers of which
    some have a point double, true and false boolean, all else string; so are whole
    numbers of more than 18 digits or with leading zeros.  Only the different paths
    reach the driver, at most MOST_PATHS.
    """
    each = df.select(as_text(field).alias("text")).mapInArrow(_found, "path string, kind int, again boolean")
    paths = each.groupBy("path").agg(F.bit_or("kind").alias("kind"), F.bool_or("again").alias("again")).limit(MOST_PATHS + 1).collect()
    if len(paths) > MOST_PATHS:
        raise ValueError(f"the texts hold more than {MOST_PATHS} different paths: give a schema")
    known = {tuple(json.loads(r["path"])): (r["kind"], r["again"]) for r in paths}
    below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for at in sorted(known):
        if at:
            below.setdefault(at[:-1], []).append(at)

    def shape(at: tuple[str, ...]) -> T.DataType:
        kind, again = known.get(at, (0, False))
        parts = below.get(at, [])
        inner: T.DataType = _scalar(kind)
        if parts or not at:
            fields = [T.StructField(p[-1], shape(p)) for p in parts]
            inner = T.StructType([*([T.StructField("_VALUE", inner)] if kind else []), *fields])
        return T.ArrayType(inner) if again else inner

    return shape(())


def xml_parse(
    df: DataFrame,
    field: str,
    schema: T.StructType | str | None = None,
    keep_original: bool = False,
    on_error: str = "fail",
) -> DataFrame:
    """XML text to columns: one per child or attribute (`_name`) of the root.

    Give `schema` to save the job that finds it.  Null and empty texts give
    nulls.  Text that is not well formed fails the job, or gives nulls with
    `on_error="null"`.  A value that does not fit a given schema counts as such text.
    What follows the end of the root is not read.
    """
    if not field:
        raise ValueError("no XML field")
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be fail or null")
    shape = infer_xml_type(df, field) if schema is None else schema
    shape = T._parse_datatype_string(shape) if isinstance(shape, str) else shape
    others = [c for c in df.columns if keep_original or c != field]
    clash = set(shape.names) & set(others)
    if clash:
        raise ValueError(f"parsed fields clash with columns: {sorted(clash)}")
    kept = [name_ref(c) for c in others]
    if not shape.names:
        return df.select(*kept)
    text = as_text(field)
    text = F.when(F.trim(text) != "", text)
    bad = fresh_name("broken", [*df.columns, *shape.names])
    options = {"mode": "FAILFAST" if on_error == "fail" else "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    wide = T.StructType([*shape.fields, *([] if on_error == "fail" else [T.StructField(bad, T.StringType())])])
    parsed = fresh_name("parsed", df.columns)
    out = df.withColumn(parsed, F.from_xml(text, wide, options))
    value = {n: name_ref(parsed).getField(n) for n in wide.names}
    if on_error == "null":
        fine = value.pop(bad).isNull()
        value = {n: F.when(fine, v) for n, v in value.items()}
    return out.select(*kept, *[v.alias(n) for n, v in value.items()])
