"""Splitting text, regular expressions, dates and JSON."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.base import as_text
from weftline.types import fresh_name, name_ref


def _literal_pattern(text: str) -> str:
    """Java regex that matches `text` itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_to_columns(
    df: DataFrame,
    field: str,
    delimiter: str = ",",
    num_columns: int = 3,
    prefix: str = "col",
    keep_original: bool = False,
) -> DataFrame:
    """Delimited text to `prefix1..n`; the last column keeps the remainder."""
    n = max(1, num_columns)
    parts = F.split(as_text(field), _literal_pattern(delimiter or ","), n)
    out = df.withColumns({f"{prefix or 'col'}{i + 1}": F.get(parts, F.lit(i)) for i in range(n)})
    return out if keep_original else out.drop(field)


def split_to_rows(df: DataFrame, field: str, delimiter: str = ",") -> DataFrame:
    """One row per part; a null gives one null row."""
    parts = F.split(as_text(field), _literal_pattern(delimiter or ","))
    return _explode_in_place(df, field, parts)


def _explode_in_place(df: DataFrame, field: str, values: Column) -> DataFrame:
    return df.select(*[
        F.explode_outer(values).alias(c) if c == field else name_ref(c) for c in df.columns
    ])


_NAMED_GROUP = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P?<([A-Za-z_]\w*)>")


def pattern_groups(pattern: str) -> tuple[str, list[str]]:
    """The pattern with plain groups, and a column name per group.

    Java knows neither `(?P<name>` nor names with `_`, so names stay here.
    Groups without a name are called by their number.
    """
    probe = re.compile(_NAMED_GROUP.sub(r"\1(?P<\2>", pattern))
    names = {i: n for n, i in probe.groupindex.items()}
    return _NAMED_GROUP.sub(r"\1(", pattern), [names.get(i, str(i)) for i in range(1, probe.groups + 1)]


_PATTERN_PIECE = re.compile(r"\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:<?[=!]|[^:)]*[:)]|>))?|\)(?:[?*]|\{0)?|\||.", re.S)


def certain_groups(java: str) -> set[int]:
    """Numbers of the groups that take part in every match: none under `?`, `*`, `{0,` or beside a `|`."""
    number, open_groups = 0, [{"own": 0, "inner": set(), "choice": False, "refused": False}]
    for piece in _PATTERN_PIECE.findall(java):
        if piece == "|":
            open_groups[-1]["choice"] = True
        elif piece.startswith("(") and not piece.endswith(")"):
            number += piece == "("
            open_groups.append({"own": number if piece == "(" else 0, "inner": set(), "choice": False, "refused": piece.endswith("!")})
        elif piece.startswith(")") and len(open_groups) > 1:
            group = open_groups.pop()
            sure = set() if group["choice"] else group["inner"]
            if group["own"]:
                sure = sure | {group["own"]}
            if piece == ")" and not group["refused"]:
                open_groups[-1]["inner"] |= sure
    return set() if open_groups[0]["choice"] else open_groups[0]["inner"]


def regex_parse(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """Capture groups of the first match as columns; null without a match.

    A group that took no part in the match is null.  Spark cannot tell it from one
    that matched the empty text, so an optional group is null in both cases; a group
    that is part of every match keeps the empty text.
    """
    if not field or not pattern:
        return df
    java, names = pattern_groups(pattern)
    text, sure = as_text(field), certain_groups(java)
    found = {n: F.regexp_extract(text, java, i) for i, n in enumerate(names, 1)}
    return df.withColumns({
        n: F.when(text.rlike(java), found[n]) if i in sure else F.nullif(found[n], F.lit("")) for i, n in enumerate(names, 1)
    })


def regex_match(df: DataFrame, field: str, pattern: str, output_field: str = "matched") -> DataFrame:
    if not field or not pattern:
        return df
    java, _ = pattern_groups(pattern)
    return df.withColumn(output_field or "matched", as_text(field).rlike(java))


def regex_replace(df: DataFrame, field: str, pattern: str, replacement: str = "", output_field: str = "") -> DataFrame:
    """Replace every match; `$1` in the replacement is the first group."""
    if not field or not pattern:
        return df
    java, _ = pattern_groups(pattern)
    return df.withColumn(output_field or field, F.regexp_replace(as_text(field), java, replacement))


def regex_tokenize(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """One row per match; no match gives one null row."""
    if not field or not pattern:
        return df
    java, _ = pattern_groups(pattern)
    return _explode_in_place(df, field, F.regexp_extract_all(as_text(field), F.lit(java), F.lit(0)))


# Strftime directive -> Java pattern letters, padded.
FORMAT_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm",
    "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "j": "DDD", "z": "xx",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}

# When parsing, these directives also take one digit, unless digits touch them.
ONE_DIGIT = {"m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s"}

# Patterns tried in turn when no format is given.
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy")
TIME_PATTERNS = ("H:m:s[.SSSSSS]", "H:m")

# The digits each part of those patterns stands for.
PART_SHAPES = {"yyyy": r"\d{4}", "['T'][ ]": "[T ]", "[.SSSSSS]": r"(\.\d{1,6})?", ".": r"\."}


def _when_shaped(col: Column, pattern: str, parsed: Column) -> Column:
    """Parse only text of the pattern's shape: a failed parse is far dearer than a match."""
    parts = re.findall(r"yyyy|\['T'\]\[ \]|\[\.S+\]|[A-Za-z]|.", pattern)
    shape = "".join(PART_SHAPES.get(p, r"\d{1,2}" if p.isalpha() else p) for p in parts)
    return F.when(col.rlike(f"^{shape}$"), parsed)


def java_pattern(fmt: str, parsing: bool = False) -> str:
    """Java date pattern of a strftime format."""
    tokens = re.findall(r"%\.?.|[^%]", fmt, flags=re.S)
    out: list[str] = []
    literal = ""

    def flush():
        nonlocal literal
        if literal:
            plain = not re.search(r"[A-Za-z\[\]{}#']", literal)
            out.append(literal if plain else "'" + literal.replace("'", "''") + "'")
            literal = ""

    for i, token in enumerate(tokens):
        if token == "%%":
            literal += "%"
        elif token == "%.f":
            flush()
            out.append("[.SSSSSS]" if parsing else ".SSSSSS")
        elif token.startswith("%") and len(token) > 1:
            letter = token[1:]
            if letter not in FORMAT_LETTERS:
                raise ValueError(f"unknown date directive {token!r}")
            flush()
            touching = any(
                0 <= j < len(tokens) and tokens[j].startswith("%") and tokens[j] not in ("%%", "%.f") for j in (i - 1, i + 1)
            )
            out.append(ONE_DIGIT[letter] if parsing and letter in ONE_DIGIT and not touching else FORMAT_LETTERS[letter])
        else:
            literal += token
    flush()
    return "".join(out)


def parse_date(col: Column, fmt: str = "") -> Column:
    """Text to date, null where it does not fit; no format tries the usual ones per value."""
    if fmt:
        return F.try_to_date(col, java_pattern(fmt, parsing=True))
    return F.coalesce(*[_when_shaped(col, p, F.try_to_date(col, p)) for p in DATE_PATTERNS])


def parse_datetime(col: Column, fmt: str = "") -> Column:
    """Text to zone-free timestamp, null where it does not fit."""

    def parsed(pattern: str) -> Column:
        return F.try_to_timestamp(col, F.lit(pattern)).cast("timestamp_ntz")

    if fmt:
        return parsed(java_pattern(fmt, parsing=True))
    patterns = [f"{d}['T'][ ]{t}" for d in DATE_PATTERNS for t in TIME_PATTERNS] + list(DATE_PATTERNS)
    return F.coalesce(*[_when_shaped(col, p, parsed(p)) for p in patterns])


def datetime_parse(df: DataFrame, field: str, fmt: str = "", output_type: str = "date", output_field: str = "") -> DataFrame:
    if output_type not in ("date", "datetime"):
        raise ValueError("output_type must be date or datetime")
    parse = parse_date if output_type == "date" else parse_datetime
    return df.withColumn(output_field or field, parse(as_text(field), fmt))


def datetime_format(df: DataFrame, field: str, fmt: str = "%Y-%m-%d", output_field: str = "") -> DataFrame:
    return df.withColumn(output_field or field, F.date_format(name_ref(field), java_pattern(fmt or "%Y-%m-%d")))


_SCHEMA_TOKEN = re.compile(r"`(?:[^`]|``)*`|\b(?:OBJECT(?=<)|VOID(?!:)|VARIANT(?!:)|DECIMAL\(\d+,\s*\d+\))")


def _to_ddl(found: str) -> str:
    """Schema text of a variant as a DDL type for from_json."""

    def swap(m: re.Match) -> str:
        token = m.group(0)
        if token.startswith("`"):
            return token
        if token.startswith("DECIMAL"):
            # Without decimal places it is a whole number too large for bigint: no double could hold its digits.
            return token if re.search(r",\s*0\)$", token) else "DOUBLE"
        return "STRUCT" if token == "OBJECT" else "STRING"

    return _SCHEMA_TOKEN.sub(swap, found)


def infer_json_type(df: DataFrame, field: str) -> T.DataType:
    """Type that fits every JSON text of the field: one aggregate job over that column.

    Fractions become double; values of differing kinds stay JSON text.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(as_text(field)))).first()[0]
    return T._parse_datatype_string(_to_ddl(found or "VOID"))


def json_parse(
    df: DataFrame,
    field: str,
    schema: T.DataType | str | None = None,
    keep_original: bool = False,
    on_error: str = "fail",
) -> DataFrame:
    """JSON text to columns: one per top field of an object, else `{field}_parsed`.

    Give `schema` to save the job that finds it.  Malformed text fails the job,
    or becomes null with `on_error="null"`.
    """
    if not field:
        raise ValueError("no JSON field")
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be fail or null")
    if schema is None:
        dtype = infer_json_type(df, field)
    else:
        dtype = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = as_text(field)
    mode = {"mode": "FAILFAST" if on_error == "fail" else "PERMISSIVE"}
    kept = [name_ref(c) for c in df.columns if keep_original or c != field]
    if isinstance(dtype, T.StructType):
        clash = set(dtype.names) & {c for c in df.columns if keep_original or c != field}
        if clash:
            raise ValueError(f"parsed fields clash with columns: {sorted(clash)}")
        parsed = fresh_name("parsed", df.columns)
        out = df.withColumn(parsed, F.from_json(text, dtype, mode))
        return out.select(*kept, *[name_ref(parsed).getField(n).alias(n) for n in dtype.names])
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        value = F.from_json(text, dtype, mode)
    else:
        # from_json reads only objects, arrays and maps: take a lone value through a variant.
        variant = F.parse_json(text) if on_error == "fail" else F.try_parse_json(text)
        value = F.try_variant_get(variant, "$", dtype.simpleString())
    return df.select(*kept, value.alias(f"{field}_parsed"))
