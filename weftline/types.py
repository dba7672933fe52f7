"""Logical type names, null-on-failure casts, and type alignment."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical type name -> Spark type.
LOGICAL_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "time": T.TimeType(),
    "datetime": T.TimestampNTZType(),
    "duration": T.DayTimeIntervalType(),
    "binary": T.BinaryType(),
}

# Formats that keep microseconds; Spark's text defaults cut them to milliseconds.
TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

UNSIGNED_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


def name_ref(name: str) -> Column:
    """Column by its exact name, also when the name holds dots, blanks or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def spark_type(logical: str) -> T.DataType:
    """Spark type of a logical name; `decimal(p,s)` and other Spark types pass through."""
    if logical in LOGICAL_TYPES:
        return LOGICAL_TYPES[logical]
    if logical == "decimal" or logical.startswith(("decimal(", "array<", "struct<", "map<")):
        return T._parse_datatype_string(logical)
    raise ValueError(f"unknown type {logical!r}")


def logical_name(dtype: T.DataType) -> str:
    """Logical name of a Spark type; anything unknown reports as string."""
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.ArrayType):
        return "list"
    if isinstance(dtype, T.StructType):
        return "struct"
    if isinstance(dtype, T.TimestampType):
        return "datetime"
    for name, candidate in LOGICAL_TYPES.items():
        if name not in UNSIGNED_BITS and type(candidate) is type(dtype):
            return name
    return "string"


def as_double(col: Column) -> Column:
    """Double, null where a value is no number: the suffixes and hexadecimal forms that Spark's cast takes are none."""
    foreign = col.cast("string").rlike(r"(?i)[0-9.]\s*[df]\s*$|^\s*[+-]?0x")
    return F.when(foreign.isNull() | ~foreign, col.try_cast("double"))


def lenient_cast(col: Column, logical: str) -> Column:
    """Cast that gives null where a value does not convert."""
    target = spark_type(logical)
    bits = UNSIGNED_BITS.get(logical)
    if isinstance(target, (T.FloatType, T.DoubleType)):
        return as_double(col).cast(target)
    if bits is None:
        return col.try_cast(target)
    # Spark has no unsigned integers: hold them one size up and check the range.
    wide = col.try_cast(T.DecimalType(38, 0))
    return F.when(wide.between(F.lit(0), F.lit(str(2**bits - 1)).cast(T.DecimalType(20, 0))), wide).cast(target)


_INTEGERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_FLOATS = [T.FloatType, T.DoubleType]


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    pair = (a, b)
    if all(type(t) in _INTEGERS for t in pair):
        return max(pair, key=lambda t: _INTEGERS.index(type(t)))
    if all(type(t) in _FLOATS for t in pair):
        return T.DoubleType()
    if all(isinstance(t, T.NumericType) for t in pair):
        if any(type(t) in _FLOATS for t in pair):
            return T.DoubleType()
        digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
        decs = [t if isinstance(t, T.DecimalType) else T.DecimalType(digits[type(t)], 0) for t in pair]
        scale = max(t.scale for t in decs)
        whole = max(t.precision - t.scale for t in decs)
        return T.DecimalType(min(38, whole + scale), scale)
    dates = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if all(isinstance(t, dates) for t in pair):
        return T.TimestampType() if any(isinstance(t, T.TimestampType) for t in pair) else T.TimestampNTZType()
    return T.StringType()


def common_type(types: list[T.DataType]) -> T.DataType:
    """Type all the given ones fit in: numbers widen, anything else becomes string."""
    return reduce(_wider, types)


def typed(col: Column, have: T.DataType, want: T.DataType) -> Column:
    return col if have == want else col.cast(want)


def align(df: DataFrame, want: dict[str, T.DataType]) -> DataFrame:
    """Cast the columns whose type differs from `want`; leaves the rest alone."""
    have = {f.name: f.dataType for f in df.schema.fields}
    if all(have[n] == t for n, t in want.items() if n in have):
        return df
    return df.select(
        *[typed(name_ref(n), t, want.get(n, t)).alias(n) for n, t in have.items()]
    )


def fields_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def fresh_name(base: str, *taken: list[str]) -> str:
    """`base`, prefixed until no given column list holds it."""
    used = {n for names in taken for n in names}
    name = base
    while name in used:
        name = "_" + name
    return name


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all the columns are filled; unlike `dropna`, the test reaches the scan."""
    return df.where(reduce(lambda a, b: a & b, [name_ref(c).isNotNull() for c in columns]))
