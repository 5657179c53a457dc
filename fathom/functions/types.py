"""Map Spark data types to the profile's descriptive vocabulary (driver side, no job)."""

from __future__ import annotations

from pyspark.sql import types as T

# The descriptive type names of the profile, as documented for the
# column metadata format (number | string | date | boolean) plus the extra names the
# type table uses for other kinds of data.
NUMBER = "number"
STRING = "string"
DATE = "date"
BOOLEAN = "boolean"
DURATION = "duration"
MIXED = "mixed"
EMPTY = "empty"


def descriptive_type(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, T.NumericType):
        return NUMBER
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return STRING
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return DURATION
    if isinstance(dt, T.NullType):
        return EMPTY
    return MIXED


def is_numeric(dt: T.DataType) -> bool:
    """Numbers only; booleans are not numeric here (they get counts only)."""
    return isinstance(dt, T.NumericType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_scalar(dt: T.DataType) -> bool:
    """Types whose values can be counted and compared as one value each."""
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.NullType, T.VariantType))
