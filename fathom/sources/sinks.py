"""Writers: JSON (records / values layouts), cleaned-table output, JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: ISO-8601 rendering of timestamps (fraction only when non-zero).
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
# Text formats keep full microsecond precision (Spark's CSV/JSON default stops at millis).
TEXT_TIMESTAMP_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """CSV with header, in parallel part files, quotes doubled inside quoted cells (RFC 4180), an empty text as "" and
    NULL as nothing, timestamps at microsecond precision."""
    df.write.mode(mode).options(header="true", sep=sep, quote='"', escape='"', emptyValue='""', nullValue="", **TEXT_TIMESTAMP_OPTIONS).csv(path)


def iso_timestamp(c: Column) -> Column:
    whole = F.date_format(c, ISO_SECONDS)
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def _safe(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DecimalType):
        return c.cast("string")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(dt)).otherwise(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(c)
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.BinaryType)):
        return c.cast("string")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: _safe(e, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, v: k.cast("string")),
                                  lambda k, v: _safe(v, dt.valueType))
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """Values JSON can carry: decimals as text, NaN/inf as NULL, dates and timestamps as ISO
    text, map keys as text, applied recursively inside arrays, maps and structs."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, orient: str = "records", mode: str = "errorifexists") -> None:
    """JSON lines written in parallel: ``records`` (one object per line) or ``values`` (one array
    per line). ``index`` and ``columns`` would need the whole table in one document written by
    one task, so they are refused; write ``records`` with an explicit key column instead."""
    safe = json_safe(df)
    if orient == "records":
        safe.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif orient == "values":
        safe.select(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in safe.columns])).alias("value")) \
            .write.mode(mode).text(path)
    else:
        raise ValueError(f"orient {orient!r} is a single document; use 'records' or 'values'")


def write_cleaned(df: DataFrame, out_dir: str, name: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a cleaned table to ``<out_dir>/<name>_cleaned.<fmt>`` (a directory of part files)."""
    path = f"{out_dir.rstrip('/')}/{name}_cleaned.{fmt}"
    if fmt == "csv":
        write_csv(df, path, mode=mode)
    else:
        df.write.mode(mode).format(fmt).save(path)
    return path
