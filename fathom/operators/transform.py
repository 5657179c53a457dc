"""Suggested transformations (normalize, scale, ..., time_binning) as DataFrame operators.

Each takes ``(df, col, *, out=None, **params)`` and adds column ``out`` (default
``<col>_<name>``). Whole-column statistics are fitted as one bounded aggregate row first and
applied as literals; per-row work is built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.stats import nan_to_null
from fathom.plans import ranks
from fathom.plans.ordered import lag_by_key
from fathom.functions.types import is_floating

# The tokenizer's word characters (letters and digits of every script, and underscore) and whitespace.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"
WHITESPACE = r"[ \t\n\r\f]+"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(df: DataFrame, col: str) -> Column:
    """The column as double with NaN read as missing, as the fitted statistics do."""
    x = _c(col).cast("double")
    return F.when(~F.isnan(x), x) if is_floating(df.schema[col].dataType) else x


def _fit(df: DataFrame, col: str, *aggs) -> dict:
    x = _c(col).cast("double")
    clean = nan_to_null(df.select(x.alias("_x")))
    return clean.agg(*aggs).first().asDict()


def normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Min-max scaling to [0, 1]; NULL when the column has a single value."""
    s = _fit(df, col, F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    x = _number(df, col)
    span = None if s["lo"] is None else s["hi"] - s["lo"]
    expr = F.lit(None).cast("double") if not span else (x - F.lit(s["lo"])) / F.lit(span)
    return df.withColumn(out or f"{col}_normalized", expr)


def scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Standard score (x - mean) / sample standard deviation; NULL when that is 0 or undefined."""
    s = _fit(df, col, F.avg("_x").alias("m"), F.stddev_samp("_x").alias("s"))
    x = _number(df, col)
    expr = F.lit(None).cast("double") if not s["s"] else (x - F.lit(s["m"])) / F.lit(s["s"])
    return df.withColumn(out or f"{col}_scaled", expr)


def log_transform(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """ln(1 + x); NULL for x <= -1 and for NaN."""
    x = _number(df, col)
    return df.withColumn(out or f"{col}_log", F.when(x > -1, F.log1p(x)))


def binning(df: DataFrame, col: str, bins: int = 10, out: str | None = None) -> DataFrame:
    """Equal-width bins 0..bins-1 over [min, max], left-closed, the max in the last bin; missing values have none."""
    s = _fit(df, col, F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    x = _number(df, col)
    if s["lo"] is None:
        expr = F.lit(None).cast("int")
    elif s["hi"] == s["lo"]:
        expr = F.when(x.isNotNull(), F.lit(0))
    else:
        width = (s["hi"] - s["lo"]) / bins
        # least() skips NULLs, so keep missing values missing explicitly.
        expr = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(s["lo"])) / F.lit(width)),
                                             F.lit(bins - 1))).cast("int")
    return df.withColumn(out or f"{col}_bin", expr)


def one_hot_encode(df: DataFrame, col: str, values: list, prefix: str | None = None) -> DataFrame:
    """0/1 column ``<prefix>_<value>`` for each of the given ``values``; other and missing values have 0 in all.

    The columns of a table must be known when it is planned, so the caller names the categories
    (:func:`categories` lists them). For many values use :func:`one_hot_long`.
    """
    prefix = prefix or col
    return df.select("*", *[F.when(_c(col) == F.lit(v), 1).otherwise(0).alias(f"{prefix}_{v}") for v in values])


def categories(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of a column, one row each."""
    return df.select(_c(col).alias(col)).where(_c(col).isNotNull()).distinct()


def one_hot_long(df: DataFrame, id_col: str, col: str, num_slices: int | None = None) -> DataFrame:
    """One-hot encoding of any number of values as (id, index) rows: the positions of the ones, index as in label_encode."""
    coded = label_encode(df.select(_c(id_col).alias("_id"), _c(col).alias("_v")), "_v", "_index", num_slices)
    return coded.where(F.col("_index").isNotNull()).select(F.col("_id").alias(id_col), F.col("_index").alias("index"))


def label_encode(df: DataFrame, col: str, out: str | None = None, num_slices: int | None = None) -> DataFrame:
    """0-based rank of the value among the sorted distinct values; NULL stays NULL.

    The dictionary is ranked without a global window (:func:`ranks.dense_index`); how it is joined is left to
    Spark, which knows its size in bytes.
    """
    out = out or f"{col}_label"
    dictionary = ranks.dense_index(df, col, "_label", num_slices).select(_c(col).alias("_value"), "_label")
    joined = df.join(dictionary, _c(col) == F.col("_value"), "left")
    return joined.select(*[_c(c) for c in df.columns], F.col("_label").alias(out))


def tokens_expr(c: Column) -> Column:
    """Lower-cased word tokens of a text (empty strings removed)."""
    return F.array_remove(F.split(F.lower(c), WORD_SPLIT), "")


def text_processing(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add the token array of a text column."""
    return df.withColumn(out or f"{col}_tokens", tokens_expr(_c(col)))


def token_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by..., token, count) over whole texts; map-side combine keeps hot tokens cheap."""
    by = by or []
    exploded = df.select(*[_c(b) for b in by], F.explode(tokens_expr(_c(col))).alias("token"))
    return exploded.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("count"))


def string_cleaning_expr(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, WHITESPACE, " ")))


def string_cleaning(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Collapse whitespace runs to one space, trim, lower-case."""
    return df.withColumn(out or col, string_cleaning_expr(_c(col)))


def regex_extract(df: DataFrame, col: str, pattern: str, group: int = 1, out: str | None = None) -> DataFrame:
    """Group ``group`` of the first match; '' when nothing matches (NULL input stays NULL)."""
    return df.withColumn(out or f"{col}_extract", F.regexp_extract(_c(col), pattern, group))


def extract_year(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_year", F.year(_c(col)))


def extract_month(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_month", F.month(_c(col)))


def day_of_week(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """0 = Monday ... 6 = Sunday."""
    return df.withColumn(out or f"{col}_dow", F.weekday(_c(col)))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / 1e6


def time_delta(df: DataFrame, col: str, key: list[str] | None = None, tiebreak: list[str] | None = None,
               other: str | None = None, out: str | None = None) -> DataFrame:
    """Seconds from ``other`` to ``col`` per row, or since the previous row of the same key (of all rows without one).

    Rows of one key are ordered by (col, tiebreak...); the first row of a key gets NULL.
    """
    out = out or f"{col}_delta_seconds"
    if other:
        return df.withColumn(out, seconds_between(_c(other), _c(col)))
    # Range slices of (key, time): a hot key, or the one sequence there is without a key, is spread
    # over many tasks (see plans.ordered).
    rows, keys = (df, list(key)) if key else (df.withColumn("_all", F.lit(0)), ["_all"])
    prev = lag_by_key(rows, keys, [col, *(tiebreak or [])], col, "_prev_ts")
    return prev.withColumn(out, seconds_between(F.col("_prev_ts"), _c(col))).drop("_prev_ts", "_all")


def _microseconds(width: str) -> int:
    """Length of a fixed-width interval such as '15 minutes'."""
    units = {"microsecond": 1, "millisecond": 1000, "second": 10 ** 6, "minute": 6 * 10 ** 7, "hour": 36 * 10 ** 8,
             "day": 864 * 10 ** 8, "week": 7 * 864 * 10 ** 8}
    count, _, unit = width.strip().partition(" ")
    unit = unit.strip().lower().removesuffix("s")
    if unit not in units or not count.isdigit() or not int(count):
        raise ValueError(f"width must be a number and one of {tuple(units)}, not {width!r}")
    return int(count) * units[unit]


def time_binning(df: DataFrame, col: str, unit: str | None = "hour", width: str | None = None,
                 out: str | None = None) -> DataFrame:
    """Start of the fixed bucket holding each timestamp: a calendar ``unit`` or a ``width``
    such as '15 minutes' (aligned to the epoch). Rows without a timestamp stay, without a bucket."""
    out = out or f"{col}_bin"
    if width:
        size, epoch = _microseconds(width), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        since = F.timestamp_diff("MICROSECOND", epoch, _c(col).cast("timestamp_ntz"))
        start = F.timestamp_add("MICROSECOND", since - F.pmod(since, F.lit(size)), epoch)
    else:
        start = F.date_trunc(unit, _c(col))
    return df.withColumn(out, start.cast("timestamp_ntz"))
