"""Outlier rules with bounds of their own per group: what is dear for one category is cheap for another.

The bounds are a table (a row a group), fitted exactly: percentiles from the weighted value table in range slices, means and
deviations from a map-side aggregate. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.types import is_floating
from fathom.plans.quantiles import weighted_quantiles
from fathom.plans.ranks import quoted

METHODS = ("percentile", "iqr", "zscore")
KEY, LOW, HIGH = "_group_key", "_group_low", "_group_high"


def _key(by: list[str]) -> Column:
    """One text for the grouping columns; NULL is a value of its own."""
    return F.to_json(F.struct(*[quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"})


def _value(df: DataFrame, col: str) -> Column:
    """NaN is missing."""
    x = quoted(col)
    return F.when(~F.isnan(x), x) if is_floating(df.schema[col].dataType) else x


def fit_group_bounds(df: DataFrame, by: list[str], col: str, method: str = "percentile", lower: float | None = None, upper: float | None = 0.99,
                     k: float | None = None) -> DataFrame:
    """(_group_key, _group_low, _group_high) per group of ``by``: NULL where a bound is not asked for or cannot be fitted.

    'percentile' (linear interpolation at ``lower`` and ``upper``), 'iqr' (quartiles -+ k ranges, k = 1.5) or 'zscore' (mean -+ k sample deviations, k = 3).
    """
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method!r}; choose one of {METHODS}")
    if not by:
        raise ValueError("by must name the grouping columns")
    rows = df.select(_key(by).alias(KEY), _value(df, col).cast("double").alias("_x")).where("_x IS NOT NULL")
    if method == "zscore":
        width = F.lit(3.0 if k is None else float(k)) * F.stddev_samp("_x")
        return rows.groupBy(KEY).agg((F.avg("_x") - width).alias(LOW), (F.avg("_x") + width).alias(HIGH))
    asked = {"q1": 0.25, "q3": 0.75} if method == "iqr" else {n: p for n, p in (("lo", lower), ("hi", upper)) if p is not None}
    if not asked:
        raise ValueError("a percentile rule needs lower or upper")
    values = rows.groupBy(KEY, "_x").agg(F.count(F.lit(1)).alias("_w"))
    found = weighted_quantiles(values, KEY, "_x", "_w", list(asked.values()), list(asked), few_keys=False)
    if method == "iqr":
        reach = F.lit(1.5 if k is None else float(k)) * (F.col("q3") - F.col("q1"))
        return found.select(KEY, (F.col("q1") - reach).alias(LOW), (F.col("q3") + reach).alias(HIGH))
    none = F.lit(None).cast("double")
    return found.select(KEY, (F.col("lo") if "lo" in asked else none).alias(LOW), (F.col("hi") if "hi" in asked else none).alias(HIGH))


def _bounded(df: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """Rows beside their group's bounds. How they are joined is left to Spark, which knows the bytes and splits a hot group."""
    return df.withColumn(KEY, _key(by)).join(bounds, KEY, "left").drop(KEY)


def cap_outliers_by(df: DataFrame, by: list[str], col: str, method: str = "percentile", **options) -> DataFrame:
    """``col`` moved to the nearer bound of its group where it lies outside; missing values (NULL, NaN) become NULL."""
    x = _value(df, col)
    # least and greatest pass over a NULL bound
    capped = F.greatest(F.least(x.cast("double"), F.col(HIGH)), F.col(LOW))
    kind = df.schema[col].dataType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else T.DoubleType()
    made = F.when(x.isNotNull(), capped.cast(kind)).alias(col)
    return _bounded(df, by, fit_group_bounds(df, by, col, method, **options)).select(*[made if c == col else quoted(c) for c in df.columns])


def flag_outliers_by(df: DataFrame, by: list[str], col: str, method: str = "iqr", out: str | None = None, **options) -> DataFrame:
    """Adds ``out`` (``<col>_outlier``): outside the bounds of its group; false for missing values and where no bound could be fitted."""
    x = _value(df, col).cast("double")
    outside = F.coalesce((x < F.col(LOW)) | (x > F.col(HIGH)), x < F.col(LOW), x > F.col(HIGH), F.lit(False))
    marked = _bounded(df, by, fit_group_bounds(df, by, col, method, **options))
    return marked.select(*[quoted(c) for c in df.columns], outside.alias(out or f"{col}_outlier"))


def drop_outliers_by(df: DataFrame, by: list[str], col: str, method: str = "iqr", **options) -> DataFrame:
    """Rows inside the bounds of their group, and rows whose value is missing."""
    mark = "_group_outlier"
    return flag_outliers_by(df, by, col, method, mark, **options).where(~F.col(mark)).drop(mark)
