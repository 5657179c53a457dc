"""Ad-hoc queries over named tables, result shaping, summaries and an as-of join."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.plans.ordered import last_non_null_by_key



def run_query(spark: SparkSession, tables: dict[str, DataFrame],
              query: str | Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """Run SQL over ``tables`` (registered as temp views) or call ``query(tables)``.

    Parse and analysis errors propagate as Spark's own exceptions; a callable that does not
    return a DataFrame raises ``TypeError``.
    """
    if callable(query):
        result = query(tables)
        if not isinstance(result, DataFrame):
            raise TypeError(f"query returned {type(result).__name__}, not a DataFrame")
        return result
    # The views exist only while the query is analysed; the caller's own views come back after it.
    before = {name: spark.table(name) if spark.catalog.tableExists(name) else None for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)
    finally:
        for name, df in before.items():
            spark.catalog.dropTempView(name)
            if df is not None and not spark.catalog.tableExists(name):
                df.createOrReplaceTempView(name)


class Records(list):
    """Result rows as dicts; ``truncated`` tells whether the result has more."""
    truncated = False


def result_records(df: DataFrame, limit: int) -> Records:
    """The first ``limit`` rows as dicts, and whether there are more (``.truncated``).

    Only this bounded slice reaches the driver. There is no "everything" option: whole results are
    written with a sink, not collected.
    """
    if limit is None or int(limit) < 0:
        raise ValueError("result_records needs a row limit; write whole results with a sink")
    rows = df.limit(int(limit) + 1).collect()
    out = Records(r.asDict(recursive=True) for r in rows[:int(limit)])
    out.truncated = len(rows) > int(limit)
    return out


def result_column(df: DataFrame, limit: int, column: str | None = None) -> list:
    """One column (the first by default) of the first ``limit`` rows as a list."""
    column = column or df.columns[0]
    return [r[0] for r in df.select(F.col(f"`{column}`")).limit(int(limit)).collect()]


def result_dict(df: DataFrame, key: str, value: str, limit: int) -> dict:
    """{key: value} of the first ``limit`` rows (later rows win)."""
    return {r[0]: r[1] for r in df.select(F.col(f"`{key}`"), F.col(f"`{value}`")).limit(int(limit)).collect()}


def result_scalar(df: DataFrame):
    """The single value of a one-row, one-column result; None for no row. More than one row is an error."""
    if len(df.columns) != 1:
        raise ValueError(f"a scalar result has one column, not {len(df.columns)}")
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a scalar result has one row")
    return rows[0][0] if rows else None


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Top-k rows by ``order`` (planned as TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows of each group; ``row_number() <= k`` gets a partial group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Statistical summary in long form: (column_name, statistic, value) per numeric column."""
    from fathom.operators.profile import profile
    p = profile(df, exact=exact, stats=["scalar", "values", "percentiles"]).where("is_numeric")
    stats = ["rows", "null_count", "unique_count", "mean", "std_dev", "min", "p25", "p50", "p75", "max"]
    return p.select("column_name", F.inline(F.array(*[
        F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in stats])))


def describe_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Summary of the columns of any kind as text, in long form: (column_name, type, statistic, value).

    Every column has rows, null_count and unique_count; numbers have the statistics of :func:`summary`; texts and booleans have top, top_count
    (their most frequent value, ties by value) and max_length; times have first and last. A statistic without a value is NULL.
    """
    from fathom.operators.profile import profile
    p = profile(df, exact=exact, stats=["scalar", "values", "percentiles"])
    top = F.try_element_at("value_counts", F.lit(1))
    always = {c: F.col(c) for c in ("rows", "null_count", "unique_count")}
    by_kind = {
        "is_numeric": {c: F.col(c) for c in ("mean", "std_dev", "min", "p25", "p50", "p75", "max")},
        "is_temporal": {"first": F.col("min_date"), "last": F.col("max_date")},
        "NOT is_numeric AND NOT is_temporal": {"top": top["value"], "top_count": top["count"], "max_length": F.col("max_length")}}

    def entries(of: dict) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("statistic"), c.cast("string").alias("value")) for n, c in of.items()])
    picked = F.lit(None)
    for kind, of in by_kind.items():
        picked = F.when(F.expr(kind), entries(of)).otherwise(picked)
    return p.select("column_name", "type", F.inline(F.concat(entries(always), F.coalesce(picked, F.array().cast("array<struct<statistic:string,value:string>>")))))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              right_cols: list[str], strict: bool = False, right_tiebreak: str | None = None) -> DataFrame:
    """Each left row gets ``right_cols`` of the latest right row of the same key at or before
    its time (before it when ``strict``); NULL when none exists. Left rows are all kept; as in an SQL
    join a NULL key matches nothing.

    Planned as a union of both sides and ``last(..., ignorenulls)`` over the key ordered by time,
    right rows placed before left rows of equal time unless ``strict``. Among right rows of
    equal time the one with the largest ``right_tiebreak`` wins (else an arbitrary one).
    """
    side_right = 1 if strict else 0
    side_left = 0 if strict else 1
    lcols = left.columns
    l = left.select(*[F.col(f"`{c}`") for c in lcols],
                    F.col(f"`{left_on}`").alias("_t"), F.lit(side_left).alias("_side"),
                    F.lit(None).cast(right.schema[right_tiebreak].dataType if right_tiebreak else "int").alias("_o"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in right_cols])
    r_other = [c for c in lcols if c not in by]
    r = right.select(*[F.col(f"`{b}`") for b in by],
                     *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in r_other],
                     F.col(f"`{right_on}`").alias("_t"), F.lit(side_right).alias("_side"),
                     (F.col(f"`{right_tiebreak}`") if right_tiebreak else F.lit(None).cast("int")).alias("_o"),
                     *[F.col(f"`{c}`").alias(f"_r_{c}") for c in right_cols])
    for b in by:
        r = r.where(F.col(f"`{b}`").isNotNull())
    both = l.unionByName(r.select(*l.columns))
    # last(..., ignorenulls) per key over range slices of (key, time): no key-sized task.
    filled = last_non_null_by_key(both, list(by), ["_t", "_side", "_o"], [f"_r_{c}" for c in right_cols],
                                  prefix="_f_")
    filled = filled.select("*", *[F.col(f"_f__r_{c}").alias(f"_f_{c}") for c in right_cols])
    return filled.where(F.col("_side") == side_left).select(
        *[F.col(f"`{c}`") for c in lcols], *[F.col(f"_f_{c}").alias(c) for c in right_cols])
