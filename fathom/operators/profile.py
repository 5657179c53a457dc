"""Column profile of a whole table, one output row per column.

The caller names the statistics wanted (``stats``), and only the passes they need are planned:

* ``schema`` - type, flags and suggested operations: from the schema, no job.
* ``scalar`` - rows, nulls, min, max, mean, std-dev, skewness, largest magnitude, longest text, dates: one
  aggregate by column position over the long form, combined map-side (a row per column and task
  is shuffled, never a cell).
* ``values`` - distinct count, smallest and most frequent values: ``groupBy(position, value)`` with map-side
  combine, so a hot value costs one row per map task; top values and smallest values use
  ``row_number() <= k``, a partial window-group limit before the shuffle.
* ``percentiles`` - numeric columns only, without text (:mod:`fathom.plans.quantiles`, no one-task window).

With ``exact=False`` distinct counts, percentiles and frequent values come from sketches in the scalar pass, so one row per
column and task is shuffled however many values there are. The sketch of frequent values is exact below ``FREQUENT`` distinct
values; in a column of more it may hold none at all (a key: all its values are equally rare), so such a column's values are counted
in a pass of their own, combined map-side. The smallest values are exact: a bound on them from the first rows
keeps nearly all others out of the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import types as vt
from fathom.functions.stats import nan_to_null, sample_skewness
from fathom.plans import ranks
from fathom.plans.quantiles import weighted_quantiles_tagged

# Suggested operations per descriptive type and warning thresholds, as named
# by the column metadata contract.
NUMERIC_OPERATIONS = ["normalize", "scale", "log_transform", "binning"]
STRING_OPERATIONS = ["one_hot_encode", "label_encode", "text_processing", "string_cleaning", "regex_extract"]
DATE_OPERATIONS = ["extract_year", "extract_month", "time_delta", "day_of_week", "time_binning"]
CATEGORICAL_LIMIT = 20          # string column with fewer distinct values is categorical
LOW_CARDINALITY_LIMIT = 5       # fewer distinct values than this raises a warning
LARGE_VALUE_LIMIT = 1e6         # max |x| above this raises a warning
SKEW_LIMIT = 2.0                # skewness above this raises a warning
EXAMPLE_COUNT = 3
DISTINCT_VALUE_COUNT = 10
TOP_VALUE_COUNT = 5
STATS = ("schema", "scalar", "values", "percentiles")
BOUND_ROWS = 1000               # rows that give the approximate mode its bound on the smallest values
FREQUENT = 10_000               # values that the sketch of frequent values holds a column
SURE = 0.9                      # share of FREQUENT up to which an estimate of the distinct values is trusted to be below it
TIED_ITEMS = 50                 # candidates taken from it, so that equal counts are put in order of the value
NAMED_LENGTH = 256              # longer values are named by their beginning and a hash where they are counted by sketch

PROFILE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("is_numeric", T.BooleanType()),
    T.StructField("is_temporal", T.BooleanType()),
    T.StructField("is_categorical", T.BooleanType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std_dev", T.DoubleType()),
    T.StructField("p25", T.DoubleType()),
    T.StructField("p50", T.DoubleType()),
    T.StructField("p75", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("max_abs", T.DoubleType()),
    T.StructField("max_length", T.LongType()),
    T.StructField("min_date", T.TimestampNTZType()),
    T.StructField("max_date", T.TimestampNTZType()),
    T.StructField("time_span_seconds", T.LongType()),
    T.StructField("examples", T.ArrayType(T.StringType())),
    T.StructField("distinct_values", T.ArrayType(T.StringType())),
    T.StructField("value_counts", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("count", T.LongType())]))),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("suggested_operations", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class _Col:
    pos: int
    name: str
    dtype: T.DataType

    @property
    def ref(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def kind(self) -> str:
        return vt.descriptive_type(self.dtype)


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip surrounding spaces from column names and drop columns whose name is blank."""
    keep = [F.col(f"`{c}`").alias(c.strip()) for c in df.columns if c.strip()]
    return df.select(*keep)


def _plain(c: _Col) -> Column:
    """The column's value; a negative zero reads as zero, as it does in comparisons."""
    return F.when(c.ref == 0, F.lit(0).cast(c.dtype)).otherwise(c.ref) if vt.is_floating(c.dtype) else c.ref


def _long(df: DataFrame, cols: list[_Col], text: bool) -> DataFrame:
    """One row per (input row, column): position, whether the value is present, and the value in the typed slots
    that apply (x numeric, t temporal, len string length; v its text form if ``text``).

    Aggregating this long form by position keeps the generated code the same size for a
    2-column and a 2,000-column table; the wide form (one aggregate per column and statistic)
    grows with the width and stops compiling for wide tables.
    """
    structs = []
    for c in cols:
        value = _plain(c)
        fields = [
            F.lit(c.pos).alias("position"),
            c.ref.isNotNull().alias("present"),
            (value.cast("double") if vt.is_numeric(c.dtype) else F.lit(None).cast("double")).alias("x"),
            (value.cast("timestamp_ntz") if vt.is_temporal(c.dtype) else F.lit(None).cast("timestamp_ntz")).alias("t"),
            (F.char_length(c.ref) if vt.is_string(c.dtype) else F.lit(None).cast("int")).alias("len"),
        ]
        if text:
            fields.append((value.cast("string") if vt.is_scalar(c.dtype) else F.lit(None).cast("string")).alias("v"))
        structs.append(F.struct(*fields))
    return df.select(F.inline(F.array(*structs)))


def value_name(v: Column) -> Column:
    """What a value is counted under in a sketch: itself, or if it is long its beginning and a hash (so a sketch's size is bounded)."""
    return F.when(F.char_length(v) <= NAMED_LENGTH, v).otherwise(F.concat(F.left(v, F.lit(64)), F.lit("... "), F.sha1(v.cast("binary"))))


def ranked_items(sketch: Column) -> Column:
    """The most frequent (value, count) of a sketch of frequent values; equal counts by value. Null without a sketch."""
    items = F.call_function("approx_top_k_estimate", sketch, F.lit(TIED_ITEMS))
    order = F.array_sort(F.transform(items, lambda i: F.struct((-i["count"]).alias("o"), i["item"].alias("value"), i["count"].alias("count"))))
    return F.when(sketch.isNotNull(), F.transform(F.slice(order, 1, TOP_VALUE_COUNT), lambda i: F.struct(i["value"].alias("value"), i["count"].alias("count"))))


def _scalar_pass(long: DataFrame, sketches: bool, accuracy: int, counted: list[int]) -> DataFrame:
    """Per-column statistics in one aggregate by column position (one row per column and task is shuffled).

    ``counted``: positions of the columns whose frequent values are wanted.
    """
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_if("present").cast("bigint").alias("non_null"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std_dev"), F.skewness("x").alias("_g1"), F.count("x").alias("_nx"),
        F.max(F.abs("x")).alias("max_abs"), F.max("len").cast("bigint").alias("_maxlen"),
        F.min("t").alias("min_date"), F.max("t").alias("max_date"),
    ]
    if sketches:
        q = F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        aggs += [F.approx_count_distinct("v", 0.01).cast("bigint").alias("unique_count"), q.alias("_q")]
        if counted:
            long = long.withColumn("name", F.when(F.col("position").isin(*counted), value_name(F.col("v"))))
            aggs.append(F.expr(f"approx_top_k_accumulate(name, {FREQUENT}) FILTER (WHERE name IS NOT NULL)").alias("_frequent"))
    out = long.groupBy("position").agg(*aggs).withColumn("skewness", sample_skewness(F.col("_g1"), F.col("_nx"))).drop("_g1", "_nx")
    if sketches and counted:
        out = out.withColumn("value_counts", ranked_items(F.col("_frequent"))).drop("_frequent")
    if sketches:
        out = out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])]).drop("_q")
    return out


def _value_table(long: DataFrame) -> DataFrame:
    """(position, v, x, cnt): distinct present values per column with their counts."""
    return long.where(F.col("v").isNotNull()).groupBy("position", "v", "x").agg(F.count(F.lit(1)).alias("cnt"))


def _smallest(long: DataFrame, head: DataFrame) -> DataFrame:
    """The smallest distinct values per column, exactly. ``head``: the long form of a few rows.

    The k-th smallest distinct value of any rows is an upper bound on that of all; only values up
    to it are made distinct. Columns with fewer than k values in ``head`` have no bound.
    """
    order = [F.asc_nulls_last("x"), F.asc("v")]
    seen = head.where(F.col("v").isNotNull()).select("position", "v", "x").distinct()
    bound = (seen.withColumn("_rn", F.row_number().over(Window.partitionBy("position").orderBy(*order)))
             .where(F.col("_rn") == DISTINCT_VALUE_COUNT).select("position", F.col("v").alias("_bv"), F.col("x").alias("_bx")))
    low = long.where(F.col("v").isNotNull()).join(F.broadcast(bound), "position", "left")      # one row per column
    low = low.where(F.when(F.col("_bv").isNull(), True).when(F.col("_bx").isNotNull(), F.col("x") <= F.col("_bx")).otherwise(F.col("v") <= F.col("_bv")))
    return _first_k(low.select("position", "v", "x").distinct(), DISTINCT_VALUE_COUNT, order, "_smallest", False)


def _first_k(values: DataFrame, k: int, order: list[Column], out: str, with_counts: bool) -> DataFrame:
    w = Window.partitionBy("position").orderBy(*order)
    top = values.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    item = F.struct("_rn", "v", "cnt") if with_counts else F.struct("_rn", "v")
    arr = F.array_sort(F.collect_list(item))
    if with_counts:
        shaped = F.transform(arr, lambda s: F.struct(s["v"].alias("value"), s["cnt"].alias("count")))
    else:
        shaped = F.transform(arr, lambda s: s["v"])
    return top.groupBy("position").agg(shaped.alias(out))


def profile(df: DataFrame, table_name: str = "t", exact: bool = True, stats: list[str] | tuple[str, ...] | None = None,
            columns: list[str] | None = None, accuracy: int = 10000, num_slices: int | None = None,
            sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Profile the columns of ``df``; see :data:`PROFILE_SCHEMA` for the output.

    ``stats`` names the groups of statistics to compute (:data:`STATS`, all by default); fields of other
    groups are NULL. ``columns`` limits the profile to some columns. By default the whole table is profiled;
    ``sample_fraction`` profiles a seeded Bernoulli sample drawn inside every partition, which
    stays distributed at any size.
    """
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if sample_fraction is not None:
        df = df.sample(withReplacement=False, fraction=float(sample_fraction), seed=seed)
    return _profile_many([(table_name, df)], exact, stats, accuracy, num_slices)


def _profile_many(tables: list[tuple[str, DataFrame]], exact: bool, stats: list[str] | tuple[str, ...] | None, accuracy: int,
                  num_slices: int | None) -> DataFrame:
    """Profiles of several tables as ONE plan: columns get global ids across tables and the per-table long
    forms are unioned, so one set of stages serves every table."""
    stats = tuple(stats or STATS)
    if unknown := set(stats) - set(STATS):
        raise ValueError(f"unknown statistics {sorted(unknown)}; choose from {STATS}")
    frames, cols, meta_rows, spark = [], [], [], None
    for name, df in tables:
        df = nan_to_null(clean_column_names(df))
        spark = df.sparkSession
        mine = [_Col(len(cols) + i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
        meta_rows += [(c.pos, name, i, c.name, c.kind, vt.is_numeric(c.dtype), vt.is_temporal(c.dtype),
                       vt.is_string(c.dtype)) for i, c in enumerate(mine)]
        frames.append((df, mine))
        cols += mine
    if not cols:
        return spark.createDataFrame([], PROFILE_SCHEMA)

    def long(text: bool, wanted=lambda c: True, head: int | None = None) -> DataFrame | None:
        out = None
        for df, mine in frames:
            if keep := [c for c in mine if wanted(c)]:
                part = _long(df.limit(head) if head else df, keep, text)
                out = part if out is None else out.unionByName(part)
        return out

    def scalar_kind(c: _Col) -> bool:
        return vt.is_scalar(c.dtype)

    def numeric(c: _Col) -> bool:
        return vt.is_numeric(c.dtype)

    # "position" below is the global column id; the per-table position is kept in meta. Every part is one
    # row per column. Every column gets a row, even when a table is empty (then an aggregate has no groups).
    out = spark.createDataFrame(meta_rows, "position int, table_name string, column_pos int, column_name string, "
                                           "type string, is_numeric boolean, is_temporal boolean, _is_string boolean")
    parts = []
    sketches = not exact and ("values" in stats or "percentiles" in stats)
    if "scalar" in stats or sketches:
        counted = [c.pos for c in cols if "values" in stats and (vt.is_string(c.dtype) or isinstance(c.dtype, T.BooleanType))]
        scalars = _scalar_pass(long(sketches), sketches, accuracy, counted)
        if sketches and counted:
            # one aggregate over the columns alone; a row per column reaches the driver
            distinct = long(True, lambda c: c.pos in counted).groupBy("position").agg(F.approx_count_distinct("v", 0.01).alias("n"))
            many = {r[0] for r in distinct.where(F.col("n") > SURE * FREQUENT).collect()}
            if many:
                names = _value_table(long(True, lambda c: c.pos in many).select("position", value_name(F.col("v")).alias("v"), "x"))
                top = _first_k(names, TOP_VALUE_COUNT, [F.desc("cnt"), F.asc("v")], "_counted", True)
                scalars = scalars.join(F.broadcast(top), "position", "left").withColumn("value_counts", F.coalesce("_counted", "value_counts")).drop("_counted")
        parts.append(scalars)
    if "values" in stats and any(map(scalar_kind, cols)):
        if exact:
            values = _value_table(long(True, scalar_kind))
            # several branches read the value table, so it is written once; by hash, as ranges hold equal numbers of rows
            # and those of a column of long texts would be far larger than the others
            values = ranks.reliable_checkpoint(values)
            parts.append(values.groupBy("position").agg(F.count(F.lit(1)).alias("unique_count")))
            parts.append(_first_k(values, TOP_VALUE_COUNT, [F.desc("cnt"), F.asc_nulls_last("x"), F.asc("v")], "value_counts", True))
            parts.append(_first_k(values, DISTINCT_VALUE_COUNT, [F.asc_nulls_last("x"), F.asc("v")], "_smallest", False))
            if "percentiles" in stats and any(map(numeric, cols)):
                # percentile ranks need stable slices of the numbers alone
                numbers = ranks.sliced(values.where(F.col("x").isNotNull()).select("position", "x", "cnt"), ["position"], ["x"], num_slices)
                parts.append(weighted_quantiles_tagged(numbers, "position", "x", "cnt", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]))
        else:
            parts.append(_smallest(long(True, scalar_kind), long(True, scalar_kind, BOUND_ROWS)))
    elif "percentiles" in stats and exact and any(map(numeric, cols)):
        numbers = long(False, numeric).where(F.col("x").isNotNull()).groupBy("position", "x").agg(F.count(F.lit(1)).alias("cnt"))
        numbers = ranks.sliced(numbers, ["position"], ["x"], num_slices)
        parts.append(weighted_quantiles_tagged(numbers, "position", "x", "cnt", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]))
    for part in parts:
        out = out.join(F.broadcast(part), "position", "left")      # one row per column on both sides
    kinds = {f.name: f.dataType for f in PROFILE_SCHEMA.fields} | {"non_null": T.LongType(), "_maxlen": T.LongType(), "_smallest": T.ArrayType(T.StringType())}
    for name in ("rows", "non_null", "min", "max", "mean", "std_dev", "skewness", "max_abs", "_maxlen", "min_date", "max_date", "unique_count",
                 "value_counts", "_smallest", "p25", "p50", "p75"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kinds[name]))
    return _assemble(out.drop("position").withColumnRenamed("column_pos", "position"), stats)


def _assemble(out: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    scalar, values = F.lit("scalar" in stats), F.lit("values" in stats)
    rows, nn = F.coalesce(F.col("rows"), F.lit(0).cast("bigint")), F.coalesce(F.col("non_null"), F.lit(0).cast("bigint"))
    rows = F.when(scalar, rows)
    null_count = (rows - nn).cast("bigint")
    no_values = F.col("type").isin(vt.MIXED, vt.EMPTY)
    unique = F.when(values & ~no_values, F.coalesce(F.col("unique_count"), F.lit(0)))
    pct = F.try_divide(null_count.cast("double") * F.lit(100.0), rows.cast("double"))
    null_pct = F.round(pct, 1)
    none = F.array().cast("array<string>")
    examples = F.when(values, F.when(no_values, none).otherwise(F.coalesce(F.slice(F.col("_smallest"), 1, EXAMPLE_COUNT), none)))
    is_string = F.col("_is_string")
    null_msg = F.format_string("%d null values (%.1f%%)", null_count, pct)
    warnings = F.array_compact(F.array(
        F.when(null_count > 0, null_msg),
        F.when(unique == 1, F.lit("Single value column"))
         .when(unique < LOW_CARDINALITY_LIMIT, F.format_string("Low cardinality (only %d values)", unique)),
        F.when(F.col("is_numeric") & (F.col("max_abs") > LARGE_VALUE_LIMIT), F.lit("Large values - consider scaling")),
        F.when(F.col("is_numeric") & (F.col("skewness") > SKEW_LIMIT), F.lit("Highly skewed distribution")),
    ))
    suggestions = (F.when(F.col("is_numeric"), F.array(*map(F.lit, NUMERIC_OPERATIONS)))
                   .when(is_string, F.array(*map(F.lit, STRING_OPERATIONS)))
                   .when(F.col("is_temporal"), F.array(*map(F.lit, DATE_OPERATIONS)))
                   .otherwise(F.array().cast("array<string>")))
    return out.select(
        "table_name",
        F.col("position").cast("int"), "column_name", "type",
        rows.alias("rows"), null_count.alias("null_count"), null_pct.alias("null_pct"),
        unique.cast("bigint").alias("unique_count"),
        "is_numeric", "is_temporal",
        (is_string & (unique < CATEGORICAL_LIMIT)).alias("is_categorical"),
        "min", "max", "mean", "std_dev",
        "p25", "p50", "p75",
        "skewness", "max_abs", F.when(is_string, F.col("_maxlen")).alias("max_length"), "min_date", "max_date",
        F.timestamp_diff("SECOND", F.col("min_date"), F.col("max_date")).cast("bigint").alias("time_span_seconds"),
        examples.alias("examples"),
        F.when(values & is_string, F.coalesce(F.col("_smallest"), none)).alias("distinct_values"),
        F.when(is_string | (F.col("type") == vt.BOOLEAN), F.col("value_counts")).alias("value_counts"),
        warnings.alias("warnings"), suggestions.alias("suggested_operations"),
    )


def profile_tables(tables: dict[str, DataFrame], exact: bool = True, errors: list | None = None,
                   stats: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """Profiles of several tables in one DataFrame (one row per table and column), computed
    as one plan. A table whose schema cannot be read (for example an unreadable source) is
    skipped, like a sheet that fails to load; ``(name, message)`` of each skipped table is
    appended to ``errors`` when a list is given.
    """
    usable, skipped = [], []
    for name, df in tables.items():
        try:
            df.schema  # noqa: B018 - resolves the source; fails for unreadable inputs
            usable.append((name, df))
        except Exception as exc:  # noqa: BLE001 - one bad table must not stop the others
            skipped.append((name, str(exc)))
    if errors is not None:
        errors.extend(skipped)
    if not usable:
        raise ValueError(f"no table could be profiled: {skipped}")
    return _profile_many(usable, exact, stats, 10000, None)


def table_counts(df: DataFrame, table_name: str = "t") -> DataFrame:
    """Row and column count of a table."""
    df = clean_column_names(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table_name).alias("table_name"), F.col("rows").cast("bigint"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"))
