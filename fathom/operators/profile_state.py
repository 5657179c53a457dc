"""A column profile that grows with its table: one small state row per column and batch, which merges.

Profiling the whole table again after each load reads everything. Here ``profile_state`` reduces a batch to one row per
column: exact counts, extremes, smallest values and centred moments, and three sketches of bounded size - distinct values (HLL),
quantiles (KLL) and frequent values. ``merge_states`` combines states of any batches, in any order or tree, into states of the same
form; ``state_profile`` reads the profile off them. ``add_to_store`` keeps states in a Parquet table, a folder per batch, so a
profile of all batches reads a few rows a batch and never the data again.

Exact after any merges (moments to rounding): rows, null_count, min, max, mean, std_dev, skewness, max_abs, max_length, dates, examples,
distinct_values. Within a bound: unique_count (relative standard error 0.83 / 2 ** (LG_K / 2), 1.3 %), p25, p50, p75 (rank error
1.4 % at KLL_K, with probability 0.99), value_counts (no count is off by more than ``count_error``; exact below FREQUENT distinct values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import types as vt
from fathom.functions.stats import nan_to_null, sample_skewness
from fathom.operators import profile as P

LG_K = 12
KLL_K = 200
FREQUENT = P.FREQUENT

KEYS = ["table_name", "column_name"]


def profile_state(df: DataFrame, table_name: str = "t") -> DataFrame:
    """The state of a batch, one row per column (also of an empty batch). Nothing but a row per column and task is shuffled."""
    df = nan_to_null(P.clean_column_names(df))
    spark = df.sparkSession
    cols = [P._Col(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    meta = spark.createDataFrame([(table_name, c.name, c.pos, c.kind, vt.is_numeric(c.dtype), vt.is_temporal(c.dtype), vt.is_string(c.dtype)) for c in cols],
                                 "table_name string, column_name string, position int, type string, is_numeric boolean, is_temporal boolean, is_string boolean")
    if not cols:
        return _typed(meta)
    long = P._long(df, cols, True).withColumn("name", P.value_name(F.col("v")))
    x, n = F.col("x"), F.count("x")
    state = long.groupBy("position").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("present").alias("non_null"), n.alias("n"), F.avg("x").alias("mean"),
        (F.var_pop("x") * n).alias("m2"), (F.skewness("x") * F.pow(F.var_pop("x"), F.lit(1.5)) * n).alias("m3"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.max(F.abs(x)).alias("max_abs"), F.max("len").cast("long").alias("max_length"),
        F.min("t").alias("min_date"), F.max("t").alias("max_date"),
        F.hll_sketch_agg("v", F.lit(LG_K)).alias("distinct"), F.kll_sketch_agg_double("x", F.lit(KLL_K)).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(name, {FREQUENT}) FILTER (WHERE name IS NOT NULL)").alias("frequent"))
    smallest = P._smallest(long, P._long(df.limit(P.BOUND_ROWS), cols, True))
    out = meta.join(F.broadcast(state), "position", "left").join(F.broadcast(smallest), "position", "left")     # one row per column each
    return _typed(out.withColumnRenamed("_smallest", "smallest"))


_STATE = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()), T.StructField("position", T.IntegerType()),
    T.StructField("type", T.StringType()), *[T.StructField(c, T.BooleanType()) for c in ("is_numeric", "is_temporal", "is_string")],
    *[T.StructField(c, T.LongType()) for c in ("rows", "non_null", "n")], *[T.StructField(c, T.DoubleType()) for c in ("mean", "m2", "m3", "min", "max", "max_abs")],
    T.StructField("max_length", T.LongType()), T.StructField("min_date", T.TimestampNTZType()), T.StructField("max_date", T.TimestampNTZType()),
    T.StructField("distinct", T.BinaryType()), T.StructField("quantiles", T.BinaryType()),
    T.StructField("frequent", T.StructType([T.StructField("sketch", T.BinaryType()), T.StructField("maxItemsTracked", T.IntegerType()),
                                            T.StructField("itemDataType", T.StringType()), T.StructField("itemDataTypeDDL", T.StringType())])),
    T.StructField("smallest", T.ArrayType(T.StringType()))])


def _typed(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _STATE.fields])


def merge_states(states: DataFrame) -> DataFrame:
    """One state per (table, column) from any number of them: the state of all their rows together.

    A column whose batches disagree on its type is of type 'mixed' and keeps its counts; one that a batch lacks counts
    only the rows of the batches that have it. No states give no rows.
    """
    states = _typed(states)
    weight = F.coalesce("n", F.lit(0)).cast("double")
    # moments around the common mean: each part brings its own, shifted
    centre = states.groupBy(*KEYS).agg((F.sum(F.col("mean") * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("_c"))
    moved = states.join(F.broadcast(centre), KEYS).withColumn("_d", F.col("mean") - F.col("_c"))       # one row per column
    m2, m3, d = F.coalesce("m2", F.lit(0.0)), F.coalesce(F.nanvl("m3", F.lit(0.0)), F.lit(0.0)), F.col("_d")
    first = F.struct("position", "type", "is_numeric", "is_temporal", "is_string")
    merged = moved.groupBy(*KEYS).agg(
        F.min(first).alias("_f"), F.count_distinct("type").alias("_types"), F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.sum("n").alias("n"),
        F.first("_c").alias("mean"), F.sum(m2 + weight * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + weight * d * d * d).alias("m3"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("max_abs").alias("max_abs"), F.max("max_length").alias("max_length"),
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    # an aggregate of its own: Spark cannot pass on a combination that has met no sketch yet
    frequent = states.where("frequent.sketch IS NOT NULL").groupBy(*KEYS).agg(F.expr(f"approx_top_k_combine(frequent, {FREQUENT})").alias("frequent"))
    least = states.select(*KEYS, F.col("is_numeric").alias("_num"), F.explode("smallest").alias("v")).distinct()
    order = Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last(F.when(F.col("_num"), F.expr("try_cast(v AS double)"))), F.asc("v"))
    least = least.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= P.DISTINCT_VALUE_COUNT)
    least = least.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "v"))), lambda s: s["v"]).alias("smallest"))
    one = F.col("_types") <= 1
    flags = {c: F.when(one, F.col(f"_f.{c}")).otherwise(F.lit(False)) for c in ("is_numeric", "is_temporal", "is_string")}
    out = merged.join(F.broadcast(least), KEYS, "left").join(frequent, KEYS, "left").withColumns(
        {"position": F.col("_f.position"), "type": F.when(one, F.col("_f.type")).otherwise(F.lit(vt.MIXED)), **flags})
    return _typed(out)


def count_error(rows: Column) -> Column:
    """How far a count in value_counts may be off for a column of so many non-null rows, however the batches were cut.

    The sketch holds 2 ** k slots, the first power that has a third more than FREQUENT, and errs by 3.5 rows in as many.
    """
    slots = 1 << (-(-FREQUENT * 4 // 3) - 1).bit_length()
    return F.ceil(rows * F.lit(3.5 / slots)).cast("long")


def state_profile(states: DataFrame) -> DataFrame:
    """The profile (PROFILE_SCHEMA) of each (table, column), from its merged states, and ``count_error``."""
    s = merge_states(states)
    n, variance = F.col("n").cast("double"), F.nullif(F.col("m2"), F.lit(0.0))
    empty = F.coalesce(F.col("n"), F.lit(0)) == 0
    quantile = {p: F.when(~empty, F.expr(f"kll_sketch_get_quantile_double(quantiles, {q}D)")) for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    out = s.withColumns({
        "std_dev": F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))),
        "skewness": sample_skewness(F.sqrt(n) * F.col("m3") / F.pow(variance, F.lit(1.5)), F.col("n")),
        "unique_count": F.hll_sketch_estimate("distinct"), "value_counts": P.ranked_items(F.col("frequent")), **quantile,
    })
    out = out.withColumns({"_maxlen": F.col("max_length"), "_smallest": F.col("smallest"), "_is_string": F.col("is_string"),
                           "mean": F.when(~empty, F.col("mean"))})
    seen = out.select(*KEYS, "non_null")
    return P._assemble(out, P.STATS).join(seen, KEYS).withColumn("count_error", count_error(F.col("non_null"))).drop("non_null")


def add_to_store(states: DataFrame, path: str, batch: str) -> None:
    """Write a batch's states to its folder of the store; the same batch written again replaces itself, other batches stay."""
    if not batch or any(c in batch for c in "/\\="):
        raise ValueError("a batch needs a name without /, \\ and =")
    _typed(states).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")      # a row per column


def read_store(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """All stored states (of the named batches) with their ``batch``."""
    found = spark.read.option("basePath", path).schema(T.StructType([*_STATE.fields, T.StructField("batch", T.StringType())])).parquet(path)
    return found if batches is None else found.where(F.col("batch").isin(*batches))
