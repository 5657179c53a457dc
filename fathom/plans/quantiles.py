"""Exact quantiles with linear interpolation, computed as a distributed plan.

Matches the "linear" definition (pandas ``quantile``, DuckDB ``quantile_cont``): for n values
and probability p, h = (n - 1) p and q = v[floor h] + (h - floor h) (v[ceil h] - v[floor h]).

Input is a *weighted value table*: one row per distinct (key, value) with its multiplicity,
which the caller builds with a partial-aggregating ``groupBy``. Only the slices that hold a
target rank are ranked row by row (see :mod:`fathom.plans.ranks`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans import ranks


def weighted_quantiles(values: DataFrame, key: str, value: str, weight: str, probs: list[float],
                       names: list[str], num_slices: int | None = None, few_keys: bool = True) -> DataFrame:
    """One row per key with a double column per probability (named by ``names``).

    ``few_keys``: the keys are few by design (columns of a table), so what is kept per key and slice may be broadcast;
    otherwise it grows with the data and how it is joined is left to Spark.
    """
    tagged = ranks.sliced(values.select(key, value, weight).where(F.col(value).isNotNull()),
                          [key], [value], num_slices)
    return weighted_quantiles_tagged(tagged, key, value, weight, probs, names, few_keys)


def weighted_quantiles_tagged(tagged: DataFrame, key: str, value: str, weight: str, probs: list[float],
                              names: list[str], few_keys: bool = True) -> DataFrame:
    """As :func:`weighted_quantiles` on a table already cut by :func:`ranks.sliced`.

    The slices must be ordered by ``key`` first and ``value`` next (further order columns are
    allowed); rows with a NULL ``value`` are ignored.
    """
    tagged = tagged.where(F.col(value).isNotNull())
    offsets = ranks.slice_offsets(tagged, [key], weight)
    # Total weight per key in the same window pass as the offsets (one row per key and slice).
    offsets = offsets.withColumn("_n", F.sum("_slice_weight").over(Window.partitionBy(key)))

    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (offsets.where(F.col("_slice_start") == 0).select(key, "_n", F.posexplode(probs_arr).alias("_qi", "_p"))
               .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("_p"))
               .withColumn("_r", F.explode(F.array_distinct(F.array(
                   F.floor("_h").cast("bigint"), F.ceil("_h").cast("bigint"))))))
    # The slice holding each target rank: both sides are bounded by keys x slices.
    located = (targets.join(offsets.select(key, ranks.SLICE, "_slice_start", "_slice_weight"), [key])
               .where((F.col("_r") >= F.col("_slice_start"))
                      & (F.col("_r") < F.col("_slice_start") + F.col("_slice_weight")))
               .select(key, "_qi", "_h", "_r", ranks.SLICE))
    sent = F.broadcast if few_keys else (lambda t: t)
    subset = tagged.join(sent(located.select(key, ranks.SLICE)), [key, ranks.SLICE], "left_semi")
    ranked = ranks.with_running_weight(subset, offsets, [key], [value], weight, broadcast_offsets=few_keys)
    hits = (ranked.join(sent(located), [key, ranks.SLICE])
            .where((F.col("_r") >= F.col("_rank_start")) & (F.col("_r") < F.col("_rank_end"))))
    # One aggregate: the two neighbouring order statistics of every probability, then interpolate.
    aggs = []
    for i in range(len(probs)):
        mine = F.col("_qi") == i
        aggs += [F.min(F.when(mine, F.col(value))).cast("double").alias(f"_lo{i}"),
                 F.max(F.when(mine, F.col(value))).cast("double").alias(f"_hi{i}"),
                 F.max(F.when(mine, F.col("_h"))).alias(f"_h{i}")]
    per_key = hits.groupBy(key).agg(*aggs)
    return per_key.select(key, *[
        (F.col(f"_lo{i}") + (F.col(f"_h{i}") - F.floor(f"_h{i}")) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name)
        for i, name in enumerate(names)])


def column_quantiles(df: DataFrame, column: str, probs: list[float], names: list[str],
                     exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """One-row DataFrame of quantiles of one numeric column (NULLs and NaNs ignored)."""
    c = ranks.quoted(column)
    clean = df.select(c.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not exact:
        q = F.percentile_approx("_x", F.array(*[F.lit(float(p)) for p in probs]), accuracy)
        row = clean.agg(q.alias("_qs"))
        return row.select(*[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])
    values = clean.groupBy("_x").agg(F.count(F.lit(1)).alias("_w")).withColumn("_k", F.lit(0))
    return weighted_quantiles(values, "_k", "_x", "_w", probs, names).drop("_k")
