"""Global order statistics without a single-task window.

A window ``OVER (PARTITION BY key ORDER BY value)`` moves every distinct value of a key into
one task. At scale a key (one profiled column, one label-encoded column) can hold billions of
distinct values, so we rank in three bounded steps instead:

1. range-partition the (key, value) rows into P sorted slices and tag each row with its slice;
2. sum the weights of each (key, slice): at most keys x P rows, so that table is small and its
   size is known before it is broadcast;
3. a running sum inside each (key, slice) plus the offset of the slice gives the global rank.

The tagged table is checkpointed in the shared checkpoint folder so that a recomputation after
executor loss sees the same slice boundaries (range bounds come from a sample).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import reliable_checkpoint

SLICE = "_slice"
# Input bytes a slice should hold at most; more slices than the session's shuffle partitions are
# used as soon as the input needs them.
SLICE_BYTES = 128 << 20


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables ``df`` reads, from their statistics (no job)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)      # unknown sizes read as the largest number


def slice_count(size: int, shuffle_partitions: int) -> int | None:
    """None (the session's shuffle partitions, merged by adaptive execution) until the input needs more."""
    wanted = -(-size // SLICE_BYTES)
    return wanted if wanted > shuffle_partitions else None


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equality join in which NULL keys match each other, as they do in GROUP BY and PARTITION BY."""
    other = [c for c in right.columns if c not in keys]
    r = right.select(*[quoted(k).alias(f"_nsk{i}") for i, k in enumerate(keys)], *[quoted(c) for c in other])
    on = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"_nsk{i}")) for i, k in enumerate(keys)])
    return left.join(r, on, how).drop(*[f"_nsk{i}" for i in range(len(keys))])


def sliced(df: DataFrame, keys: list[str], order: list, num_slices: int | None = None) -> DataFrame:
    """Range-partition by ``keys + order`` and tag rows with their slice id (checkpointed).

    Without ``num_slices`` the number of slices follows the input: adaptive execution merges the
    session's shuffle partitions for a small table (merged ranges stay contiguous and in order,
    which is all the slice ids must guarantee), and a table of more than ``SLICE_BYTES`` a shuffle
    partition gets as many slices as its statistics ask for.
    """
    cols = [*[quoted(k) if isinstance(k, str) else k for k in keys], *[quoted(o) if isinstance(o, str) else o for o in order]]
    if num_slices is None:
        num_slices = slice_count(input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(int(num_slices), *cols) if num_slices else df.repartitionByRange(*cols)
    tagged = ranged.withColumn(SLICE, F.spark_partition_id())
    return reliable_checkpoint(tagged)


def slice_offsets(tagged: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    """(keys, _slice, _slice_weight, _slice_start): bounded by keys x slices rows."""
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    per = tagged.groupBy(*keys, SLICE).agg(w.cast("bigint").alias("_slice_weight"))
    running = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("_slice_start", F.sum("_slice_weight").over(running) - F.col("_slice_weight"))


def with_running_weight(tagged: DataFrame, offsets: DataFrame, keys: list[str], order: list,
                        weight: str | None, broadcast_offsets: bool = True) -> DataFrame:
    """Add ``_rank_start``/``_rank_end``: 0-based global cumulative weight before/after each row.

    ``offsets`` has one row per (key, slice); broadcast it only when the number of keys is
    bounded (columns of a profile, one dictionary), otherwise it is joined by shuffle.
    """
    w = F.col(weight) if weight else F.lit(1)
    local = (Window.partitionBy(*keys, SLICE).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    off = offsets.select(*keys, SLICE, "_slice_start")
    joined = join_null_safe(tagged, F.broadcast(off) if broadcast_offsets else off, [*keys, SLICE], "inner")
    end = F.col("_slice_start") + F.sum(w).over(local)
    return (joined.withColumn("_rank_end", end.cast("bigint"))
            .withColumn("_rank_start", (F.col("_rank_end") - w).cast("bigint"))
            .drop("_slice_start"))


def dense_index(df: DataFrame, column: str, out: str, num_slices: int | None = None) -> DataFrame:
    """Dictionary (value, 0-based index in sorted order) of the distinct non-null values of ``column``."""
    distinct = df.select(quoted(column).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    tagged = sliced(distinct.withColumn("_k", F.lit(0)), ["_k"], ["_v"], num_slices)
    offsets = slice_offsets(tagged, ["_k"], None)
    ranked = with_running_weight(tagged, offsets, ["_k"], ["_v"], None)
    return ranked.select(F.col("_v").alias(column), F.col("_rank_start").alias(out))
