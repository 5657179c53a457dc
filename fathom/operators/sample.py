"""A sample of exactly n rows that any partitioning of the table gives again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits of the hash by which rows are binned: 16^4 bins.
BIN_DIGITS = 4
# Up to so many rows a sample is one top-n (each task sends its own smallest n).
TOP_ROWS = 100_000


def seeded_hash(keys: list[str], seed: int) -> Column:
    """md5 of ``seed:key:key...``; a NULL key is a mark of its own."""
    parts = [F.coalesce(F.col("`" + k.replace("`", "``") + "`").cast("string"), F.lit("\x00")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(int(seed))), *parts).cast("binary"))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42, top_rows: int = TOP_ROWS) -> DataFrame:
    """``n`` rows (all, if there are fewer): those with the smallest seeded hash of ``keys``, which should identify a row.

    Up to ``top_rows`` this is a top-n, of which each task sends its own smallest n at most. Above, a map-side
    count per leading hash digits finds the bin in which the n-th row lies; rows of the bins before it stay where they
    are, and only that bin (a 65,536th of the rows) is ordered. Rows with equal keys have equal hashes: of them any may be cut.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if not keys:
        raise ValueError("keys must name the columns that identify a row")
    mark = "_sample_hash"
    while mark in df.columns:
        mark += "_"
    hashed = df.withColumn(mark, seeded_hash(keys, seed))
    if n <= top_rows:
        return hashed.orderBy(mark).limit(int(n)).drop(mark)
    digits = F.substring(mark, 1, BIN_DIGITS)
    counts = {r["b"]: r["c"] for r in hashed.groupBy(digits.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}   # at most 65,536 rows
    taken = 0
    for b in sorted(counts):
        if taken + counts[b] > n:
            before = hashed.where(digits < b)
            return before.unionAll(hashed.where(digits == b).orderBy(mark).limit(int(n - taken))).drop(mark)
        taken += counts[b]
    return df
