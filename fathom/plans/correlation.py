"""Correlation matrices over any number of columns: Pearson by one Gram-matrix aggregate, Spearman by distributed ranks.

A pair's coefficient needs six sums over the rows in which both values are present. With X the values (0 where
missing) and M the presence marks of a batch, they are the entries of M'M, X'M, (X*X)'M and X'X, so a task turns
its rows into four d x d matrices and emits d rows of them; the merge is a plain sum. Values are centred by the
columns' means first (one aggregate), so that the sums do not cancel.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans import ranks
from fathom.session import reliable_checkpoint

# A value that more than one row in HOT_SHARE holds is hot; there are at most HOT_SHARE of them a column.
HOT_SHARE = 4000
GRAM_SCHEMA = "i int, n array<double>, sx array<double>, sxx array<double>, sxy array<double>"


def _present(name: str):
    x = ranks.quoted(name).cast("double")
    return F.when(~F.isnan(x), x)


def _gram(vectors: DataFrame, width: int) -> DataFrame:
    """Sums per pair (i, j): n, sum and sum of squares of i over the pair's rows, sum of products; ``vectors`` has one array column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), **{
            name: pa.array(list(part), pa.list_(pa.float64())) for name, part in zip(("n", "sx", "sxx", "sxy"), total)}})

    parts = vectors.mapInArrow(run, GRAM_SCHEMA)
    cells = parts.select("i", F.posexplode(F.arrays_zip("n", "sx", "sxx", "sxy")).alias("j", "c"))
    return cells.groupBy("i", "j").agg(*[F.sum(f"c.{c}").alias(c) for c in ("n", "sx", "sxx", "sxy")])


def _coefficients(gram: DataFrame, names: list[str], out: str) -> DataFrame:
    """(col_a, col_b, n, coefficient) for each pair a < b in column order; NULL where a side does not vary or has under two rows."""
    b = gram.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    both = gram.where("i < j").join(b, ["i", "j"])
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    label = F.array(*[F.lit(n) for n in names])
    value = F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sxy / F.sqrt(vx * vy))))
    return both.select(label[F.col("i")].alias("col_a"), label[F.col("j")].alias("col_b"), F.col("n").cast("bigint").alias("n"), value.alias(out))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, n, corr) for every pair of ``columns``, each over the rows in which both are present (NaN is missing).

    Two passes over ``df``: the means, then the sums; a task sends d rows of d entries.
    """
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two columns")
    means = df.agg(*[F.avg(_present(c)) for c in columns]).first()
    centred = [_present(c) - F.lit(m if m is not None else 0.0) for c, m in zip(columns, means)]
    # A missing entry travels as NaN: the array keeps its length.
    vectors = df.select(F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in centred]).alias("v"))
    return _coefficients(_gram(vectors, len(columns)), columns, "corr")


def rank_corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, n, rank_corr): Spearman's coefficient, ties with their mean rank, over the rows in which all ``columns`` are present.

    All columns are ranked together as cells (row, column, value): the distinct values with their counts are range-sliced and
    ranked, and every cell looks its value's rank up. Values that many rows share are looked up by broadcast (at most 4000 a column).
    """
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two columns")
    width = len(columns)
    rows = df.select(*[_present(c).alias(f"_{i}") for i, c in enumerate(columns)]).dropna()
    # Row numbers only mark which cells belong together; the table is written, so a re-run task reads the same ones.
    rows = reliable_checkpoint(rows.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.count()
    # + 0.0 makes one value of the two zeros.
    cells = rows.select("_row", F.posexplode(F.array(*[F.col(f"_{i}") + F.lit(0.0) for i in range(width)])).alias("position", "x"))
    values = cells.groupBy("position", "x").agg(F.count(F.lit(1)).alias("w"))
    tagged = ranks.sliced(values, ["position"], ["x"])
    ranked = ranks.with_running_weight(tagged, ranks.slice_offsets(tagged, ["position"], "w"), ["position"], ["x"], "w", broadcast_offsets=False)
    # Mean rank, centred by the mean of all ranks.
    table = reliable_checkpoint(ranked.select("position", "x", "w", ((F.col("_rank_start") + F.col("_rank_end") + 1) / 2 - F.lit((n + 1) / 2)).alias("r")))
    hot = table.where(F.col("w") * HOT_SHARE > n).select("position", "x", F.col("r").alias("hot_r"))
    first = cells.join(F.broadcast(hot), ["position", "x"], "left")
    found = first.where("hot_r IS NOT NULL").select("_row", "position", F.col("hot_r").alias("r"))
    rest = first.where("hot_r IS NULL").drop("hot_r").join(table.where(F.col("w") * HOT_SHARE <= n).drop("w"), ["position", "x"])
    together = found.unionByName(rest.select("_row", "position", "r")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("position", "r"))).alias("c"))
    vectors = together.select(F.col("c.r").alias("v"))
    return _coefficients(_gram(vectors, width), columns, "rank_corr")
