"""Ordered-within-key operations (lag, last non-null) that do not put a key in one task.

``Window.partitionBy(key)`` sends every row of a key to one task; when one user, source or
sensor holds a third of the table that task holds a third of the table. Here the rows are cut
into range slices of (key, order) (:func:`fathom.plans.ranks.sliced`), so a hot key spans many
slices. Each slice is processed by an ordinary window over (key, slice); what a slice needs
from the rows before it (the last row, the last non-null value) comes from a per-(key, slice)
summary whose per-key groups hold at most one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans import ranks

SLICE = ranks.SLICE


def lag_by_key(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
               num_slices: int | None = None) -> DataFrame:
    """Add ``out``: the value of ``col`` on the previous row of the same key (NULL on the first).

    ``order`` must make rows of one key totally ordered (add a tie-break column).
    """
    tagged = ranks.sliced(df, keys, order, num_slices)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    local = tagged.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(col).over(w))
    last = tagged.groupBy(*keys, SLICE).agg(F.max_by(F.col(col), F.struct(*order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)))
    joined = ranks.join_null_safe(local, carry.select(*keys, SLICE, "_carry"), [*keys, SLICE])
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return joined.withColumn(out, prev).drop("_rn", "_lag", "_carry", SLICE)


def last_non_null_by_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
                         num_slices: int | None = None, prefix: str = "_ff_") -> DataFrame:
    """Add ``prefix + c``: the last non-null ``c`` at or before each row within its key."""
    tagged = ranks.sliced(df, keys, order, num_slices)
    upto = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.select("*", *[F.last(c, ignorenulls=True).over(upto).alias(f"_loc_{c}") for c in cols])
    ordkey: Column = F.struct(*order)
    last = tagged.groupBy(*keys, SLICE).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(f"_last_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, SLICE, *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}")
                                        for c in cols])
    joined = ranks.join_null_safe(local, carry, [*keys, SLICE])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[F.coalesce(f"_loc_{c}", f"_carry_{c}").alias(prefix + c) for c in cols])


def window_by_key(df: DataFrame, keys: list[str], order: list[str], col: str, lags: int = 0, leads: int = 0,
                  running_sum: str | None = None, prefix: str = "", num_slices: int | None = None,
                  running_sums: dict[str, str] | None = None) -> DataFrame:
    """Row-frame window results per key without a key-sized task.

    Adds ``{prefix}lag{j}`` (j = 1..lags), ``{prefix}lead{j}`` (j = 1..leads) and, when named,
    ``running_sum`` (sum of ``col`` from the key's first row to the current one); ``running_sums``
    maps further output names to the columns they sum. ``order``
    must order the rows of a key totally. Inside a slice, ordinary windows over (key, slice)
    answer; rows near a slice edge take the missing neighbours from the last (first) ``k``
    values of the ``k`` previous (next) slices of the key - each such slice holds at least one
    row of the key, so ``k`` slices always suffice - and the running sum adds the totals of the
    key's earlier slices. Every per-key structure has at most one row per slice.
    """
    tagged = ranks.sliced(df, keys, order, num_slices)
    asc = Window.partitionBy(*keys, SLICE).orderBy(*order)
    desc = Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(o) for o in order])
    cur = tagged.withColumn("_rn", F.row_number().over(asc)).withColumn("_rd", F.row_number().over(desc))
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    summaries = []
    k_back, k_fwd = lags, leads
    if k_back or k_fwd:
        edge = cur.where((F.col("_rd") <= k_back) | (F.col("_rn") <= k_fwd))
        per = edge.groupBy(*keys, SLICE).agg(
            F.array_sort(F.collect_list(F.when(F.col("_rd") <= k_back, F.struct(F.col("_rn"), F.col(col).alias("v")))))
            .alias("_tail"),
            F.array_sort(F.collect_list(F.when(F.col("_rn") <= k_fwd, F.struct(F.col("_rn"), F.col(col).alias("v")))))
            .alias("_head"))
        per = per.select(*keys, SLICE, F.transform("_tail", lambda s: s["v"]).alias("_tail"),
                         F.transform("_head", lambda s: s["v"]).alias("_head"))
        cols = [*keys, SLICE]
        if k_back:
            cols.append(F.flatten(F.collect_list("_tail").over(by_slice.rowsBetween(-k_back, -1))).alias("_before"))
        if k_fwd:
            cols.append(F.flatten(F.collect_list("_head").over(by_slice.rowsBetween(1, k_fwd))).alias("_after"))
        summaries.append(per.select(*cols))
    sums = dict(running_sums or {})
    if running_sum:
        sums[running_sum] = col
    if sums:
        outs = list(sums)
        totals = tagged.groupBy(*keys, SLICE).agg(*[F.sum(sums[o]).alias(f"_total{i}") for i, o in enumerate(outs)])
        earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
        # NULL (not 0) when the earlier slices hold no value, as SQL's running sum.
        summaries.append(totals.select(*keys, SLICE, *[
            F.sum(f"_total{i}").over(earlier).alias(f"_carry{i}") for i in range(len(outs))]))
    for s in summaries:
        cur = ranks.join_null_safe(cur, s, [*keys, SLICE])
    out = [F.col(f"`{c}`") for c in df.columns]
    for j in range(1, lags + 1):
        from_before = F.try_element_at("_before", F.lit(-1) * (F.lit(j) - F.col("_rn") + 1))
        out.append(F.when(F.col("_rn") > j, F.lag(col, j).over(asc)).otherwise(from_before).alias(f"{prefix}lag{j}"))
    for j in range(1, leads + 1):
        from_after = F.try_element_at("_after", F.lit(j) - F.col("_rd") + 1)
        out.append(F.when(F.col("_rd") > j, F.lead(col, j).over(asc)).otherwise(from_after).alias(f"{prefix}lead{j}"))
    upto = asc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, o in enumerate(sums):
        carry, local = F.col(f"_carry{i}"), F.sum(sums[o]).over(upto)
        total = F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
        out.append(total.alias(o))
    return cur.select(*out)


def rank_by_key(df: DataFrame, keys: list[str], value: str, descending: bool = False,
                tiebreak: list[str] | None = None, num_slices: int | None = None,
                names: tuple[str, str, str] = ("row_num", "rnk", "dense_rnk")) -> DataFrame:
    """``row_number`` (ties broken by ``tiebreak``), ``rank`` and ``dense_rank`` of ``value``
    within each key, with the semantics of the SQL window functions, without a key-sized task.

    Row numbers are the key's slice offset plus the position inside the slice. A rank is the
    first row number of its tied value (a ``min`` aggregate per (key, value): map-side
    combined, so a heavily tied value is cheap). Dense ranks rank the distinct (key, value)
    pairs the same way.
    """
    o_val = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    order = [o_val] + [F.asc(t) for t in (tiebreak or [])]
    tagged = ranks.sliced(df, keys, order, num_slices)
    numbered = ranks.with_running_weight(tagged, ranks.slice_offsets(tagged, keys, None), keys, order, None,
                                         broadcast_offsets=False)
    numbered = numbered.withColumn(names[0], F.col("_rank_start") + 1).drop("_rank_start", "_rank_end", SLICE)
    firsts = numbered.groupBy(*keys, value).agg(F.min(names[0]).alias(names[1]))
    dtag = ranks.sliced(firsts, keys, [o_val], num_slices)
    dense = ranks.with_running_weight(dtag, ranks.slice_offsets(dtag, keys, None), keys, [o_val], None,
                                      broadcast_offsets=False)
    dense = dense.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.col(value).alias("_d_v"), names[1],
                         (F.col("_rank_start") + 1).alias(names[2]))
    cond = [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys] + [F.col(value).eqNullSafe(F.col("_d_v"))]
    joined = numbered.join(dense, cond)
    return joined.drop(*[f"_d_{k}" for k in keys], "_d_v")
