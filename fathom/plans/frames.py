"""Any aggregate over a row frame or a value (time) frame of a key, without a key-sized task.

``Window.partitionBy(key)`` sends a key to one task, and running sums cannot stand in for aggregates that have no inverse
(min, max, first, sketches). Here a key's rows are cut into *blocks* as long as the frame, so that a frame always begins in one
block and ends in the same or the next one: its value is the aggregate from its first row to the end of that row's block,
merged with the aggregate from the start of its last row's block to that row. Both are running aggregates inside a block. They
are computed over range slices of (key, order): an ordinary window inside a slice, and the totals of the block's other slices
(a row per block and slice) for the rest. So neither a hot key nor a frame of a billion rows meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans import ranks
from fathom.plans.ordered import last_non_null_by_key

SLICE = ranks.SLICE


@dataclass(frozen=True)
class Aggregate:
    """A combinable aggregate: ``of`` rows, ``again`` over partial values in order, ``merge`` of an earlier and a later partial
    value (either may be null), ``finish`` for the result. It needs no inverse, and need not commute.
    ``back`` and ``back_again`` are ``of`` and ``again`` over rows that come in reverse order (the same, if order is no matter): with
    them the aggregate from a row to its slice's last row is a running one too; without them it is worked out anew for every row."""
    of: Callable[[Column], Column]
    again: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda c: c
    back: Callable[[Column], Column] | None = None
    back_again: Callable[[Column], Column] | None = None


def _either(join: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.coalesce(join(a, b), a, b)


def _unordered(of: Callable[[Column], Column], again: Callable[[Column], Column], merge: Callable[[Column, Column], Column],
               finish: Callable[[Column], Column] = lambda c: c) -> Aggregate:
    return Aggregate(of, again, merge, finish, of, again)


def _first(c: Column) -> Column:
    return F.first(c, True)


def _last(c: Column) -> Column:
    return F.last(c, True)


AGGREGATES: dict[str, Aggregate] = {
    "min": _unordered(F.min, F.min, F.least),                  # least and greatest skip nulls
    "max": _unordered(F.max, F.max, F.greatest),
    "sum": _unordered(F.sum, F.sum, _either(lambda a, b: a + b)),
    "count": _unordered(F.count, F.sum, _either(lambda a, b: a + b), lambda c: F.coalesce(c, F.lit(0).cast("long"))),
    "first": Aggregate(_first, _first, F.coalesce, back=_last, back_again=_last),      # first and last value that is not null
    "last": Aggregate(_last, _last, lambda a, b: F.coalesce(b, a), back=_first, back_again=_first),
    "bool_or": _unordered(F.bool_or, F.bool_or, _either(lambda a, b: a | b)),
    "bool_and": _unordered(F.bool_and, F.bool_and, _either(lambda a, b: a & b)),
    "bit_or": _unordered(F.bit_or, F.bit_or, _either(lambda a, b: a.bitwiseOR(b))),
    "bit_and": _unordered(F.bit_and, F.bit_and, _either(lambda a, b: a.bitwiseAND(b))),
    # distinct values within a few percent, by sketches of bounded size
    "approx_distinct": _unordered(F.hll_sketch_agg, F.hll_union_agg, _either(F.hll_union), lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0).cast("long"))),
}


def _kinds(outputs: dict) -> list[tuple[str, Aggregate]]:
    return [(out, a if isinstance(a, Aggregate) else AGGREGATES[a]) for out, (a, _) in outputs.items()]


def _base(df: DataFrame, keys: list[str], outputs: dict, *more: Column) -> tuple[DataFrame, list[str]]:
    """``row`` (all columns), _k{i} (keys), _v{i} (what the outputs aggregate) and ``more``: names that clash with nothing."""
    base = df.select(F.struct(*[ranks.quoted(c) for c in df.columns]).alias("row"), *[ranks.quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                     *more, *[ranks.quoted(c).alias(f"_v{i}") for i, (_, c) in enumerate(outputs.values())])
    return base, [f"_k{i}" for i in range(len(keys))]


def _edges(rows: DataFrame, group: list[str], order: list[str], kinds: list, partial: bool, onward: bool = True) -> DataFrame:
    """Adds p{i} and, if ``onward``, s{i}: the aggregate from the group's first row to this one, and from this one to its last row.

    ``rows`` carries SLICE; with ``partial`` the _v{i} are partial values already. A frame that ends at the last row is worked
    out anew for each row, in the square of the slice; so s{i} are running aggregates over the rows in reverse order.
    """
    whole = Window.unboundedPreceding
    local = Window.partitionBy(*group, SLICE)
    ahead = local.orderBy(*order)
    upto, behind, rest = ahead.rowsBetween(whole, 0), local.orderBy(*[F.desc(o) for o in order]).rowsBetween(whole, 0), ahead.rowsBetween(0, Window.unboundedFollowing)
    near = [(agg.again if partial else agg.of)(F.col(f"_v{i}")).over(upto).alias(f"_p{i}") for i, (_, agg) in enumerate(kinds)]
    if onward:
        for i, (_, agg) in enumerate(kinds):
            make = agg.back_again if partial else agg.back
            near.append((make(F.col(f"_v{i}")).over(behind) if make else (agg.again if partial else agg.of)(F.col(f"_v{i}")).over(rest)).alias(f"_s{i}"))
    near = rows.select("*", *near)
    # the last row of a slice has all of it behind it
    totals = near.groupBy(*group, SLICE).agg(F.max_by(F.struct(*[f"_p{i}" for i in range(len(kinds))]), F.struct(*order)).alias("_t"))
    by_slice = Window.partitionBy(*group).orderBy(SLICE)
    sides = [("_b", by_slice.rowsBetween(whole, -1)), ("_n", by_slice.rowsBetween(1, Window.unboundedFollowing))][:2 if onward else 1]
    carry = totals.select(*group, SLICE, *[agg.again(F.col(f"_t._p{i}")).over(w).alias(f"{c}{i}") for i, (_, agg) in enumerate(kinds) for c, w in sides])
    met = ranks.join_null_safe(near, carry, [*group, SLICE])
    made = {f"p{i}": agg.merge(F.col(f"_b{i}"), F.col(f"_p{i}")) for i, (_, agg) in enumerate(kinds)}
    if onward:
        made |= {f"s{i}": agg.merge(F.col(f"_s{i}"), F.col(f"_n{i}")) for i, (_, agg) in enumerate(kinds)}
    return met.withColumns(made).drop(*[f"{c}{i}" for i in range(len(kinds)) for c in ("_b", "_n", "_p", "_s")])


def _out(kinds: list, value: Callable[[int, Aggregate], Column]) -> list[Column]:
    return [agg.finish(value(i, agg)).alias(out) for i, (out, agg) in enumerate(kinds)]


def row_frame(df: DataFrame, keys: list[str], order: list[str], outputs: dict, preceding: int | None, following: int | None,
              num_slices: int | None = None) -> DataFrame:
    """``{out: (aggregate, column)}`` over ``ROWS BETWEEN preceding PRECEDING AND following FOLLOWING`` of each key.

    ``None`` is unbounded, a negative number lies on the other side of the row. ``order`` must order the rows of a key totally.
    An aggregate is a name of AGGREGATES or an ``Aggregate``. SQL's semantics: a null key is a key, null values are skipped, a frame
    without a value gives null (0 for counts).
    """
    if preceding is not None and following is not None and preceding + following < 0:
        raise ValueError("the frame ends before it begins")
    kinds = _kinds(outputs)
    base, ks = _base(df, keys, outputs, *[ranks.quoted(o).alias(f"_o{i}") for i, o in enumerate(order)])
    os = [f"_o{i}" for i in range(len(order))]
    tagged = ranks.sliced(base, ks, os, num_slices)
    offsets = tagged.groupBy(*ks, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(*ks)
    offsets = offsets.withColumns({"_start": F.sum("_n").over(of_key.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
                                   "_size": F.sum("_n").over(of_key)}).drop("_n")
    placed = ranks.join_null_safe(tagged.withColumn("_rn", F.row_number().over(Window.partitionBy(*ks, SLICE).orderBy(*os))), offsets, [*ks, SLICE], "inner")
    placed = placed.withColumn("_pos", F.col("_start") + F.col("_rn")).drop("_rn", "_start", *os)
    bounded = preceding is not None and following is not None
    length = F.lit(preceding + following + 1).cast("long") if bounded else F.col("_size")

    def block(pos: Column) -> Column:
        return F.floor((pos - 1) / length).cast("long") if bounded else F.lit(0).cast("long")

    made = ranks.reliable_checkpoint(_edges(placed.withColumn("_blk", block(F.col("_pos"))), [*ks, "_blk"], ["_pos"], kinds, False, onward=preceding is not None))
    one = F.lit(1).cast("long")
    low = one if preceding is None else F.greatest(F.col("_pos") - preceding, one)
    high = F.col("_size") if following is None else F.least(F.col("_pos") + following, F.col("_size"))
    out = made.withColumns({"_low": low, "_high": high})
    n = range(len(kinds))
    for side, bound, own in (("s", "_low", preceding == 0), ("p", "_high", following == 0)):
        if side == "s" and preceding is None:
            continue        # every frame begins where its block does
        if own:
            out = out.withColumns({f"{side}_{i}": F.col(f"{side}{i}") for i in n})
            continue
        there = made.select(*ks, F.col("_pos").alias(bound), *[F.col(f"{side}{i}").alias(f"{side}_{i}") for i in n])
        out = ranks.join_null_safe(out, there, [*ks, bound])         # (key, position) is unique: no hot key
    low, high = F.col("_low"), F.col("_high")
    starts = low == block(low) * length + 1

    def value(i: int, agg: Aggregate) -> Column:
        if preceding is None:
            return F.when(low <= high, F.col(f"p_{i}"))
        first, last = F.col(f"s_{i}"), F.col(f"p_{i}")
        return F.when(low <= high, F.when(block(low) != block(high), agg.merge(first, last)).when(starts, last).otherwise(first))

    return out.select("row.*", *_out(kinds, value))


def _number(on: Column, kind: T.DataType) -> tuple[Column, int]:
    """The ordering column as an exact number, and how many of its steps are one unit of a frame (a second, a day, a number)."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, on.cast("timestamp_ntz")), 1_000_000
    if isinstance(kind, T.DateType):
        return F.unix_date(on).cast("long"), 1
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return on.cast("long"), 1
    raise TypeError(f"a value frame needs whole numbers, dates or timestamps to order by, not {kind.simpleString()}")


def range_frame(df: DataFrame, keys: list[str], on: str, outputs: dict, preceding: float | None, following: float | None,
                num_slices: int | None = None) -> DataFrame:
    """``{out: (aggregate, column)}`` over ``RANGE BETWEEN preceding PRECEDING AND following FOLLOWING`` of each key ordered by ``on``.

    Distances are seconds for timestamps (microsecond steps), days for dates, else numbers; ``None`` is unbounded. All rows of one
    ``on`` value are peers and share their result, so order-dependent aggregates (first, last) have no defined choice among peers.
    Rows without ``on`` have each other as their frame and are in no other row's.
    """
    if preceding is not None and following is not None and preceding + following < 0:
        raise ValueError("the frame ends before it begins")
    kinds, n = _kinds(outputs), range(len(outputs))
    number, unit = _number(ranks.quoted(on), df.schema[on].dataType)
    back, ahead = (None if x is None else round(x * unit) for x in (preceding, following))
    base, ks = _base(df, keys, outputs, number.alias("_x"))
    length = F.lit(back + ahead + 1).cast("long") if back is not None and ahead is not None else None
    low, high = (None if d is None else F.col("_x") + F.lit(d).cast("long") for d in (None if back is None else -back, ahead))

    def block(x: Column | None) -> Column:
        """Rows without a number have no block."""
        if length is None:
            return F.when(F.col("_x").isNotNull(), F.lit(0).cast("long"))
        return F.call_function("div", x - F.pmod(x, length), length)

    # peers first become one row, combined where they are read
    per = base.groupBy(*ks, "_x").agg(*[agg.of(F.col(f"_v{i}")).alias(f"_v{i}") for i, (_, agg) in enumerate(kinds)])
    sliced = ranks.sliced(per.withColumn("_blk", block(F.col("_x"))), ks, ["_x"], num_slices)
    made = ranks.reliable_checkpoint(_edges(sliced, [*ks, "_blk"], ["_x"], kinds, True))
    sides = [f"{c}{i}" for i in n for c in ("p", "s")]
    known = made.select(*ks, "_x", F.struct("_blk", *sides).alias("_e"))
    rows = made.select(*ks, "_x", *sides)
    for distance, bound, forward, out in ((back, low, True, "_s"), (ahead, high, False, "_p")):
        if distance:
            rows = _seek(rows.withColumn("_bound", bound), known, ks, forward, out)
    if back is None and ahead is None:
        total = made.where("_x IS NOT NULL").groupBy(*ks).agg(F.max_by(F.struct(*[f"p{i}" for i in n]), "_x").alias("_all"))
        rows = ranks.join_null_safe(rows, total, ks)

    def value(i: int, agg: Aggregate) -> Column:
        begin = F.col(f"s{i}") if not back else F.when(F.col("_s._blk") == block(low), F.col(f"_s.s{i}"))
        end = F.col(f"p{i}") if not ahead else F.when(F.col("_p._blk") == block(high), F.col(f"_p.p{i}"))
        if back is None and ahead is None:
            found = F.col(f"_all.p{i}")
        elif back is None or ahead is None:
            found = end if back is None else begin
        else:
            found = F.when(block(low) == block(high), end).otherwise(agg.merge(begin, end))
        return F.when(F.col("_x").isNull(), F.col(f"p{i}")).otherwise(found)

    result = rows.select(*ks, "_x", *[value(i, agg).alias(f"r{i}") for i, (_, agg) in enumerate(kinds)])
    met = ranks.join_null_safe(base.drop(*[f"_v{i}" for i in n]), result, [*ks, "_x"])
    return met.select("row.*", *_out(kinds, lambda i, agg: F.col(f"r{i}")))


def _seek(rows: DataFrame, known: DataFrame, ks: list[str], forward: bool, out: str) -> DataFrame:
    """Adds ``out``: ``_e`` of the key's nearest known _x at or after (``forward``), or at or before, each row's _bound."""
    sign = -1 if forward else 1
    other = [c for c in rows.columns if c not in (*ks, "_bound")]
    kind = known.schema["_e"].dataType
    left = rows.select(*ks, (F.col("_bound") * sign).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_e"), F.struct(*other).alias("_r"))
    right = known.where(F.col("_x").isNotNull()).select(*ks, (F.col("_x") * sign).alias("_t"), F.lit(0).alias("_side"), "_e", F.lit(None).cast(left.schema["_r"].dataType).alias("_r"))
    filled = last_non_null_by_key(left.unionByName(right), ks, ["_t", "_side"], ["_e"], prefix="_f")
    return filled.where(F.col("_r").isNotNull()).select(*ks, "_r.*", F.col("_f_e").alias(out))
