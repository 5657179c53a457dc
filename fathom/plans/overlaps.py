"""Interval joins without an equality key: pairs of rows whose intervals meet, with no nested loop over the tables.

The line is cut into bins at quantiles of the start points, so a bin holds about as many starts as any other however the data
cluster. Two intervals that meet share the bin in which the later of them starts, and only that bin emits the pair: nothing
is found twice and no distinct() is needed. Inside a bin Spark runs an equality join on the bin with the exact test as its residual.

An interval over many bins is not copied to all of them. Level l has bins 2^l times as wide, and an interval's *home* is the
lowest level at which it spans at most two bins. An interval also *visits* the bins above its home in which the other side has a
home. So it has two homes and two visits a level at most, whatever its length; and as an interval fills at least a quarter
of its home bins, the visitors it is compared with are at most a few times its results.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.ranks import input_bytes

BIN_BYTES = 8 << 20       # input bytes a bin should hold
PART = 4096               # rows of a part of a bin
MAX_BINS = 1 << 14        # bounds of bins are a constant of the plan; at most twice as many (level, bin) homes are broadcast


def _number(on: Column, kind: T.DataType) -> Column:
    """A double that never falls as ``on`` rises (where doubles are too coarse, neighbours share a number: that only widens a bin)."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, on.cast("timestamp_ntz")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(on).cast("double")
    if isinstance(kind, T.NumericType):
        return on.cast("double")
    raise TypeError(f"intervals are joined over numbers, dates or timestamps, not {kind.simpleString()}")


def _intervals(df: DataFrame, on: tuple[str, str], closed: bool) -> DataFrame:
    """``row`` (all columns by position), start, end and their numbers; rows without a proper interval are left out."""
    flat = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    start, end = (F.col(f"c{df.columns.index(c)}") for c in on)
    kind = [df.schema[c].dataType for c in on]
    rows = flat.select(F.struct(*flat.columns).alias("row"), start.alias("start"), end.alias("end"), _number(start, kind[0]).alias("x0"), _number(end, kind[1]).alias("x1"))
    proper = (F.col("start") <= F.col("end")) if closed else (F.col("start") < F.col("end"))
    return rows.where(proper & ~F.isnan("x0") & ~F.isnan("x1"))


def bin_bounds(starts: DataFrame, bins: int) -> list[float]:
    """Ascending distinct numbers that cut the rows of the one column ``x0`` into about ``bins`` equal parts."""
    if bins < 2:
        return []
    found = starts.agg(F.percentile_approx("x0", [k / bins for k in range(1, bins)], 4 * bins).alias("q")).head()["q"]
    return sorted({b for b in found or [] if math.isfinite(b)})


def _placed(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """Adds b0 and b1, the level-0 bins of both ends, and ``home``, the interval's level."""
    if bounds:
        cut = Bucketizer(splitsArray=[[-math.inf, *bounds, math.inf]] * 2, inputCols=["x0", "x1"], outputCols=["f0", "f1"])
        rows = cut.transform(rows).withColumns({"b0": F.col("f0").cast("int"), "b1": F.col("f1").cast("int")}).drop("f0", "f1")
    else:
        rows = rows.withColumns({"b0": F.lit(0), "b1": F.lit(0)})
    # the lowest level at which the ends' bins are neighbours: near log2 of their distance, found by trying two levels
    guess = F.when(F.col("b1") - F.col("b0") <= 1, F.lit(0)).otherwise(F.floor(F.log2((F.col("b1") - F.col("b0")).cast("double"))).cast("int"))
    rows = rows.withColumn("g", F.greatest(guess - 1, F.lit(0)))
    spans = [F.call_function("shiftright", F.col("b1"), F.col("g") + k) - F.call_function("shiftright", F.col("b0"), F.col("g") + k) for k in range(3)]
    return rows.withColumn("home", F.col("g") + F.when(spans[0] <= 1, 0).when(spans[1] <= 1, 1).otherwise(2)).drop("g", "x0", "x1")


def _copies(rows: DataFrame, levels: Column) -> DataFrame:
    """A row per level of ``levels`` (an array) and bin that the interval touches there."""
    there = rows.select("*", F.explode(levels).alias("lv"))
    low, high = (F.call_function("shiftright", F.col(b), F.col("lv")) for b in ("b0", "b1"))
    return there.select("row", "start", "end", "b0", "home", "lv", F.explode(F.sequence(low, high)).alias("bin"))


def _dealt(left: DataFrame, right: DataFrame, tasks: int) -> list[DataFrame]:
    """Both sides' copies in ``tasks`` partitions, a bin cut into parts of about ``PART`` rows of the right side, each met by all its rows of the left.

    Long intervals have their homes in the few bins of the upper levels, which one task each would join otherwise. In a part the rows
    stand in the order of their starts, so neighbouring pairs are alike and a written result is small. The row's number keeps that order: the
    optimizer takes out a sort below a join.
    """
    parts = right.groupBy("lv", "bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))       # at most 4 rows a level-0 bin
    left, right = (side.join(F.broadcast(parts), ["lv", "bin"]) for side in (left, right))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumn("part", F.pmod(F.xxhash64(F.col("r_row").cast("string")), F.col("parts")).cast("int"))
    out = []
    for side, start in ((left, "l_start"), (right, "r_start")):
        side = side.drop("parts").repartition(tasks, "lv", "bin", "part").sortWithinPartitions("lv", "bin", "part", start)
        out.append(side.withColumn("at", F.monotonically_increasing_id()).where("at >= 0").drop("at"))
    return out


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], bins: int | None = None,
                 closed: bool = True, prefixes: tuple[str, str] = ("", ""), tasks: int | None = None) -> DataFrame:
    """All (left, right) pairs of rows whose intervals [start, end] meet; with ``closed`` false they are [start, end).

    The four columns must be comparable (all dates, all timestamps or all numbers); a point is an interval whose start is its end.
    Rows with a null or NaN bound or an end before their start (half-open: not after it) meet nothing; repeated rows each
    pair up. Names of both sides must differ once ``prefixes`` are put before them. ``tasks`` is the number of tasks that make the
    pairs: without it adaptive execution counts the bytes they read, and puts few bytes that make many pairs into one task.
    """
    names = [[p + c for c in side.columns] for side, p in zip((left, right), prefixes)]
    if both := set(names[0]) & set(names[1]):
        raise ValueError(f"both sides have the columns {sorted(both)}: give prefixes")
    spark = left.sparkSession
    if bins is None:
        bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(input_bytes(left) + input_bytes(right)) // BIN_BYTES))
    sides = [_intervals(left, left_on, closed), _intervals(right, right_on, closed)]
    bounds = bin_bounds(sides[0].select("x0").unionAll(sides[1].select("x0")), min(bins, MAX_BINS))
    placed = [_placed(side, bounds) for side in sides]
    levels = F.sequence(F.col("home"), F.lit(max(1, len(bounds)).bit_length()))
    homes = [_copies(side, F.array("home")).select("lv", "bin").distinct() for side in placed]      # at most 2 rows a level-0 bin
    met = []
    for side, other, tag in ((placed[0], homes[1], "l"), (placed[1], homes[0], "r")):
        # homes stay; of the levels above only bins in which the other side has a home are visited
        copies = _copies(side, levels).join(F.broadcast(other.withColumn("met", F.lit(True))), ["lv", "bin"], "left")
        copies = copies.where((F.col("lv") == F.col("home")) | F.col("met"))
        copies = copies.select("lv", "bin", *[F.col(c).alias(f"{tag}_{c}") for c in ("row", "start", "end", "b0", "home")])
        met.append(copies)
    on = ["lv", "bin"]
    if tasks:
        met, on = _dealt(*met, tasks), [*on, "part"]
    pairs = met[0].join(met[1], on)
    at_home = (F.col("l_home") == F.col("lv")) | (F.col("r_home") == F.col("lv"))
    later = F.call_function("shiftright", F.greatest("l_b0", "r_b0"), F.col("lv"))
    meet = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) if closed else (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    pairs = pairs.where(at_home & (F.col("bin") == later) & meet)
    return pairs.select(*[F.col(f"{tag}_row.c{k}") for tag, n in zip("lr", names) for k in range(len(n))]).toDF(*names[0], *names[1])
