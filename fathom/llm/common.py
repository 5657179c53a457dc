"""Helpers the operators share: row identity, saved tables, joins on keys that may be hot.

No helper collects rows of a corpus; what reaches the driver is a count or an aggregate whose
size is stated where it is collected.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import reliable_checkpoint

# A key holding more than 1 / HEAVY_SHARES of all rows is "heavy": there are at most HEAVY_SHARES
# such keys whatever the size of the data, so a table of them has a proven bound.
HEAVY_SHARES = 4000

K1, K2 = "__llm_k1", "__llm_k2"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def position(docs: DataFrame, name: str) -> int:
    """Where a column stands: the one of exactly this name, else the first that differs in case only."""
    names = docs.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, picked by position: columns with dots, backticks or names that differ in case are no matter."""
    flat = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return flat.select(*[F.col(f"c{position(docs, n)}").alias(n) for n in names])


def packed(docs: DataFrame, **named: str) -> DataFrame:
    """``row`` (struct of all columns by position: c0, c1, ...) beside the columns that ``named`` asks for."""
    flat = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return flat.select(F.struct(*flat.columns).alias("row"), *[F.col(f"c{position(docs, n)}").alias(alias) for alias, n in named.items()])


def unpacked(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns that ``packed`` put into ``row`` under their own names again, then the columns ``more``."""
    return rows.select(*[F.col(f"row.c{k}") for k in range(len(names))], *more).toDF(*names, *more)


def ship(module: str) -> None:
    """Send this module's functions to the workers by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back (cuts the lineage, survives lost executors)."""
    return reliable_checkpoint(df, compression)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128-bit identity of (doc_id, text): stable when a lost task is run again, unlike a generated id.

    Rows equal in both columns share it; every operator keyed by it gives such rows the same result.
    """
    return [F.xxhash64(doc_id, F.lit("|"), text).alias(K1), F.xxhash64(text, F.lit("#"), doc_id, F.lit(7)).alias(K2)]


def join_counted(rows: DataFrame, dim: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left join ``dim`` (unique, non-null ``keys``; ``size`` = its number of rows) with hot keys taken out.

    Heavy keys (over total / HEAVY_SHARES rows each, so at most HEAVY_SHARES of them) are joined by
    broadcast and never meet in one task; what is left has no key above that share and is shuffled.
    ``rows`` is read twice, so pass a saved table of a few narrow columns.
    """
    hot = F.col(size) * F.lit(HEAVY_SHARES) > F.lit(total)
    heavy = F.broadcast(dim.where(hot))
    spread = rows.join(heavy, keys, "inner")
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(dim.where(~hot), keys, "left")
    return spread.unionByName(rest)


BITMAP_WORDS = 1 << 18        # 64-bit words of a bitmap of keys: what is broadcast, at any size of data


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Adds to ``rows`` the column ``__llm_maybe``: true for every row whose ``key`` is in ``keys``, for few others while there
    are far fewer keys than the bitmap's 64 * BITMAP_WORDS bits. The bitmap has at most BITMAP_WORDS rows, and no row is moved."""
    at = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(64 * BITMAP_WORDS))
    place = [F.shiftright(at, 6).alias("__llm_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("__llm_bit")]
    bitmap = saved(keys.select(*place).groupBy("__llm_word").agg(F.bit_or("__llm_bit").alias("__llm_bits")))
    met = rows.select("*", *place).join(F.broadcast(bitmap), "__llm_word", "left")
    hit = F.coalesce(F.col("__llm_bits").bitwiseAND(F.col("__llm_bit")) != 0, F.lit(False))
    return met.withColumn("__llm_maybe", hit).drop("__llm_word", "__llm_bit", "__llm_bits")


def keep_keyed(docs: DataFrame, keep: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identity is in ``keep`` (K1, K2, n: how many rows carry it), each identity once.

    ``n`` = 1 rows need no further work; identities that several equal rows carry leave one of them. The
    documents' own columns travel in one struct, so they may have any name.
    """
    names = docs.columns
    keyed = packed(docs, doc_id=doc_id, text=text).select("row", *row_key(F.col("doc_id"), F.col("text")))
    if keep.where("n > 1").isEmpty():
        return unpacked(keyed.join(keep.select(K1, K2), [K1, K2], "left_semi"), names)
    joined = keyed.join(keep.select(K1, K2, F.col("n").alias("__llm_n")), [K1, K2], "inner")
    once = joined.where("__llm_n = 1").unionByName(joined.where("__llm_n > 1").dropDuplicates([K1, K2]))
    return unpacked(once, names)
