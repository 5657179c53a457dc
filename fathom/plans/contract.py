"""Registry of the contract queries: a Spark plan and, where SQL can say it, a DuckDB oracle.

Every query reads the given parquet tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources.files import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Rounded double (+0.0 folds a negative zero), the form both engines compare on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_rnd(expr: str, digits: int = 4) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


# Column kinds of the given tables: num (number), str (string), ts (date), arr (mixed).
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "num"), ("r_name", "str")],
    "nation": [("n_nationkey", "num"), ("n_name", "str"), ("n_regionkey", "num")],
    "customer": [("c_custkey", "num"), ("c_name", "str"), ("c_nationkey", "num"), ("c_acctbal", "num"),
                 ("c_mktsegment", "str")],
    "supplier": [("s_suppkey", "num"), ("s_name", "str"), ("s_nationkey", "num"), ("s_acctbal", "num")],
    "part": [("p_partkey", "num"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "num"),
             ("p_retailprice", "num")],
    "orders": [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
               ("o_orderdate", "ts"), ("o_orderpriority", "str")],
    "lineitem": [("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"),
                 ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"), ("l_tax", "num"),
                 ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "ts")],
    "events": [("event_id", "num"), ("ts", "ts"), ("user_id", "num"), ("event_type", "str"), ("value", "num"),
               ("props", "str")],
    "documents": [("doc_id", "num"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "num")],
    "labels": [("doc_id", "num"), ("quality", "num"), ("toxic", "num")],
    "benchmark": [("item_id", "num"), ("text", "str")],
    "pages": [("page_id", "num"), ("url", "str"), ("html", "str")],
    "embeddings": [("vec_id", "num"), ("embedding", "arr"), ("label", "num")],
    "conversations": [("conv_id", "num"), ("turn", "num"), ("role", "str"), ("text", "str")],
}
ALL_TABLES = list(TABLE_COLUMNS)

# Cleaning inputs: the tables hold no NULL and no duplicate row, so the same dirt is added in
# Spark and in SQL - NULL value in every 7th event, every 10th event twice.
DIRTY_EVENTS_COLUMNS = [("event_id", "num"), ("ts", "ts"), ("user_id", "num"), ("event_type", "str"), ("value", "num")]
DIRTY_EVENTS_SQL = """(WITH base AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 10 = 0)"""


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    base = ev.select("event_id", "ts", "user_id", "event_type",
                     F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"))
    return base.unionAll(base.where(F.col("event_id") % 10 == 0))
