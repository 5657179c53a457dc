"""SQL databases through Spark's JDBC source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Write behaviour when the table exists, by name.
IF_EXISTS_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def jdbc_read_options(url: str, query: str | None = None, table: str | None = None,
                      partition_column: str | None = None, lower_bound=None, upper_bound=None,
                      num_partitions: int | None = None, **extra) -> dict:
    """Options for a JDBC scan of a ``query`` or a ``table``, split on ``partition_column`` into
    ``num_partitions`` parallel range reads if one is given (a query is then read as a subquery)."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    opts = {"url": url, **extra}
    if query is not None and not partition_column:
        opts["query"] = query
    else:
        opts["dbtable"] = table if query is None else f"({query}) AS fathom_query"
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return opts


def read_sql(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_read_options(url, query, table, **kwargs)).load()


def jdbc_write_mode(if_exists: str) -> str:
    if if_exists not in IF_EXISTS_MODES:
        raise ValueError(f"if_exists must be one of {tuple(IF_EXISTS_MODES)}")
    return IF_EXISTS_MODES[if_exists]


def write_sql(df: DataFrame, url: str, table: str, if_exists: str = "fail", **options) -> int:
    """Write ``df`` to ``table`` (no index column) and return the number of rows written.

    A table that exists is an error unless the caller says ``replace`` or ``append``.

    The row count is observed during the write itself (``DataFrame.observe``), not by a second
    pass over the data.
    """
    from pyspark.sql import Observation, functions as F
    obs = Observation("fathom_write_sql")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    (observed.write.format("jdbc").mode(jdbc_write_mode(if_exists))
     .options(url=url, dbtable=table, **options).save())
    return int(obs.get["rows"])
