"""Contract queries for sources and sinks: write with fathom, read back, compare to the table.

Files go under the session's checkpoint folder (the shared ``spark.checkpoint.dir`` on a
cluster), in a fresh path per call.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import clean as C
from fathom.plans.contract import dirty_events, register, rnd, table
from fathom.plans.q_clean import CLEAN_RULES, _CLEAN_ALL_SQL
from fathom.session import scratch_path
from fathom.sources.files import read_csv, read_json
from fathom.sources.sinks import json_safe, write_cleaned, write_csv, write_json

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _csv_roundtrip(spark, d):
    src = table(spark, d, "orders")
    path = scratch_path(spark, "orders-csv")
    write_csv(src, path)
    return read_csv(spark, path, schema=src.schema)


register("source_csv_roundtrip", f"SELECT {_ORDERS} FROM orders")(_csv_roundtrip)


def _json_records(spark, d):
    src = table(spark, d, "events")
    path = scratch_path(spark, "events-json")
    write_json(src, path, orient="records")
    return read_json(spark, path, orient="records", schema=src.schema)


register("source_json_records", "SELECT event_id, ts, user_id, event_type, value, props FROM events")(_json_records)


def _json_values(spark, d):
    src = table(spark, d, "orders")
    path = scratch_path(spark, "orders-json-values")
    write_json(src, path, orient="values")
    return read_json(spark, path, orient="values", schema=src.schema)


register("sink_json_roundtrip", f"SELECT {_ORDERS} FROM orders")(_json_values)


def _json_safe(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.col("value").cast("decimal(10,2)").alias("amount"), "ts",
        F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("ratio"),
        F.array("event_type", "props").alias("tags"),
        F.create_map(F.col("event_type"), F.col("ts")).alias("when_by_type"))
    safe = json_safe(ev)
    return safe.select("event_id", "amount", "ts", "ratio", F.array_join("tags", "|").alias("tags"),
                       F.col("when_by_type")[F.col("tags")[0]].alias("when_text"))


_ISO = ("CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END")
register("json_safe_values", f"""
SELECT event_id, CAST(CAST(value AS DECIMAL(10, 2)) AS VARCHAR) AS amount, {_ISO} AS ts,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS ratio, event_type || '|' || props AS tags,
       {_ISO} AS when_text
FROM events""")(_json_safe)


def _cleaned_roundtrip(spark, d):
    cleaned, _ = C.clean(dirty_events(spark, d), CLEAN_RULES)
    path = write_cleaned(cleaned, scratch_path(spark, "cleaned"), "events", fmt="csv")
    back = read_csv(spark, path, schema=cleaned.schema)
    return back.withColumn("value", rnd("value", 4))


register("sink_cleaned_roundtrip", _CLEAN_ALL_SQL)(_cleaned_roundtrip)


def _csv_quoted(spark, d):
    """Cells with quotes and line breaks, written and read as RFC 4180."""
    src = table(spark, d, "pages").select("page_id", "html")
    path = scratch_path(spark, "pages-csv")
    write_csv(src, path)
    return read_csv(spark, path, schema=src.schema, multi_line=True)


register("source_csv_quoted", "SELECT page_id, html FROM pages")(_csv_quoted)


def _csv_sep(spark, d):
    """Spreadsheet exports: every file starts with its own sep= line and header; equal rows stay."""
    src = table(spark, d, "nation").select("n_regionkey", "n_name")
    path = scratch_path(spark, "nation-sep")
    for sep in (";", "|"):
        lines = src.select(F.concat_ws(sep, F.col("n_regionkey").cast("string"), "n_name").alias("value"), F.lit(2).alias("k"))
        head = spark.createDataFrame([(f"sep={sep}", 0), (f"region{sep}name", 1), (f"0{sep}twice", 2), (f"0{sep}twice", 2)], "value string, k int")
        head.unionByName(lines).coalesce(1).sortWithinPartitions("k").select("value").write.mode("append").text(path)
    return read_csv(spark, path, schema="region long, name string", sep_line=True)


register("source_csv_sep_roundtrip", """
SELECT n_regionkey AS region, n_name AS name FROM nation, (VALUES (1), (2)) AS files(i)
UNION ALL SELECT 0, 'twice' FROM (VALUES (1), (2), (3), (4)) AS files(i)""")(_csv_sep)
