"""The physical plans keep the properties the design relies on at scale."""

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as E
from fathom.operators import profile as P
from fathom.operators.scan import scan_text

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_keep_first_limits_before_shuffle(spark):
    p = plan(E.queries()["clean_dedup_keep_first"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(E.queries()["query_filter_project"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in p
    assert "l_tax" not in p.split("ReadSchema:")[1]


def test_scan_has_no_join_and_profile_no_expand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "Join" not in plan(scan_text(docs, "doc_id", "text"))
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    cols = [P._Col(i, f.name, f.dataType) for i, f in enumerate(li.schema.fields)]
    assert "Expand" not in plan(P._value_table(P._long(li, cols, True)).groupBy("position").agg(F.count("v")))


def test_scalar_statistics_shuffle_no_cells(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(P.profile(li, stats=["scalar"]))
    assert "Expand" not in p and p.count("Exchange hashpartitioning") == 1
    below = p[p.index("Exchange hashpartitioning"):]
    assert "partial_min" in below.split("Generate inline")[0]      # combined before the only shuffle


def test_schema_statistics_start_no_job(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    spark.sparkContext.setJobGroup("schema-only", "schema-only")
    frame = P.profile(li, stats=["schema"])
    frame.schema
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("schema-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "parquet" not in plan(frame).lower()


def test_time_delta_without_a_key_is_not_one_task(spark):
    from fathom.operators.transform import time_delta
    assert "SinglePartition" not in plan(time_delta(spark.read.parquet(f"{SF}/events.parquet"), "ts", tiebreak=["event_id"]))


def test_count_distinct_copies_no_rows(spark):
    assert "Expand" not in plan(E.queries()["query_count_distinct"](spark, SF))
