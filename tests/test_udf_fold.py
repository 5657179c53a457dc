"""Combinable group code: results equal plain Python, and no worker sees a whole group."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathom.operators.udf import GroupFold, combine_groups

# the state remembers the most rows that any update got, besides a counter of values
FOLD = GroupFold(lambda: (Counter(), 0), lambda s, rows: (s[0] + Counter(rows["v"].tolist()), max(s[1], len(rows))),
                 lambda a, b: (a[0] + b[0], max(a[1], b[1])),
                 lambda s: {"n": sum(s[0].values()), "top": min(s[0], key=lambda v: (-s[0][v], v)) if s[0] else None, "most_at_once": s[1], "values": sorted(s[0])[:3]})
SCHEMA = "n long, top long, most_at_once long, `values` array<long>"


@pytest.mark.parametrize("held,fan", [(10_000, 64), (2, 3)])
def test_against_plain_python(spark, held, fan):
    # a third of the rows is one group; null and NaN keys are one group
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 50 == 1, None).when(F.col("id") % 50 == 2, F.lit(math.nan)).otherwise(F.col("id") % 40 + 1.0).alias("k"),
                                  F.concat(F.lit("s"), F.col("id") % 2).alias("state"), (F.col("id") * 31 % 17).alias("v")).repartition(12)
    want = {}
    for r in df.collect():
        want.setdefault((None if r.k is None or math.isnan(r.k) else r.k, r.state), Counter())[r.v] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        out = combine_groups(df, ["k", "state"], FOLD, SCHEMA, held, fan)
        assert out.columns == ["k", "state", "n", "top", "most_at_once", "values"]
        got = {(r.k, r.state): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) == out.count()
    for key, c in want.items():
        assert (got[key].n, got[key].top, got[key]["values"]) == (sum(c.values()), min(c, key=lambda v: (-c[v], v)), sorted(c)[:3])
    assert got[0.0, "s0"].n == 1500 and got[0.0, "s0"].most_at_once <= 200


def test_without_keys_and_empty(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("v")).repartition(4)
    assert [tuple(r)[:2] for r in combine_groups(df, [], FOLD, SCHEMA).collect()] == [(500, 0)]
    assert [tuple(r) for r in combine_groups(df.limit(0), [], FOLD, SCHEMA).collect()] == [(0, None, 0, [])]
    assert combine_groups(df.limit(0).withColumn("k", F.lit(1)), ["k"], FOLD, SCHEMA).collect() == []
