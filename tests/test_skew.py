"""A key holding a third of all rows must be spread over several tasks, with exact results."""

from pyspark.sql import functions as F

from fathom.operators.transform import time_delta
from fathom.plans import ranks


def hot_frame(spark, n=3000):
    # key 0 holds a third of the rows; the others are spread over 200 keys
    return spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 200 + 1).alias("k"),
        F.col("id").alias("seq"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=F.col("id") * 7)).alias("ts"))


def test_hot_key_spans_several_slices(spark):
    tagged = ranks.sliced(hot_frame(spark), ["k"], ["ts", "seq"], num_slices=8)
    spans = {r["k"]: r["n"] for r in tagged.groupBy("k").agg(F.countDistinct(ranks.SLICE).alias("n")).collect()}
    assert spans[0] >= 3            # the hot key is cut into several slices (tasks)
    biggest = tagged.groupBy(ranks.SLICE).count().agg(F.max("count")).first()[0]
    assert biggest < 3000 / 3       # no slice holds the whole hot key


def test_time_delta_on_hot_key_is_exact(spark):
    df = hot_frame(spark)
    got = {r["seq"]: r["ts_delta_seconds"] for r in time_delta(df, "ts", key=["k"], tiebreak=["seq"]).collect()}
    last = {}
    for seq in range(3000):
        k = 0 if seq % 3 == 0 else seq % 200 + 1
        expected = None if k not in last else float((seq - last[k]) * 7)
        assert got[seq] == expected, seq
        last[k] = seq
