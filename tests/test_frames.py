"""Row and value frames against plain Python, on hot keys, null keys, ties, every kind of bound."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.plans import frames, ranks


def rows_of(n, seed):
    rng = random.Random(seed)
    # key 0 holds a third of the rows, key None some; positions tie; values may be null
    return [(i, rng.choice([0, 0, 0, 1, 2, None, rng.randrange(3, 9)]), rng.choice([None, *range(40)]) if i % 17 == 0 else rng.randrange(60), rng.choice([None, rng.randrange(-50, 50)])) for i in range(n)]


SCHEMA = "id long, k long, t long, v long"
OUT = {"low": ("min", "v"), "high": ("max", "v"), "total": ("sum", "v"), "n": ("count", "v"), "opened": ("first", "v"), "closed": ("last", "v")}


def folded(values):
    got = [v for v in values if v is not None]
    return (min(got), max(got), sum(got), len(got), got[0], got[-1]) if got else (None, None, None, 0, None, None)


@pytest.mark.parametrize("preceding,following", [(2, 0), (4, 2), (5, -2), (None, 3), (2, None), (None, None), (700, 700)])
def test_row_frames(spark, preceding, following):
    rows = rows_of(400, 1)
    want = {}
    for key in {r[1] for r in rows}:
        part = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        for p, r in enumerate(part):
            low = 0 if preceding is None else max(0, p - preceding)
            high = len(part) if following is None else max(0, p + following + 1)
            want[r[0]] = folded([x[3] for x in part[low:high]])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("own")).repartition(3)
    got = frames.row_frame(df, ["k"], ["t", "id"], OUT, preceding, following, num_slices=7)
    assert got.columns == [*df.columns, *OUT]
    assert {r.id: tuple(r)[-len(OUT):] for r in got.collect()} == want


@pytest.mark.parametrize("preceding,following", [(5, 0), (3, 4), (0, 0), (6, -3), (4, -4), (None, 3), (2, None), (None, None)])
def test_value_frames(spark, preceding, following):
    rows = rows_of(400, 2)
    outputs = {k: v for k, v in OUT.items() if v[0] not in ("first", "last")}
    want = {}
    for r in rows:
        part = [x for x in rows if x[1] == r[1] and (x[2] is None) == (r[2] is None)]
        if r[2] is not None:
            part = [x for x in part if (preceding is None or x[2] >= r[2] - preceding) and (following is None or x[2] <= r[2] + following)]
        want[r[0]] = folded([x[3] for x in part])[:4]
    got = frames.range_frame(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], "t", outputs, preceding, following, num_slices=7)
    assert {r.id: (r.low, r.high, r.total, r.n) for r in got.collect()} == want


def test_value_frames_of_dates_and_timestamps(spark):
    df = spark.range(200).select("id", F.expr("date_add(DATE'2020-01-01', CAST(id * 7 % 50 AS int)) AS d"), F.expr("TIMESTAMP_NTZ'2020-03-29 00:00:00' + make_interval(0,0,0,0,0,0,id*1801) AS s"), (F.col("id") * 37 % 101).alias("v"))
    rows = df.collect()
    got = {r.id: r.m for r in frames.range_frame(df, [], "d", {"m": ("max", "v")}, 3, 1).collect()}
    assert got == {r.id: max(x.v for x in rows if -3 <= (x.d - r.d).days <= 1) for r in rows}
    got = {r.id: r.m for r in frames.range_frame(df, [], "s", {"m": ("min", "v")}, 3600, 0).collect()}
    assert got == {r.id: min(x.v for x in rows if -3600 <= (x.s - r.s).total_seconds() <= 0) for r in rows}
    with pytest.raises(TypeError):
        frames.range_frame(df.withColumn("x", F.lit(1.5)), [], "x", {"m": ("min", "v")}, 1, 1)


def test_sketches_roll_too(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    for r in frames.row_frame(df, [], ["id"], {"d": ("approx_distinct", "v")}, 499, 0, num_slices=5).where("id % 100 = 0").collect():
        assert abs(r.d - min(r.id + 1, 500)) <= 0.1 * min(r.id + 1, 500) + 1


def test_a_hot_key_is_no_task(spark):
    """The windows of a frame over a single key run slice by slice: no task gets the key's rows."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id", (F.col("id") * 48271 % 65537).alias("v"))
    got = {r.id: r.m for r in frames.row_frame(df, ["k"], ["id"], {"m": ("min", "v")}, 5000, 0, num_slices=8).where("id % 1000 = 7").collect()}
    v = [i * 48271 % 65537 for i in range(20_000)]
    assert got == {i: min(v[max(0, i - 5000):i + 1]) for i in range(7, 20_000, 1000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = ranks.sliced(df.select("k", F.lit(0).alias("_blk"), "id", F.col("v").alias("_v0")), ["k"], ["id"], 8)
        edges = frames._edges(rows, ["k", "_blk"], ["id"], [("m", frames.AGGREGATES["min"])], False)
        sizes = [r[1] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_empty_and_bad_frames(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert frames.row_frame(none, ["k"], ["t"], OUT, 1, 1).collect() == []
    assert frames.range_frame(none, ["k"], "t", {"m": ("min", "v")}, 1, 1).collect() == []
    for f in (lambda: frames.row_frame(none, ["k"], ["t"], OUT, 1, -2), lambda: frames.range_frame(none, ["k"], "t", OUT, -3, 1)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("preceding,following", [(None, 0), (300, 40), (5, None)])
def test_no_frame_is_worked_out_anew_for_every_row(spark, preceding, following, monkeypatch):
    # a frame that ends at the last row costs Spark the square of the slice
    plans = []
    keep = ranks.reliable_checkpoint
    monkeypatch.setattr(frames.ranks, "reliable_checkpoint", lambda df: (plans.append(df._jdf.queryExecution().analyzed().toString()), keep(df))[1])
    df = spark.createDataFrame(rows_of(200, 3), SCHEMA)
    frames.row_frame(df, [], ["t", "id"], OUT, preceding, following, num_slices=2)
    frames.range_frame(df, [], "t", {o: a for o, a in OUT.items() if o not in ("opened", "closed")}, 300, 40, num_slices=2)
    assert len(plans) >= 4 and not [p for p in plans if "currentrow$(), unboundedfollowing$()" in p]
