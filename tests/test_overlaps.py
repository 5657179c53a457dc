"""Interval joins against all pairs in plain Python; no nested loop in the plan."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from fathom.plans import overlaps

SCHEMA = "id long, s long, e long"


def rows_of(n, seed, long):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.choice([500, rng.randrange(1000), rng.randrange(1000), None if k % 29 == 0 else 3])        # many starts at 500 and 3
        e = None if k % 31 == 0 else (s or 0) + rng.choice([0, 1, 5, rng.randrange(long), -2])
        rows.append((k, s, e))
    return rows + [rows[1], rows[1]]


def brute(a, b, closed):
    ok = lambda r: r[1] is not None and r[2] is not None and (r[1] <= r[2] if closed else r[1] < r[2])
    a, b = [r for r in a if ok(r)], [r for r in b if ok(r)]
    return sorted((x[0], y[0]) for x in a for y in b if (x[1] <= y[2] and y[1] <= x[2] if closed else x[1] < y[2] and y[1] < x[2]))


@pytest.mark.parametrize("bins,closed,long", [(1, True, 30), (7, False, 30), (64, True, 900), (500, False, 900), (None, True, 5)])
def test_against_all_pairs(spark, bins, closed, long):
    a, b = rows_of(150, 1, long), rows_of(130, 2, long)
    left, right = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (a, b))
    got = overlaps.overlap_join(left, right, ("s", "e"), ("s", "e"), bins, closed, prefixes=("a.", "b."))
    assert got.columns == ["a.id", "a.s", "a.e", "b.id", "b.s", "b.e"]
    assert sorted((r[0], r[3]) for r in got.collect()) == brute(a, b, closed)


def test_a_few_intervals_over_everything(spark):
    """Long intervals get two homes, and short ones visit only bins with a home: copies stay few."""
    short = spark.range(5000).select("id", F.col("id").alias("s"), (F.col("id") + 1).alias("e"))
    long = spark.range(3).select("id", (F.col("id") * 10).alias("s"), (F.lit(5000) - F.col("id")).alias("e"))
    got = overlaps.overlap_join(long, short, ("s", "e"), ("s", "e"), 256, prefixes=("l", "r"))
    assert {r.lid: r["count"] for r in got.groupBy("lid").count().collect()} == {0: 5000, 1: 4991, 2: 4981 - 1}
    bounds = overlaps.bin_bounds(short.select(F.col("s").cast("double").alias("x0")), 256)
    homes = overlaps._copies(overlaps._placed(overlaps._intervals(long, ("s", "e"), True), bounds), F.array("home"))
    assert 3 <= homes.count() <= 6 and homes.agg(F.min("home")).head()[0] >= 6


def test_kinds_of_bounds(spark):
    df = spark.sql("SELECT id, date_add(DATE'2024-01-01', CAST(id AS int)) AS d, CAST(id AS decimal(20, 3)) AS n, CAST(id AS double) AS x, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS t, CAST(id AS string) AS w FROM range(40)")
    other = df.toDF(*[c + "2" for c in df.columns])
    for c in ("d", "n", "x", "t"):
        assert overlaps.overlap_join(df, other, (c, c), (c + "2", c + "2"), 9).where("id = id2").count() == 40
    nan = spark.sql("SELECT double('nan') AS a, double('nan') AS b UNION ALL SELECT double('-inf'), double('inf')")
    assert overlaps.overlap_join(nan, other, ("a", "b"), ("x2", "x2"), 5).count() == 40
    with pytest.raises(TypeError):
        overlaps.overlap_join(df, other, ("w", "w"), ("w2", "w2"))
    with pytest.raises(ValueError):
        overlaps.overlap_join(df, df, ("d", "d"), ("d", "d"))
    assert overlaps.overlap_join(df.limit(0), other, ("d", "d"), ("d2", "d2")).count() == 0


def test_no_nested_loop(spark):
    import __spark_entry__ as E
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()["query_join_overlap"](spark, "/root/testdata/sf0.001").explain()
    assert "NestedLoop" not in buf.getvalue() and "Cartesian" not in buf.getvalue()


def test_many_pairs_of_few_bytes_are_made_by_many_tasks(spark):
    a = spark.range(400).select("id", (F.col("id") % 50).alias("s"), (F.col("id") % 50 + 2).alias("e"))
    got = overlaps.overlap_join(a, a, ("s", "e"), ("s", "e"), 16, prefixes=("l", "r"), tasks=6)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert got.count() == 64 * sum(abs(x - y) <= 2 for x in range(50) for y in range(50))


def test_open_orders_are_found_once(spark):
    import __spark_entry__ as E
    got = E.queries()["query_join_overlap"](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in got.inputFiles())


def test_bins_of_many_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    """Long intervals share one bin of an upper level; each pair is still found once."""
    monkeypatch.setattr(overlaps, "PART", 16, raising=False)
    a = spark.range(200).select("id", (F.col("id") % 5).alias("s"), (F.lit(1000) - F.col("id") % 7).alias("e"))
    got = overlaps.overlap_join(a, a, ("s", "e"), ("s", "e"), 16, prefixes=("l", "r"), tasks=6)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert got.count() == got.distinct().count() == 200 * 200
    x, y = rows_of(150, 1, 900), rows_of(130, 2, 900)
    left, right = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (x, y))
    for closed in (True, False):
        got = overlaps.overlap_join(left, right, ("s", "e"), ("s", "e"), 64, closed, prefixes=("a.", "b."), tasks=5)
        assert sorted((r[0], r[3]) for r in got.collect()) == brute(x, y, closed)
