"""States that merge: any cutting into batches gives the profile of all rows, exactly or within the stated bounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import profile as P
from fathom.operators import profile_state as S

EXACT = ["rows", "null_count", "min", "max", "max_abs", "max_length", "min_date", "max_date", "time_span_seconds", "examples", "distinct_values", "type", "is_numeric"]
MOMENTS = ["mean", "std_dev", "skewness"]


def frame(spark, n=6000):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, math.nan, rng.gauss(1e6, 3), rng.expovariate(0.1)]), f"v{min(rng.randrange(40), rng.randrange(40))}", f"unique {i * 7919 % n}", None, i % 3 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, word string, name string, nothing string, flag boolean").withColumn("at", F.expr("TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,0,0,id)"))


def test_any_tree_of_batches_gives_the_profile_of_all_rows(spark):
    df = frame(spark).repartition(5)
    cut = [df.where("id < 50"), df.where("id BETWEEN 50 AND 3999"), df.where("id >= 4000"), df.limit(0)]
    states = [S.profile_state(b, "t") for b in cut]
    flat = S.state_profile(states[0].unionAll(states[1]).unionAll(states[2]).unionAll(states[3]))
    tree = S.state_profile(S.merge_states(states[3].unionAll(S.merge_states(states[2].unionAll(states[0])))).unionAll(states[1]))
    whole = {r.column_name: r for r in P.profile(df, "t").collect()}
    ids = sorted(r.x for r in df.where("x IS NOT NULL AND NOT isnan(x)").select("x").collect())
    for got in (flat, tree):
        rows = {r.column_name: r for r in got.collect()}
        assert rows.keys() == whole.keys()
        for name, w in whole.items():
            g = rows[name]
            assert [g[c] for c in EXACT] == [w[c] for c in EXACT], name
            assert all((g[c] is None) == (w[c] is None) and (w[c] is None or math.isclose(g[c], w[c], rel_tol=1e-9, abs_tol=1e-9)) for c in MOMENTS), name
            assert abs(g.unique_count - w.unique_count) <= max(1, 0.05 * w.unique_count), name
            if w.value_counts is not None:      # fewer distinct values than the sketch holds: exact
                assert [c["count"] for c in g.value_counts] == [c["count"] for c in w.value_counts] and g.count_error >= 0, name
                assert name == "name" or g.value_counts == w.value_counts      # of thousands of ties any five may be named
        for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            rank = sum(v <= rows["x"][p] for v in ids) / len(ids)
            assert abs(rank - q) < 0.03


def test_frequent_values_beyond_the_sketch_keep_their_bound(spark, monkeypatch):
    """More distinct values than are held: the frequent ones are found, and no count is off by more than count_error."""
    for module in (P, S):
        monkeypatch.setattr(module, "FREQUENT", 96)
    df = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 == 1, F.concat(F.lit("b"), F.col("id") % 20)).otherwise(F.col("id").cast("string")).alias("w")).repartition(6)
    states = S.profile_state(df.where("hash(w) % 2 = 0"), "t").unionAll(S.profile_state(df.where("hash(w) % 2 <> 0"), "t"))
    got = S.state_profile(states).collect()[0]
    true = {"a": 3000, "b1": 1500, "b11": 1500}
    counts = {r.value: r["count"] for r in got.value_counts}
    assert got.count_error < 1000 and counts.keys() >= true.keys()
    assert all(abs(counts.get(v, 1) - n) <= got.count_error for v, n in true.items())
    assert all(abs(n - true.get(v, 1)) <= got.count_error for v, n in counts.items())
    approx = P.profile(df, "t", exact=False).collect()[0]
    assert {r.value for r in approx.value_counts} >= true.keys()


def test_sketch_of_frequent_values_shuffles_a_row_per_task(spark):
    """What the approximate mode moves for frequent values does not follow the number of distinct values."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        P.profile(spark.range(100).select(F.col("id").cast("string").alias("w")), exact=False, stats=["scalar", "values"]).explain()
    assert "partial_approx_top_k_accumulate" in buf.getvalue()


def test_columns_that_come_go_and_change_type(spark):
    a = S.profile_state(spark.sql("SELECT 1 AS x, 'p' AS y"), "t")
    b = S.profile_state(spark.sql("SELECT 'one' AS x, 2.5D AS z UNION ALL SELECT NULL, 3D"), "t")
    got = {r.column_name: r for r in S.state_profile(a.unionAll(b)).collect()}
    assert (got["x"].type, got["x"].rows, got["x"].null_count, got["x"].is_numeric) == ("mixed", 3, 1, False)
    assert (got["y"].rows, got["z"].rows, got["z"].mean) == (1, 2, 2.75)
    assert S.state_profile(a.limit(0)).collect() == []


def test_long_values_are_counted_by_name(spark):
    df = spark.createDataFrame([("x" * 5000,)] * 3 + [("x" * 4999 + "y",)], "w string")
    got = S.state_profile(S.profile_state(df)).collect()[0]
    assert [r["count"] for r in got.value_counts] == [3, 1] and all(len(r.value) < 120 for r in got.value_counts) and got.max_length == 5000


def test_store(spark, tmp_path):
    path, df = str(tmp_path / "states"), frame(spark, 600)
    for k in range(3):
        S.add_to_store(S.profile_state(df.where(f"id % 3 = {k}"), "t"), path, f"day{k}")
    S.add_to_store(S.profile_state(df.where("id % 3 = 1"), "t"), path, "day1")       # a batch loaded again replaces itself
    whole = {r.column_name: r for r in P.profile(df, "t").collect()}
    got = {r.column_name: r for r in S.state_profile(S.read_store(spark, path)).collect()}
    assert all([got[n][c] for c in EXACT] == [whole[n][c] for c in EXACT] for n in whole)
    assert {r.rows for r in S.state_profile(S.read_store(spark, path, ["day0", "day2"])).collect()} == {400}
    with pytest.raises(ValueError):
        S.add_to_store(S.read_store(spark, path), path, "a/b")
