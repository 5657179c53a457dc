import hashlib

import pytest
from pyspark.sql import functions as F

from fathom.operators.sample import sample_rows


def want(ids, n, seed):
    return set(sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:n])


@pytest.mark.parametrize("top_rows", [100_000, 0])
@pytest.mark.parametrize("n", [0, 1, 333, 4999, 5000, 9000])
def test_same_rows_under_any_partitioning(spark, n, top_rows):
    for parts in (1, 7):
        df = spark.range(5000).repartition(parts)
        got = [r["id"] for r in sample_rows(df, n, ["id"], 3, top_rows).collect()]
        assert len(got) == min(n, 5000) and set(got) == want(range(5000), n, 3)


def test_repeated_rows_nulls_and_odd_names(spark):
    df = spark.createDataFrame([(None, 1)] * 50 + [(i, 2) for i in range(50)], "`k.x` int, _sample_hash int")
    for top_rows in (100_000, 0):
        out = sample_rows(df, 70, ["k.x"], 1, top_rows)
        assert out.columns == df.columns and out.count() == 70
    assert sample_rows(df.where(F.lit(False)), 5, ["k.x"], top_rows=0).count() == 0
    with pytest.raises(ValueError):
        sample_rows(df, 5, [])


def test_small_samples_are_partial_top_n(spark):
    plan = sample_rows(spark.range(1000), 10, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
