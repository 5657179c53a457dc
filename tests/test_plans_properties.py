"""Property checks of the distributed order-statistic plans against NumPy / brute force."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.plans import ranks
from fathom.plans.quantiles import weighted_quantiles

values = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(values, min_size=1, max_size=3), slices=st.integers(min_value=1, max_value=6),
       p=st.floats(min_value=0.0, max_value=1.0))
def test_weighted_quantiles_property(spark, groups, slices, p):
    rows = [(k, float(v)) for k, vals in enumerate(groups) for v in vals]
    df = spark.createDataFrame(rows, "k int, x double")
    vt = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("w"))
    got = {r["k"]: r["q"] for r in weighted_quantiles(vt, "k", "x", "w", [p], ["q"], num_slices=slices).collect()}
    for k, vals in enumerate(groups):
        assert abs(got[k] - np.percentile(np.array(vals, dtype=float), p * 100)) < 1e-9


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.one_of(st.none(), st.text(alphabet="abcde", max_size=3)), min_size=1, max_size=40),
       slices=st.integers(min_value=1, max_value=5))
def test_dense_index_property(spark, vals, slices):
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = {r["s"]: r["i"] for r in ranks.dense_index(df, "s", "i", num_slices=slices).collect()}
    expected = {v: i for i, v in enumerate(sorted({v for v in vals if v is not None}))}
    assert got == expected
