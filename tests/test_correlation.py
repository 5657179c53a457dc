import numpy as np
import pandas as pd
import pytest

from fathom.plans import correlation
from fathom.plans.correlation import corr_matrix, rank_corr_matrix


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    a = rng.normal(1e6, 1, 3000)
    pdf = pd.DataFrame({"a.b": a, "half": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)), "tied": rng.integers(0, 5, 3000).astype(float),
                        "up": np.exp((a - 1e6) * 2), "flat": np.full(3000, 3.0)})
    pdf.loc[rng.random(3000) < 0.1, "half"] = np.nan
    return pdf


def pairs(df, out):
    return {(r["col_a"], r["col_b"]): (r["n"], r[out]) for r in df.collect()}


def test_matrix_over_pairs_with_missing_values(spark, frame):
    got = pairs(corr_matrix(spark.createDataFrame(frame).repartition(5), list(frame.columns)), "corr")
    want = frame.corr()
    assert len(got) == 10
    for (a, b), (n, value) in got.items():
        assert n == int((frame[a].notna() & frame[b].notna()).sum())
        if "flat" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[a, b], abs=1e-9)


@pytest.mark.parametrize("share", [4000, 1, 10 ** 9])
def test_rank_correlation_with_ties_and_hot_values(spark, frame, monkeypatch, share):
    monkeypatch.setattr(correlation, "HOT_SHARE", share)      # some, none and all values by broadcast
    got = pairs(rank_corr_matrix(spark.createDataFrame(frame).repartition(5), ["a.b", "half", "tied", "up"]), "rank_corr")
    want = frame.drop(columns="flat").dropna().corr(method="spearman")
    assert got[("a.b", "up")][1] == pytest.approx(1.0)
    for (a, b), (n, value) in got.items():
        assert n == int(frame["half"].notna().sum()) and value == pytest.approx(want.loc[a, b], abs=1e-9)


def test_empty_and_single_rows(spark):
    none = spark.createDataFrame([], "x double, y int")
    one = spark.createDataFrame([(1.0, 2)], "x double, y int")
    for f, out in ((corr_matrix, "corr"), (rank_corr_matrix, "rank_corr")):
        assert all(v is None for _, v in pairs(f(one, ["x", "y"]), out).values())
        assert all(v is None for _, v in pairs(f(none, ["x", "y"]), out).values())
    with pytest.raises(ValueError):
        corr_matrix(one, ["x"])
