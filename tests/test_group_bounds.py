import numpy as np
import pandas as pd
import pytest

from fathom import api
from fathom.operators.clean import CleanRules
from fathom.operators.group_bounds import cap_outliers_by, drop_outliers_by, flag_outliers_by
from fathom.operators.query import describe_columns


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(4)
    n = 3000
    g = rng.choice(["hot", "b", None], n, p=[0.9, 0.05, 0.05])
    return pd.DataFrame({"id": range(n), "g.x": g, "h": rng.integers(0, 2, n), "v": np.where(g == "hot", 1000.0, 1.0) * rng.normal(1, 1, n)})


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf.astype({"g.x": object}), "id long, `g.x` string, h long, v double").repartition(5)


def test_caps_and_drops_by_group(spark, pdf):
    df = spark_frame(spark, pdf)
    groups = pdf.groupby(["g.x", "h"], dropna=False)["v"]
    hi, lo = groups.transform(lambda s: s.quantile(0.9)), groups.transform(lambda s: s.quantile(0.1))
    got = {r["id"]: r["v"] for r in cap_outliers_by(df, ["g.x", "h"], "v", lower=0.1, upper=0.9).collect()}
    assert np.allclose([got[i] for i in pdf["id"]], pdf["v"].clip(lo, hi))
    q1, q3 = groups.transform(lambda s: s.quantile(0.25)), groups.transform(lambda s: s.quantile(0.75))
    inside = (pdf["v"] >= q1 - 1.5 * (q3 - q1)) & (pdf["v"] <= q3 + 1.5 * (q3 - q1))
    assert {r["id"] for r in drop_outliers_by(df, ["g.x", "h"], "v").collect()} == set(pdf["id"][inside])
    z = (pdf["v"] - groups.transform("mean")).abs() > 2 * groups.transform("std")
    flagged = flag_outliers_by(df, ["g.x", "h"], "v", "zscore", k=2)
    assert flagged.columns == [*df.columns, "v_outlier"]
    assert {r["id"] for r in flagged.where("v_outlier").collect()} == set(pdf["id"][z])


def test_groups_without_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", float("nan")), (3, "b", 5.0), (4, None, 7.0)], "id int, g string, v double")
    for method in ("iqr", "zscore"):
        assert drop_outliers_by(df, ["g"], "v", method).count() == 4
    assert {r["id"]: r["v"] for r in cap_outliers_by(df, ["g"], "v").collect()} == {1: None, 2: None, 3: 5.0, 4: 7.0}
    assert cap_outliers_by(df.where("id > 9"), ["g"], "v").count() == 0
    for bad in (dict(method="x"), dict(lower=None, upper=None)):
        with pytest.raises(ValueError):
            cap_outliers_by(df, ["g"], "v", **bad)


def test_describe_columns_of_any_kind(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 2, None), ("b", None, False)], "s string, n int, f boolean")
    got = {(r["column_name"], r["statistic"]): r["value"] for r in describe_columns(df).collect()}
    assert got[("s", "top")] == "b" and got[("s", "top_count")] == "2" and got[("s", "max_length")] == "1"
    assert got[("n", "mean")] == "1.5" and got[("n", "null_count")] == "1" and ("n", "top") not in got
    assert got[("f", "null_count")] == "1" and ("f", "mean") not in got


def test_clean_file_in_one_call(spark, tmp_path):
    src = tmp_path / "shop.csv"
    src.write_text("id,price\n1,5\n1,5\n2,\n" + "".join(f"{i},{i}\n" for i in range(3, 60)))
    got = api.clean_file(spark, str(src), str(tmp_path / "out"), CleanRules(outlier_cols={"price": "iqr"}))
    assert got["file"]["format"] == "csv" and {s["step"]: s["affected"] for s in got["report"]} == {"drop_nulls": 1, "drop_duplicates": 1, "drop_outliers_iqr": 0}
    assert got["output"]["rows"] == 58 and got["output"]["path"].endswith("out/shop_cleaned.csv")
    assert api.read_file(spark, got["output"]["path"]).count() == 58
    with pytest.raises(Exception):
        api.clean_file(spark, str(src), str(tmp_path / "out"))      # nothing is overwritten unasked
    with pytest.raises(ValueError):
        api.clean_file(spark, str(src), str(tmp_path / "out"), fmt="xls")


def test_bounds_of_many_groups_are_not_broadcast_by_hint(spark, pdf):
    from fathom.operators.group_bounds import fit_group_bounds
    plan = fit_group_bounds(spark_frame(spark, pdf), ["g.x"], "v", lower=0.1)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()
