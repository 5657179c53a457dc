"""NULL keys are keys of their own for windows and ranks, and match nothing in a join."""

import pytest
from pyspark.sql import functions as F

from fathom.operators import clean as C
from fathom.operators.query import asof_join
from fathom.plans import ranks
from fathom.plans.ordered import lag_by_key, rank_by_key, window_by_key
from fathom.session import checkpoint_dir, reliable_checkpoint, scratch_scope


def _rows(n=240):
    return [(i, None if i % 3 == 0 else f"k{i % 5}", (i * 37) % n, float(i % 7)) for i in range(n)]


def _frame(spark):
    return spark.createDataFrame(_rows(), "id int, k string, t int, v double")


def test_ranks_over_eight_slices(spark):
    got = {r["id"]: (r["row_num"], r["rnk"], r["dense_rnk"]) for r in rank_by_key(_frame(spark), ["k"], "v", tiebreak=["id"], num_slices=8).collect()}
    assert len(got) == 240
    for k in {r[1] for r in _rows()}:
        own = sorted((r for r in _rows() if r[1] == k), key=lambda r: (r[3], r[0]))
        values = sorted({r[3] for r in own})
        for n, r in enumerate(own, 1):
            assert got[r[0]] == (n, 1 + sum(x[3] < r[3] for x in own), 1 + values.index(r[3]))


def test_lag_and_running_sum_over_eight_slices(spark):
    lagged = {r["id"]: r["p"] for r in lag_by_key(_frame(spark), ["k"], ["t"], "id", "p", num_slices=8).collect()}
    summed = {r["id"]: r["s"] for r in window_by_key(_frame(spark), ["k"], ["t"], "v", lags=1, running_sum="s", num_slices=8).collect()}
    for k in {r[1] for r in _rows()}:
        own, total, before = sorted((r for r in _rows() if r[1] == k), key=lambda r: r[2]), 0.0, None
        for r in own:
            total += r[3]
            assert lagged[r[0]] == before and summed[r[0]] == pytest.approx(total)
            before = r[0]


def test_asof_join_of_a_null_key_is_null(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([(None, 1, 10.0), ("a", 2, 20.0)], "k string, t int, v double")
    assert {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "t", "t", ["v"]).collect()} == {1: None, 2: 20.0}


def test_nan_is_missing_in_outlier_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("nan"),), (None,)], "x double")
    capped = [r["x"] for r in C.cap_outliers(df, "x", upper=0.9).collect()]
    assert capped.count(None) == 2 and max(x for x in capped if x is not None) == pytest.approx(89.1)
    assert C.drop_outliers(df, "x").count() == 102
    assert not any(r["x_outlier"] for r in C.flag_outliers(df, "x").collect())
    dotted = df.withColumnRenamed("x", "a.x")
    assert C.cap_outliers(dotted, "a.x").count() == 102


def test_only_decimal_numbers_are_numbers(spark):
    texts = ["12d", "5f", "0x1p3", "NaN", "Infinity", "1e3", " 1,234.5 ", "-.5", "7.", "", None, "+3"]
    got = C.to_number(spark.createDataFrame([(t,) for t in texts], "s string"), "s").collect()
    assert [r["s"] for r in got] == [None, None, None, None, None, 1000.0, 1234.5, -0.5, 7.0, None, None, 3.0]


def test_composite_report_covers_every_step(spark):
    df = spark.createDataFrame([("1", "2024-01-02", 5.0, 1), ("x", "02/01/2024", None, 2), ("3", None, 5.0, 3), ("3", None, 5.0, 3), ("4", "bad", 900.0, 4)],
                               "n string, d string, v double, id int")
    rules = C.CleanRules(to_numbers=["n"], to_dates={"d": ["yyyy-MM-dd", "dd/MM/yyyy"]}, fills={"n": 0.0}, null_subset=["v"], outlier_cols={"v": "cap", "id": "iqr"}, cap_upper=0.999)
    with scratch_scope(spark):
        out, report = C.clean(df, rules)
        steps = {(r["step"], r["column"]): (r["rows_in"], r["rows_out"], r["affected"]) for r in report.collect()}
        assert out.count() == 3 and dict(out.dtypes)["d"] == "date"
    assert steps == {("to_number", "n"): (5, 5, 4), ("to_date", "d"): (5, 5, 2), ("fill_nulls", "n"): (5, 5, 1), ("drop_nulls", "v"): (5, 4, 1),
                     ("drop_duplicates", None): (4, 3, 1), ("cap_p99.9", "v"): (3, 3, 1), ("drop_outliers_iqr", "id"): (3, 3, 0)}


def test_scratch_tables_go_with_their_scope(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark) + "/fathom-scratch")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = len(fs.listStatus(path)) if fs.exists(path) else 0
    with scratch_scope(spark):
        assert reliable_checkpoint(spark.range(5)).count() == 5
        rank_by_key(_frame(spark), ["k"], "v", tiebreak=["id"]).count()
        assert len(fs.listStatus(path)) > before
    assert (len(fs.listStatus(path)) if fs.exists(path) else 0) == before


def test_more_input_gives_more_slices(spark):
    assert ranks.slice_count(10 << 20, 8) is None
    assert ranks.slice_count(100 << 40, 200) == 10 * ranks.slice_count(10 << 40, 200) > 8000
    assert ranks.input_bytes(spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")) > 5 * ranks.input_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey")
    assert ranks.input_bytes(li.join(li, "l_orderkey")) < 1 << 30        # the tables read, not an estimate of the join
