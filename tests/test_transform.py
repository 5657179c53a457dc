import pytest
from pyspark.sql import functions as F

from fathom.operators import transform as X


def test_numeric_transforms(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    assert [r["x_normalized"] for r in X.normalize(df, "x").collect()] == [0.0, 0.5, 1.0, None]
    assert [r["x_bin"] for r in X.binning(df, "x", bins=4).collect()] == [0, 2, 3, None]
    assert [r["x_scaled"] for r in X.scale(df, "x").collect()][1] == 0.0
    logs = X.log_transform(spark.createDataFrame([(-1.0,), (0.0,)], "x double"), "x").collect()
    assert [r["x_log"] for r in logs] == [None, 0.0]
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x_normalized"] for r in X.normalize(const, "x").collect()] == [None, None]


def test_categorical_transforms(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    oh = X.one_hot_encode(df, "s", ["a", "b"]).collect()
    assert sorted(r["s"] for r in X.categories(df, "s").collect()) == ["a", "b"]
    assert [(r["s_a"], r["s_b"]) for r in oh] == [(0, 1), (1, 0), (0, 0), (0, 1)]
    lab = {r["s"]: r["s_label"] for r in X.label_encode(df, "s").collect()}
    assert lab == {"a": 0, "b": 1, None: None}
    many = spark.range(0, 25).select("id", F.when(F.col("id") > 0, F.col("id").cast("string")).alias("s"))
    assert sorted(r["index"] for r in X.one_hot_long(many, "id", "s").collect()) == list(range(24))
    dotted = df.withColumnRenamed("s", "a.s")
    assert sorted(str(r[1]) for r in X.label_encode(dotted, "a.s").collect()) == ["0", "1", "1", "None"]


def test_text_transforms(spark):
    df = spark.createDataFrame([("  Hello,\tWorld  hello ",)], "t string")
    assert X.string_cleaning(df, "t").first()["t"] == "hello, world hello"
    counts = {r["token"]: r["count"] for r in X.token_counts(df, "t").collect()}
    assert counts == {"hello": 2, "world": 1}
    urls = spark.createDataFrame([("https://a.example.com/x",), ("nope",)], "u string")
    assert [r["u_extract"] for r in X.regex_extract(urls, "u", r"^https?://([^/]+)").collect()] == ["a.example.com", ""]


def test_time_transforms(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:07:00"), (1, "2024-01-01 10:00:00"), (2, "2024-01-03 00:00:00")],
                               "k int, s string").select("k", F.col("s").cast("timestamp_ntz").alias("ts"))
    d = {(r["k"], str(r["ts"])): r["ts_delta_seconds"] for r in X.time_delta(df, "ts", key=["k"]).collect()}
    assert d[(1, "2024-01-01 10:00:00")] is None and d[(1, "2024-01-01 10:07:00")] == 420.0
    dow = [r["ts_dow"] for r in X.day_of_week(df, "ts").orderBy("ts").collect()]
    assert dow == [0, 0, 2]
    bins = X.time_binning(df, "ts", width="15 minutes").orderBy("ts").collect()
    assert str(bins[1]["ts_bin"]) == "2024-01-01 10:00:00"
    assert X.extract_year(df, "ts").first()["ts_year"] == 2024
    assert X.extract_month(df, "ts").first()["ts_month"] == 1


def test_words_of_every_script(spark):
    df = spark.createDataFrame([("Über señor, l’été naïve—42_x",)], "t string")
    assert {r["token"] for r in X.token_counts(df, "t").collect()} == {"über", "señor", "l", "été", "naïve", "42_x"}


def test_missing_values_have_no_bin_scale_or_bucket(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (float("nan"),), (None,)], "x double")
    assert [r["x_bin"] for r in X.binning(df, "x", bins=2).collect()] == [0, 1, None, None]
    assert [r["x_normalized"] for r in X.normalize(df, "x").collect()] == [0.0, 1.0, None, None]
    ts = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS ts UNION ALL SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59' UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 00:16:00'")
    got = {str(r["ts"]): str(r["ts_bin"]) for r in X.time_binning(ts, "ts", width="15 minutes").collect()}
    assert got == {"None": "None", "1969-12-31 23:59:59": "1969-12-31 23:45:00", "2024-01-01 00:16:00": "2024-01-01 00:15:00"}
    with pytest.raises(ValueError):
        X.time_binning(ts, "ts", width="1 month")
