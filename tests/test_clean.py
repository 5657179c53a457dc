from pyspark.sql import functions as F

from fathom.operators import clean as C


def accounting(spark):
    """9,880 rows, 500 NULL prices, then 120 copies of non-null rows: 10,000 rows in."""
    base = spark.range(0, 9880).select(
        "id", F.when(F.col("id") < 500, F.lit(None)).otherwise((F.col("id") % 97).cast("double")).alias("price"),
        (F.col("id") % 5).cast("string").alias("category"))
    return base.unionAll(base.where((F.col("id") >= 1000) & (F.col("id") < 1120)))


def test_accounting_example(spark):
    df = accounting(spark)
    assert df.count() == 10000
    rules = C.CleanRules(null_subset=["price"], outlier_cols={"price": "cap"})
    cleaned, report = C.clean(df, rules)
    rep = {r["step"]: r for r in report.collect()}
    assert rep["drop_nulls"]["affected"] == 500
    assert rep["drop_duplicates"]["affected"] == 120
    assert rep["drop_duplicates"]["rows_out"] == 9380 and cleaned.count() == 9380
    hi = cleaned.agg(F.max("price")).first()[0]
    assert hi <= 96 and rep["cap_p99"]["rows_in"] == 9380


def test_dedup_keep_first_by_order(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (1, 9.0, "b"), (2, 1.0, "c")], "k int, v double, s string")
    out = {r["k"]: r["s"] for r in C.drop_duplicates(df, ["k"], [F.desc("v")]).collect()}
    assert out == {1: "b", 2: "c"}


def test_fill_nulls_strategies(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "x"), (float("nan"), "y")], "v double, s string")
    out = C.fill_nulls(df, {"v": "mean", "s": "mode"}).collect()
    assert [r["v"] for r in out] == [1.0, 2.0, 3.0, 2.0]
    assert [r["s"] for r in out] == ["x", "x", "x", "y"]
    med = C.fill_nulls(df, {"v": "median"}).collect()
    assert med[1]["v"] == 2.0


def test_outlier_rules(spark):
    vals = [float(i) for i in range(1, 21)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    kept = [r["x"] for r in C.drop_outliers(df, "x", "iqr").collect()]
    assert 1000.0 not in kept and None in kept and len(kept) == 21
    flagged = C.flag_outliers(df, "x", "zscore", k=3).where("x_outlier").collect()
    assert [r["x"] for r in flagged] == [1000.0]
    capped = C.cap_outliers(df, "x", upper=0.5).agg(F.max("x")).first()[0]
    assert capped == 11.0


def test_repairs(spark):
    df = spark.createDataFrame([(" 1,234 ",), ("n/a",), ("5.5",)], "s string")
    assert [r["s"] for r in C.to_number(df, "s").collect()] == [1234.0, None, 5.5]
    dates = spark.createDataFrame([("2024-02-03",), ("03/02/2024",), ("junk",)], "d string")
    got = [str(r["d"]) for r in C.to_date(dates, "d", ["yyyy-MM-dd", "dd/MM/yyyy"]).collect()]
    assert got == ["2024-02-03", "2024-02-03", "None"]


def test_nested(spark):
    df = spark.createDataFrame([((1, (2, "z")), [1, 2]), ((3, (4, "w")), [])],
                               "a struct<x:int,y:struct<p:int,q:string>>, arr array<int>")
    assert C.flatten(df.select("a")).columns == ["a_x", "a_y_p", "a_y_q"]
    ex = C.explode_column(df.select(F.col("a.x").alias("id"), "arr"), "arr").collect()
    assert [(r["id"], r["pos"], r["arr"]) for r in ex] == [(1, 0, 1), (1, 1, 2), (3, None, None)]
    js = spark.createDataFrame([('{"k": 3}',), ("bad",)], "j string")
    assert [r["j"]["k"] if r["j"] else None for r in C.parse_json(js, "j", "k int").collect()] == [3, None]
    merged = C.merge_tables({"a": df.select(F.col("a.x").alias("x")), "b": df.select(F.col("a.y.p").alias("p"))})
    assert set(merged.columns) == {"x", "p", "source"} and merged.count() == 4
    info = C.describe_output(df).collect()
    assert [(r["column_name"], r["rows"]) for r in info] == [("a", 2), ("arr", 2)]
