import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.operators import query as Q
from fathom.operators.chart import chart_data, line_pixels
from fathom.operators.scan import scan_text
from fathom.operators.udf import apply_batches, apply_groups


def test_chart_bar_and_pie(spark):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 20), ("b", 5.0, 1)], "k string, x double, y int")
    bar = {(r["label"], r["series"]): (r["value"], r["series_index"], r["color_index"])
           for r in chart_data(df, "bar").collect()}
    assert bar[("a", "x")] == (3.0, 1, 1) and bar[("a", "y")] == (30.0, 2, 2)
    pie = {r["label"]: (r["pct"], r["show_label"]) for r in chart_data(df, ["pie", "bar"]).collect()}
    assert pie == {"a": (38, False), "b": (63, False)}
    assert {r["label"] for r in chart_data(df, "bar", disabled=["b"]).collect()} == {"a"}
    assert chart_data(df, "bar", y_min=10).count() == 1
    top = chart_data(df, "bar", top=1).collect()
    assert {(r["label"], r["series"]) for r in top} == {("b", "x"), ("b", "y")}
    with pytest.raises(ValueError):
        chart_data(df, "radar")
    with pytest.raises(ValueError):
        chart_data(df, [])
    nolabel = chart_data(df.select("x"), "line").collect()
    assert nolabel[0]["label"] is None and nolabel[0]["value"] == 8.0


def test_run_query_and_records(spark):
    t = {"t": spark.range(0, 5)}
    assert Q.run_query(spark, t, "SELECT sum(id) AS s FROM t").first()["s"] == 10
    assert Q.run_query(spark, t, lambda ts: ts["t"].where("id > 2")).count() == 2
    with pytest.raises(TypeError):
        Q.run_query(spark, t, lambda ts: 42)
    with pytest.raises(Exception):
        Q.run_query(spark, t, "SELEC nothing")
    cut = Q.result_records(spark.range(0, 500), limit=100)
    assert len(cut) == 100 and cut.truncated and not Q.result_records(spark.range(0, 5), 5).truncated
    assert Q.result_column(spark.range(3), 10) == [0, 1, 2] and Q.result_scalar(spark.range(1)) == 0
    assert Q.result_dict(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k", "v", 10) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        Q.result_scalar(spark.range(2))


def test_run_query_leaves_the_callers_views(spark):
    spark.range(7).createOrReplaceTempView("mine")
    assert Q.run_query(spark, {"mine": spark.range(3), "other": spark.range(2)}, "SELECT count(*) AS n FROM mine, other").first()["n"] == 6
    assert spark.table("mine").count() == 7 and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("mine")


def test_asof_join_matches_brute_force(spark):
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 10), (3, 2, 1), (4, 1, 1)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 3, 30.0), (1, 10, 100.0), (2, 5, 5.0)], "k int, t int, v double")
    got = {r["id"]: r["v"] for r in Q.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {1: 30.0, 2: 100.0, 3: None, 4: None}
    strict = {r["id"]: r["v"] for r in Q.asof_join(left, right, ["k"], "t", "t", ["v"], strict=True).collect()}
    assert strict[2] == 30.0


def test_top_k_per_group_and_summary(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1)], "g int, v int")
    top = Q.top_k_per_group(df, ["g"], [F.desc("v")], 2).collect()
    assert sorted((r["g"], r["v"], r["rank"]) for r in top) == [(1, 6, 2), (1, 7, 1), (2, 1, 1)]
    s = {(r["column_name"], r["statistic"]): r["value"] for r in Q.summary(df).collect()}
    assert s[("v", "p50")] == 5.5 and s[("v", "rows")] == 4


def test_udf_hooks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 6.0), (2, 3.0)], "g int, x double")
    doubled = apply_batches(df, lambda p: p.assign(x=p.x * 2), "g int, x double")
    assert sorted(r["x"] for r in doubled.collect()) == [4.0, 6.0, 12.0]
    share = apply_groups(df, ["g"], lambda p: p.assign(x=p.x / p.x.sum()), "g int, x double")
    assert sorted(r["x"] for r in share.collect()) == [0.25, 0.75, 1.0]


def test_scan_text(spark):
    text = "import os\nx = eval(y)  \nprint('fine')\n  <script>eval(z)</script>"
    df = spark.createDataFrame([(7, text), (8, "description only"), (9, None)], "id int, t string")
    hits = sorted((r["id"], r["token"], r["line_no"], r["line"]) for r in scan_text(df, "id", "t").collect())
    assert (7, "import os", 1, "import os") in hits
    assert (7, "eval(", 2, "x = eval(y)") in hits
    assert (7, "eval(", 4, "<script>eval(z)</script>") in hits and (7, "script", 4, "<script>eval(z)</script>") in hits
    assert (8, "script", 1, "description only") in hits   # plain substring match, like the original list
    reason = scan_text(df, "id", "t").where("token = 'eval('").first()["reason"]
    assert reason.startswith("Dynamic evaluation")


def test_line_pixels_keep_the_shape(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x, y = rng.random(5000) * 100, rng.normal(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(4)
    got = {r["pixel"]: r for r in line_pixels(df, "x", "y", 50).collect()}
    place = np.minimum(((x - x.min()) / (x.max() - x.min()) * 50).astype(int), 49)
    for p in range(50):
        mine = place == p
        order = np.argsort(x[mine])
        r = got[p]
        assert r["n"] == mine.sum() and r["y_min"] == y[mine].min() and r["y_max"] == y[mine].max()
        assert r["y_first"] == y[mine][order[0]] and r["y_last"] == y[mine][order[-1]] and r["x_last"] == x[mine].max()
    zoomed = line_pixels(df, "x", "y", 10, x_range=(20.0, 30.0))
    assert zoomed.agg(F.sum("n")).first()[0] == ((x >= 20) & (x <= 30)).sum()


def test_line_pixels_of_few_points(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, float("nan"), "a"), (5.0, 3.0, "a"), (5.0, 1.0, "a"), (None, 1.0, "b")], "x double, y double, s string")
    r = line_pixels(df, "x", "y", 7, series="s").collect()
    assert [(q["series"], q["pixel"], q["n"], q["y_first"], q["y_last"]) for q in r] == [("a", 0, 2, 1.0, 3.0)]
    assert line_pixels(df.where("x > 9"), "x", "y", 7).count() == 0
    with pytest.raises(ValueError):
        line_pixels(df, "x", "y", 0)


def test_chart_series_by_value(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "v", 2.0), ("a", "u", 3.0), ("b", None, 5.0)], "k string, s string, x double")
    got = {(r["label"], r["series"]): (r["series_index"], r["color_index"], r["value"]) for r in chart_data(df, "bar", series="s").collect()}
    assert got == {("a", "u"): (0, 0, 4.0), ("a", "v"): (1, 1, 2.0), ("b", None): (2, 2, 5.0)}
    assert {r["label"] for r in chart_data(df, "line", series="s", top=1).collect()} == {"a"}
    with pytest.raises(ValueError):
        chart_data(df, "pie", series="s")
