from fathom.streaming import screen_text_stream


def test_stream_screen(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "ok\nimport os"), (2, "fine")], "id long, t string").write.parquet(str(src))
    q = screen_text_stream(spark, str(src), "id long, t string", "id", "t", str(out), available_now=True,
                           checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(out)).collect()
    assert [(r["id"], r["token"], r["line_no"]) for r in rows] == [(1, "import os", 2)]
